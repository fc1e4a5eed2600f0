"""Numbers of whole blocks of texts, packed for a shuffle.

A task puts the numbers of some million words into one block, orders them, deals them into
lanes and sends one row for each lane. Gaps between ordered numbers, split into byte
planes, need two to three bytes each where a row a number would need twenty.
"""

from __future__ import annotations

import ctypes
import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd

from quirestream.llm.tokens import U, mix64

#: Numbers of one block; numbers that one lane of a shuffle should hold.
BLOCK, LANE = 1 << 21, 8_000_000

_PACK, _UNPACK = zstd.ZstdCompressor(level=1, write_content_size=True), zstd.ZstdDecompressor()


def release() -> None:
    """Gives the memory that this process holds but does not use back to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker holds little while it waits beside the JVM for further tasks."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return out


def packed(x: np.ndarray, ordered: bool = False) -> bytes:
    """Non-negative whole numbers as bytes; ``ordered``: they rise, and gaps are kept."""
    x = np.ascontiguousarray(x).astype(U)
    if ordered and len(x):
        x = np.diff(x, prepend=U(0))
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if width else b""
    return struct.pack("<IB", len(x), width) + (_PACK.compress(planes) if planes else b"")


def unpacked(data: bytes, ordered: bool = False) -> np.ndarray:
    n, width = struct.unpack_from("<IB", data)
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(_UNPACK.decompress(data[5:]), np.uint8).reshape(width, n).T
    x = out.view(U).reshape(-1)
    return np.cumsum(x, dtype=U) if ordered else x


def lanes_for(numbers: int, least: int) -> int:
    """Lanes of a shuffle of so many numbers: ``least``, or so many that each holds ``LANE``."""
    return max(least, -(-numbers // LANE))


def spread(h: np.ndarray, lanes: int) -> np.ndarray:
    """The lane of each 64-bit number, by its leading bits: lanes are ranges."""
    return ((h >> U(32)) * U(lanes) >> U(32)).astype(np.int64)


def scattered(h: np.ndarray, lanes: int) -> np.ndarray:
    """The lane of each number, whatever its bits."""
    return spread(mix64(h + U(0x632BE59BD9B4E019)), lanes)


def dealt(lane: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each lane that occurs and the places of its numbers, in the order they have."""
    order = np.argsort(lane, kind="stable")
    cut = np.flatnonzero(np.diff(lane[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(lane[part[0]]), part


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows of a stream that is ordered by its first column, one of its values at a time;
    no more than a batch is held. A value's rows have to be read before the next value."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def of(key=key) -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                row, ahead = ahead, next(rows, None)
                yield row

        own = of()
        yield key, own
        for _ in own:
            pass
