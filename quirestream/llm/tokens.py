"""Words of whole Arrow batches as numpy arrays, without a Python string per word.

A batch's text column is one UTF-8 buffer with offsets. Words are found by byte
class (all separators used here are ASCII, so UTF-8 never splits a character),
each word gets a 64-bit multilinear hash, and n-grams are hashed from those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once, unless one document is longer.
SLICE_BYTES = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finalizer)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _coefficients(n: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=U)) * U(0x9E3779B97F4A7C15)) | U(1)


_COEFF = _coefficients(4096)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of words: all but the given inclusive ranges."""
    out = np.ones(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


@dataclass
class Words:
    """Words of consecutive documents ``first`` to ``first + len(counts)``."""

    first: int
    counts: np.ndarray  # words of each document
    bounds: np.ndarray  # index of each document's first word, one more at the end
    hashes: np.ndarray  # uint64 of each word
    starts: np.ndarray  # byte offset of each word in ``buf``
    lengths: np.ndarray  # bytes of each word
    buf: np.ndarray  # lower-cased bytes


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a text column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(column: pa.Array, is_word: np.ndarray = SPACED, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of all rows, in slices. A-Z are lower-cased; other letters stay."""
    offsets, raw = buffers(column)
    for i, j in slices(offsets, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        buf = _LOWER[raw[lo:hi]]
        cut = offsets[i : j + 1] - lo
        yield _words(buf, cut, i, is_word)


def _words(buf: np.ndarray, cut: np.ndarray, first: int, is_word: np.ndarray) -> Words:
    n = len(buf)
    docs = len(cut) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(first, np.zeros(docs, np.int64), np.zeros(docs + 1, np.int64), np.zeros(0, U), z, z, buf)
    mask = is_word[buf]
    edge = np.zeros(n + 1, bool)
    edge[cut] = True
    begin = mask.copy()
    begin[1:] &= ~mask[:-1] | edge[1:n]
    close = mask.copy()
    close[:-1] &= ~mask[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    lengths = np.flatnonzero(close) + 1 - starts
    bounds = np.searchsorted(starts, cut)
    return Words(first, np.diff(bounds), bounds, hash_words(buf, mask, starts, lengths), starts, lengths, buf)


def hash_words(buf: np.ndarray, mask: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    global _COEFF
    if len(starts) == 0:
        return np.zeros(0, U)
    longest = int(lengths.max())
    if longest > len(_COEFF):
        _COEFF = _coefficients(max(longest, 2 * len(_COEFF)))
    at = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    place = np.arange(int(at[-1] + lengths[-1]), dtype=np.int64)
    place -= np.repeat(at, lengths)
    terms = _COEFF[place]
    terms *= buf[mask].astype(U) + U(1)
    return mix64(np.add.reduceat(terms, at))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (also across documents: the caller cuts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for c, m in enumerate(_COEFF[:k]):
        out += hashes[c : c + n] * m
    return mix64(out + U(k))


def gram_starts(counts: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``k`` words that stay in one document, and how many each document has."""
    per = np.maximum(counts - k + 1, 0)
    at = np.zeros(len(per), np.int64)
    np.cumsum(per[:-1], out=at[1:])
    starts = np.arange(int(per.sum()), dtype=np.int64) + np.repeat(bounds[:-1] - at, per)
    return starts, per


def arrow_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64) if x.dtype == U else x.astype(np.int64))
