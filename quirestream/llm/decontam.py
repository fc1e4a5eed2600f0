"""Benchmark decontamination by winnowing.

Texts are lower-cased words. Of every ``k``-gram hash the smallest in each run of
``span - k + 1`` grams is a fingerprint, so two texts that share ``span`` words always
share a fingerprint. Fingerprints of documents and benchmark items are joined; where
one meets, the hit is extended: the windows of ``span`` words around it are compared
with the item's, and every word inside an equal window is hit.

A benchmark of up to ``broadcast_bytes`` of text goes to every task as sorted arrays;
a larger one is joined by shuffled fingerprints. Both ways give the same rows.

Defined results: null or wordless texts have no words, no hits and are clean; an item
of fewer than ``span`` words is one window, looked up at its own length; wordless items
match nothing; repeated rows give repeated results; repeated item rows count once;
an item without id counts as the id ''; other columns are left alone, and where one has
the name of a result the result's name gets a ``_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirestream.llm.naming import free
from quirestream.llm.staging import small_batches
from quirestream.llm.tokens import ALNUM, gram_starts, grams, words

SPAN, K = 13, 7
RESULT = "n_words long, n_hit long, items array<string>"


@dataclass
class Index:
    """The benchmark as sorted arrays."""

    prints: np.ndarray  # fingerprints
    windows: dict[int, tuple[np.ndarray, np.ndarray]]  # length: sorted window hashes, item number of each
    items: list[str]


def winnow(hashes: np.ndarray, counts: np.ndarray, bounds: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of every fingerprint; documents of fewer than ``span`` words have none."""
    g = grams(hashes, k)
    w = span - k + 1
    starts, _ = gram_starts(counts, bounds, span)  # one window of grams each
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, at = g[starts], starts.copy()
    for o in range(1, w):
        other = g[starts + o]
        less = other < best
        best = np.where(less, other, best)
        at = np.where(less, starts + o, at)
    at = np.unique(at)
    return at, g[at]


def item_index(rows: list[tuple[str | None, str | None]], span: int = SPAN, k: int = K) -> Index:
    rows = sorted({("" if i is None else str(i), t or "") for i, t in rows})
    column = pa.array([t for _, t in rows], pa.string())
    names = sorted({i for i, _ in rows})
    number = {n: x for x, n in enumerate(names)}
    prints, found = [], {}
    for b in words(column, ALNUM):
        _, p = winnow(b.hashes, b.counts, b.bounds, span, k)
        prints.append(p)
        who = np.array([number[rows[b.first + d][0]] for d in range(len(b.counts))], np.int64)
        for n in {min(int(c), span) for c in b.counts if c}:
            pick = b.counts >= span if n == span else b.counts == n
            starts, per = gram_starts(np.where(pick, b.counts, 0), b.bounds, n)
            found.setdefault(n, []).append((grams(b.hashes, n)[starts], np.repeat(who, per)))
    windows = {}
    for n, got in found.items():
        pairs = np.unique(np.stack([np.concatenate([h for h, _ in got]).view(np.int64), np.concatenate([i for _, i in got])], axis=1), axis=0)
        h, i = pairs[:, 0].view(np.uint64) if pairs.flags.c_contiguous else np.ascontiguousarray(pairs[:, 0]).view(np.uint64), pairs[:, 1]
        order = np.argsort(h, kind="stable")
        windows[n] = (h[order], i[order])
    return Index(np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64), windows, names)


def _isin(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if len(sorted_) == 0:
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


def _hits(b, ix: Index, span: int, k: int) -> tuple[np.ndarray, list[set[int]]]:
    """Words hit, and items, of each document of a slice."""
    hit = np.zeros(len(b.hashes) + 1, np.int64)
    items: list[set[int]] = [set() for _ in b.counts]
    for n, (hashes, who) in ix.windows.items():
        starts, _ = gram_starts(b.counts, b.bounds, n)
        if n == span:  # only the windows that contain a fingerprint of both sides
            at, p = winnow(b.hashes, b.counts, b.bounds, span, k)
            at = at[_isin(p, ix.prints)]
            if len(at) == 0:
                continue
            near = np.zeros(len(b.hashes) + 1, np.int64)
            np.add.at(near, np.maximum(at - (span - k), 0), 1)
            np.add.at(near, at + 1, -1)
            starts = starts[np.cumsum(near)[starts] > 0]
        if len(starts) == 0:
            continue
        g = np.zeros(len(starts), np.uint64) if len(b.hashes) < n else grams(b.hashes, n)[starts]
        same = _isin(g, hashes)
        starts, g = starts[same], g[same]
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + n, -1)
        lo, hi = np.searchsorted(hashes, g, "left"), np.searchsorted(hashes, g, "right")
        doc = np.searchsorted(b.bounds, starts, "right") - 1
        for d, x, y in set(zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True)):
            items[d].update(who[x:y].tolist())
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
    return covered[b.bounds[1:]] - covered[b.bounds[:-1]], items


def scan(column: pa.Array, ix: Index, span: int = SPAN, k: int = K) -> tuple[list[int], list[int], list[list[str]]]:
    n_words, n_hit, items = [], [], []
    for b in words(column, ALNUM):
        hit, found = _hits(b, ix, span, k)
        n_words += b.counts.tolist()
        n_hit += hit.tolist()
        items += [sorted(ix.items[i] for i in f) for f in found]
    return n_words, n_hit, items


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids of the items whose
    windows occur) and ``contaminated`` (hit words are 5% of the words or more)."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 40)).first()[0] or 0
    names = docs.columns
    if size <= broadcast_bytes:
        ix = docs.sparkSession.sparkContext.broadcast(item_index([(r.i, r.t) for r in items.toLocalIterator()], span, k))
        found = _with_hits(docs, text_col, lambda: ix.value, span, k)
    else:
        found = _joined(docs, items, text_col, span, k)
    n_words, n_hit, items_, bad = free(names, "n_words", "n_hit", "items", "contaminated")
    return found.withColumn(bad, (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))).select(*names, n_words, n_hit, items_, bad)


def _with_hits(docs: DataFrame, text_col: str, index, span: int, k: int) -> DataFrame:
    at = docs.columns.index(text_col)
    names = free(docs.columns, "n_words", "n_hit", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index()
        for b in batches:
            n, h, i = scan(b.column(at), ix, span, k)
            more = [pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(i, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])

    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    more = [StructField(n, t) for n, t in zip(names, (LongType(), LongType(), ArrayType(StringType())), strict=True)]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))


def _joined(docs: DataFrame, items: DataFrame, text_col: str, span: int, k: int) -> DataFrame:
    """For a large benchmark: fingerprints (and short windows) meet in a shuffle; each
    document then gets the texts of the items that it met, and is scanned for those.
    Documents are keyed by a hash of their text, which needs no id; texts that share one
    share the items to scan for, which changes no result."""

    def prints(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(1), ALNUM):
                rows, keys = [], []
                at, p = winnow(w.hashes, w.counts, w.bounds, span, k)
                rows.append(np.searchsorted(w.bounds, at, "right") - 1)
                keys.append(p)
                for n in lengths:
                    starts, per = gram_starts(w.counts, w.bounds, n)
                    if len(starts):
                        rows.append(np.repeat(np.arange(len(per)), per))
                        keys.append(grams(w.hashes, n)[starts])
                rows, keys = np.concatenate(rows), np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows + w.first)), pa.array(keys.view(np.int64))], ["id", "print"])

    key, name, found = free(docs.columns, "key", "met", "found")
    # items have short lengths of their own only: a full-length window never equals one
    count = F.size(F.regexp_extract_all(F.lower("t"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    lengths = [r.n for r in items.select(count.alias("n")).where(f"n > 0 and n < {span}").distinct().collect()]
    left = docs.select(F.xxhash64(text_col).alias("id"), text_col).mapInArrow(lambda b: prints(b, lengths), "id long, print long").distinct()
    right = items.mapInArrow(lambda b: prints(b, lengths), "id string, print long").withColumnRenamed("id", "i").distinct()
    met = left.join(right, "print").select("id", "i").distinct().join(items, "i").groupBy(F.col("id").alias(key)).agg(F.collect_set(F.struct("i", "t")).alias(name))
    both = docs.withColumn(key, F.xxhash64(text_col)).join(met, key, "left")

    @F.pandas_udf(RESULT)
    def each(text: pd.Series, met: pd.Series) -> pd.DataFrame:
        out = []
        for t, m in zip(text, met, strict=True):
            got = [] if m is None else [(x["i"], x["t"]) for x in m]
            n, h, i = scan(pa.array([t], pa.string()), item_index(got, span, k), span, k)
            out.append((n[0], h[0], i[0]))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "items"])

    results = ("n_words", "n_hit", "items")
    both = both.withColumn(found, each(text_col, name))
    return both.select(*docs.columns, *(F.col(found)[x].alias(y) for x, y in zip(results, free(docs.columns, *results), strict=True)))


def items_digest(items: pd.Series) -> pd.Series:
    return items.map(lambda x: hashlib.sha256(",".join(x).encode()).hexdigest())
