"""Approximate nearest neighbours by collision counting over single-projection arrays.

Every vector is projected on ``PROJECTIONS`` random directions; each projection is a
sorted array. A query starts with a narrow window around its own projection in each
array. Virtual rehashing widens all windows step by step (the same arrays serve every
radius); a vector that lies inside the window of ``THRESHOLD`` of the projections or
more has collided often enough and is verified by its exact distance. A query ends when
``k`` verified vectors lie within the radius that the windows stand for, or all vectors
have been verified; a radius never grows past the distance of the ``k``-th so far. A window
reaches ``WIDTH`` radii to both sides: a vector at the radius falls into each with probability
0.866, so 106 of 128 collide with probability 0.92, and nearer ones more often.

The vectors are dealt into blocks, each indexed on its own. A query searches its own block
first; the ``k``-th distance found there is a bound, and in the other blocks its windows grow
no further than that. Queries are dealt into blocks too and meet the blocks of vectors through
a shuffle, so neither side is ever held whole. Every row is indexed; there is no sample.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite
component take no part, nor do rows without id; vectors of other dimensions than the
query's are no candidates; rows with the query's own id are the query's own row; a
repeated id counts once as a query (the first vector in order); equal distances go to
the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.llm.staging import parts, stage

PROJECTIONS, THRESHOLD, STEP, WIDTH = 128, 106, 1.08, 1.5
#: Rows of a block of vectors, and of a block of queries.
VECTORS, QUERIES = 8192, 2048


def directions(dim: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, PROJECTIONS))


def _times(rows: list[np.ndarray], n: int) -> np.ndarray:
    """How often each of ``n`` rows occurs in the lists."""
    return np.bincount(np.concatenate(rows), minlength=n) if rows else np.zeros(n, np.int64)


class Block:
    """One block of vectors: the sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.a = directions(vectors.shape[1])
        p = vectors @ self.a
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(p.T), self.order, axis=1)
        # a first radius: small against the spread of the block
        self.start = max(float(np.sqrt(vectors.var(axis=0).sum())) * 0.5, 1e-12)
        # equal vectors may differ in the last digits of their projections
        self.slack = float(np.abs(self.sorted).max()) * 1e-12

    def nearest(self, query: np.ndarray, own: int, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and squared distances of the block's nearest, by collision counting; windows stand
        for ``bound`` at most. With it, how many vectors were verified."""
        n = len(self.ids)
        at = query @ self.a
        held: tuple[list[int], list[int]] | None = None  # the windows so far
        count = np.zeros(n, np.int64)
        seen = self.ids == own
        left = int(n - seen.sum())
        rows: list[np.ndarray] = []
        dist: list[np.ndarray] = []
        # under a bound, half of it first: where that finds k already, the windows stay small
        radius, best, got = (self.start if bound == np.inf else bound / 2), np.inf, 0
        while left > 0:
            half = WIDTH * radius + self.slack
            lo = [int(s.searchsorted(x, "left")) for s, x in zip(self.sorted, at - half, strict=True)]
            hi = [int(s.searchsorted(x, "right")) for s, x in zip(self.sorted, at + half, strict=True)]
            if held is None:  # count what lies inside a window or outside of it, whichever is less
                wide = [2 * (b - a) > n for a, b in zip(lo, hi, strict=True)]
                inside = [self.order[j, lo[j] : hi[j]] for j in range(PROJECTIONS) if not wide[j]]
                outside = [self.order[j, x] for j in range(PROJECTIONS) if wide[j] for x in (slice(lo[j]), slice(hi[j], n))]
                count = sum(wide) + _times(inside, n) - _times(outside, n)
            else:
                grown = [self.order[j, x] for j in range(PROJECTIONS) for x in (slice(lo[j], held[0][j]), slice(held[1][j], hi[j]))]
                count = count + _times(grown, n)
            held = lo, hi
            new = np.flatnonzero((count >= THRESHOLD) & ~seen)
            if len(new):
                seen[new] = True
                left -= len(new)
                d = ((self.vectors[new] - query) ** 2).sum(axis=1)
                rows.append(new)
                dist.append(d)
                got += len(new)
                if got >= k:
                    best = float(np.sqrt(np.partition(np.concatenate(dist), k - 1)[k - 1]))
            if min(best, bound) <= radius:
                break
            # where hardly anything collides yet, larger steps lose nothing
            step = np.inf if bound < np.inf else STEP if 2 * count.max() >= THRESHOLD else 2.0
            radius = min(radius * step if radius > 0 else bound, best, bound)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0), 0
        r, d = np.concatenate(rows), np.concatenate(dist)
        pick = np.lexsort((self.ids[r], d))[:k]
        return self.ids[r[pick]], d[pick], got


def usable(vector: Column) -> Column:
    """Not null or empty, finite throughout, and not all zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and score (distance) of every query."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = stage(rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")), "vectors")
    rows = rows.withColumn("dim", F.size("v"))
    count = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / VECTORS).alias("nv"), F.ceil(F.count_if("q") / QUERIES).alias("nq"))
    sides = rows.join(F.broadcast(count), "dim")  # a row for each dimension that occurs
    own = F.pmod(F.xxhash64("id"), F.col("nv"))
    data = sides.select("dim", own.alias("vb"), F.lit(-1).cast("long").alias("qb"), "id", "v", F.lit(None).cast("double").alias("bound"))
    queries = sides.where("q").dropDuplicates(["id"]).select("dim", own.alias("vb"), F.pmod(F.xxhash64("id"), F.col("nq")).alias("qb"), "id", "v", "nv")
    asks_any, most = count.agg(F.max("nq"), F.max("nv")).first()
    if not asks_any:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = None
        name = None
        ids: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def answer(i: np.ndarray, m: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            q, o, s = [], [], []
            for own, query, bound in zip(i.tolist(), m, bounds.tolist(), strict=True):
                found, d, _ = block.nearest(query, own, k, np.inf if math.isnan(bound) else bound)
                q.append(np.full(len(found), own))
                o.append(found)
                s.append(np.sqrt(d))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, o, s)], ["query_id", "id", "score"])

        for b in batches:
            dim, vb, qb, i = (b.column(c).to_numpy() for c in range(4))
            cut = np.flatnonzero((np.diff(dim) != 0) | (np.diff(vb) != 0) | ((qb[1:] < 0) != (qb[:-1] < 0))) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(i)], strict=True):
                if hi == lo:
                    continue
                m = _matrix(b.column(4).slice(lo, hi - lo), int(dim[lo]))
                if (dim[lo], vb[lo]) != name:
                    name, block, ids, held = (dim[lo], vb[lo]), None, [], []
                if qb[lo] < 0:
                    ids.append(i[lo:hi])
                    held.append(m)
                else:
                    if block is None:
                        block = Block(np.concatenate(ids), np.concatenate(held))
                    yield answer(i[lo:hi], m, b.column(5).slice(lo, hi - lo).to_numpy(zero_copy_only=False))

    def searched(asks: DataFrame) -> DataFrame:
        columns = ["dim", "vb", "qb", "id", "v", "bound"]
        dealt = data.unionByName(asks.select(columns)).repartition(parts(spark), "dim", "vb").sortWithinPartitions("dim", "vb", "qb", "id")
        return dealt.select(columns).mapInArrow(search, "query_id long, id long, score double")

    found = searched(queries.withColumn("bound", F.lit(None).cast("double")))
    if most > 1:
        found = stage(found, "own")
        bounds = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("bound"))
        # each block of queries goes to each other block of vectors: rows grow with blocks, not with pairs
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1), lambda x: x != F.col("own"))
        rest = queries.withColumnRenamed("vb", "own").join(bounds, "id", "left").withColumn("vb", F.explode(others))
        found = found.unionByName(searched(rest))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
