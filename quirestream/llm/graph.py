"""Connected components of an edge table: in one task up to a checked number of edges, by
alternating large and small stars beyond it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirestream.llm.staging import stage


def _least(edges: DataFrame) -> DataFrame:
    """For each u: the least of u and its neighbours; summed before the shuffle."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


#: Edges that one task takes (16 bytes each).
SMALL = 2_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the least id that each reaches."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    up = np.arange(len(ids))
    while True:
        low = np.minimum(up[x], up[y])
        before = up.copy()
        for side in (x, y):
            np.minimum.at(up, before[side], low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        if np.array_equal(up, before):
            return ids, ids[up]


def _in_one_task(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            ids, least = least_reachable(*(np.concatenate(x) for x in zip(*got, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["id", "component"])

    return pairs.select("u", "v").repartition(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (least id reachable) of every id in the edges ``a``, ``b``.

    ``edges`` are read twice at least. Each round is a written table, so a lost executor costs one round. Stars shrink the
    depth of each component geometrically; a vertex with very many edges is summed
    before the shuffle and its join is one that Spark splits."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    if pairs.count() <= SMALL:
        return _in_one_task(pairs)
    pairs, mark = stage(pairs, "edges"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large), "u")
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        pairs = stage(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct(), "stars")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    # each vertex now points at the least of its component
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
