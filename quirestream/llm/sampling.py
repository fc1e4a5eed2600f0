"""Bounded samples of labelled rows that any number of tasks can take together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def smallest_hashes(rows: DataFrame, group: str, key: str, bound: dict | int) -> DataFrame:
    """Of each group the ``bound`` rows of the smallest hash of ``key``, with ``rank`` (from 1).

    A first cut keeps the hashes below the share of the hash range that should hold four
    times the bound, so what is ranked has a fixed size however many rows and tasks there
    are. ``bound`` is one number, or one for each group (a missing group has none)."""
    most = F.lit(bound) if isinstance(bound, int) else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in bound.items() for x in kv]), F.col(group)), F.lit(0))
    hashed = rows.withColumn("__h", F.xxhash64(key))
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))  # one row a language or label
    share = (F.col("__h").cast("double") + 2.0**63) / 2.0**64
    near = hashed.join(F.broadcast(counts), group).where(share * F.col("__n") <= 4 * most + 64)
    order = Window.partitionBy(group).orderBy("__h", key)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("__h", "__n")
