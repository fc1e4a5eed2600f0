"""The library's staging, with small Arrow batches: their rows are whole texts or sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirestream.plans import staging
from quirestream.plans.staging import parts, shared_dir

__all__ = ["few", "parts", "shared_dir", "small_batches", "stage", "stage_tidily"]

#: Most rows of an Arrow batch in a session that runs these operators.
ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ROWS`` rows; smaller ones stay."""
    if not 0 < int(spark.conf.get(_KEY)) <= ROWS:
        spark.conf.set(_KEY, str(ROWS))


def few(rows: DataFrame) -> DataFrame:
    """Short rows, to be written in an eighth of a shuffle's partitions."""
    return rows.repartition(max(2, parts(rows.sparkSession) // 8))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the reading of it."""
    small_batches(df.sparkSession)
    return staging.stage(df, name)


def stage_tidily(df: DataFrame, name: str) -> DataFrame:
    """``stage``, whose shuffle files go when the table is written; else they stay until the
    driver happens to collect its garbage. The session's setting is put back."""
    conf = df.sparkSession.conf
    was = conf.get(_TIDY, None)
    conf.set(_TIDY, "true")
    try:
        return stage(df, name)
    finally:
        conf.unset(_TIDY) if was is None else conf.set(_TIDY, was)
