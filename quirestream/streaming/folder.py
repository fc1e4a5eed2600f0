"""A folder as a stream of files: each batch is converted and written; a broken file is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirestream.config import DEFAULT, Config
from quirestream.plans.convert import convert

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def convert_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, config: Config = DEFAULT) -> StreamingQuery:
    """New files of ``folder`` become rows of the Parquet table ``out``. A batch that runs
    again after a failure replaces its own rows."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        convert(batch, config).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, time: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows, over a table or a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, length, slide) if slide else F.window(time, length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that a gap ends."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))
