"""The same table cleaning over a relation of cells (tbl, row_ord, col_ord, cell): for tables
that are too large for one row, or that are rows already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.config import DEFAULT, Config
from quirestream.functions.tables import is_zeroish, number_of
from quirestream.functions.text import strip


def blank_errors(cells: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return cells.withColumn("cell", F.when(strip(F.col("cell")).isin(list(config.xlsx_error_values)), "").otherwise(F.col("cell")))


def _drop(cells: DataFrame, worth) -> DataFrame:
    rows, cols = Window.partitionBy("tbl", "row_ord"), Window.partitionBy("tbl", "col_ord")
    kept = cells.withColumn("__r", F.max(worth.cast("int")).over(rows)).where("__r = 1")
    return kept.withColumn("__c", F.max(worth.cast("int")).over(cols)).where("__c = 1").drop("__r", "__c")


def trim_empty(cells: DataFrame) -> DataFrame:
    return _drop(cells, F.col("cell") != "")


def drop_zero_only(cells: DataFrame) -> DataFrame:
    return _drop(cells, ~is_zeroish(F.col("cell")))


def column_fill(cells: DataFrame) -> DataFrame:
    """Share of filled cells of each column over all rows of its table."""
    rows = cells.groupBy("tbl").agg(F.count_distinct("row_ord").alias("n"))
    full = cells.groupBy("tbl", "col_ord").agg(F.count_if(strip(F.col("cell")) != "").alias("full"))
    return full.join(rows, "tbl").select("tbl", "col_ord", (F.col("full") / F.col("n")).alias("fill"))


def trim_sparse_columns(cells: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return cells.join(column_fill(cells).where(F.col("fill") >= config.xlsx_min_col_fill).select("tbl", "col_ord"), ["tbl", "col_ord"], "left_semi")


def counter_columns(cells: DataFrame) -> DataFrame:
    """tbl, col_ord and is_counter."""
    full = cells.where(strip(F.col("cell")) != "").withColumn("n", number_of(F.col("cell")))
    whole = F.col("n").isNotNull() & (F.col("n") == F.floor("n"))
    totals = full.groupBy("tbl", "col_ord").agg(F.count(F.lit(1)).alias("filled"), F.count_if(whole).alias("whole"))
    order = Window.partitionBy("tbl", "col_ord").orderBy("row_ord")
    rising = full.where(whole).withColumn("up", F.coalesce(F.col("n") > F.lag("n").over(order), F.lit(True))).groupBy("tbl", "col_ord").agg(F.bool_and("up").alias("up"))
    ok = (F.col("whole") >= 3) & (F.col("whole") >= 0.6 * F.col("filled")) & F.col("up")
    return totals.join(rising, ["tbl", "col_ord"], "left").select("tbl", "col_ord", F.coalesce(ok, F.lit(False)).alias("is_counter"))


def trim_dead_tail(cells: DataFrame) -> DataFrame:
    counters = cells.select("tbl", "col_ord").distinct().join(counter_columns(cells), ["tbl", "col_ord"], "left").withColumn("is_counter", F.coalesce("is_counter", F.lit(False)))
    free = counters.withColumn("all_", F.min(F.col("is_counter").cast("int")).over(Window.partitionBy("tbl")))
    marked = cells.join(free.select("tbl", "col_ord", ((F.col("all_") == 1) | ~F.col("is_counter")).alias("content")), ["tbl", "col_ord"])
    last = marked.groupBy("tbl").agg(F.max(F.when(F.col("content") & ~is_zeroish(F.col("cell")), F.col("row_ord"))).alias("last"), F.min("row_ord").alias("first"))
    return cells.join(last, "tbl").where(F.col("row_ord") <= F.coalesce("last", "first")).select(*cells.columns)


def to_rows(cells: DataFrame) -> DataFrame:
    """tbl and rows (array of arrays), in order."""
    each = cells.groupBy("tbl", "row_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_ord", "cell"))), lambda x: x["cell"]).alias("r"))
    return each.groupBy("tbl").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "r"))), lambda x: x["r"]).alias("rows"))
