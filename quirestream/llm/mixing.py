"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source gets the same expected number of copies, target over
source size. The whole part is certain. The fractional parts are rounded in pairs:
of two documents with fractional mass (copies times size) some mass moves from one
to the other, in a direction drawn so that each expectation stays, until one of them
has none or all of its size. The sum of mass never changes, so a source misses its
target by less than one document. Blocks of about ``block`` documents are rounded
each on its own and leave one fractional document; these residuals go up a tree whose
nodes join ``block`` blocks, until one is left for a source. Blocks are dealt by a hash of
id and size, so groups stay small however many documents a source has; rows that share id
and size (or have no id and one size) share a block, which grows with their number.

Defined results: a null text has size 0; documents of size 0 take 0 words; a null
source is a source of its own, last in order; repeated rows are rounded as rows of
their own; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.llm.staging import few, stage

#: Words whose number is a document's size.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row per source: size, documents and target. Targets share the sum of all
    sizes by weight; none exceeds ``cap`` times its source's size, and what that
    leaves goes to the others by weight (the level at which all are filled)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.get(cycle, F.col("rank") % len(weights)))
    filled = Window.orderBy(cap * F.col("source_size") / F.col("weight"), "rank")
    before, every = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level)
    most = F.max("level").over(every)
    return sources.withColumn("target", F.least(cap * F.col("source_size"), most * F.col("weight"))).select("source", "source_size", "source_docs", "target")


def _draw(*key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _rounded(items: Column, seed: int) -> Column:
    """Rounds one block. State: the document in hand (``left``) and the finished ones."""
    first = F.get(items, 0)

    def step(state: Column, x: Column) -> Column:
        a = state["left"]
        up = F.least(a["size"] - a["mass"], x["mass"])  # what a can take from x
        down = F.least(a["mass"], x["size"] - x["mass"])  # what x can take from a
        rises = _draw(a["id"], x["id"], a["size"], x["size"], F.lit(seed)) * (up + down) < down
        total = a["mass"] + x["mass"]
        a_full, x_full = rises & (a["size"] - a["mass"] <= x["mass"]), ~rises & (x["size"] - x["mass"] <= a["mass"])
        a_done = a_full | (~rises & ~x_full)  # else x has come to an end
        done, kept = F.when(a_done, a).otherwise(x), F.when(a_done, x).otherwise(a)
        done = done.withField("copies", done["copies"] + F.when(a_full | x_full, 1).otherwise(0))
        kept = kept.withField("mass", F.when(a_full, total - a["size"]).when(x_full, total - x["size"]).otherwise(total))
        return F.struct(kept.alias("left"), F.concat(state["done"], F.array(done)).alias("done"))

    start = F.struct(first.alias("left"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), start, step)


def mix_to_weights(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, block: int = 32, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, source, size, source_size, target, copies and taken (copies times
    size) of every row. Reruns give the same."""
    sized = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    targets = stage(source_targets(sized, weights, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio).cast("long")
    rows = (
        sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.source_docs", "t.target")
        .select("id", "source", F.col("size").cast("double").alias("size"), "source_size", "source_docs", "target", whole.alias("copies"), ((ratio - whole) * F.col("size")).alias("mass"))
    )
    item = F.struct("id", "source", "size", "source_size", "target", "copies", "mass")
    empty = rows.where("size = 0").select(item.alias("x"))
    level = rows.where("size > 0").withColumn("blocks", F.ceil(F.col("source_docs") / block)).withColumn("block", F.pmod(F.xxhash64("id", "size", F.lit(seed)), F.col("blocks"))).select("source", "block", item.alias("x"))
    most = targets.agg(F.max("source_docs")).first()[0] or 1
    finished = [empty]
    blocks, depth = math.ceil(most / block), 0
    while True:
        grouped = level.groupBy("source", "block").agg(_rounded(F.array_sort(F.collect_list("x")), seed + depth).alias("state"))
        grouped = stage(few(grouped.select("source", "block", "state.left", "state.done")), f"mix{depth}")
        finished.append(grouped.select(F.explode("done").alias("x")))
        if blocks <= 1:
            break
        level = grouped.select("source", F.floor(F.col("block") / block).alias("block"), F.col("left").alias("x"))
        blocks, depth = math.ceil(blocks / block), depth + 1
    last = grouped.select(F.col("left").alias("x"))
    bit = F.when(_draw(F.col("x.id"), F.col("x.size"), F.lit(-seed)) * F.col("x.size") < F.col("x.mass"), 1).otherwise(0)
    finished.append(last.select(F.col("x").withField("copies", F.col("x.copies") + bit).alias("x")))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    size = F.col("x.size").cast("long")
    return out.select(F.col("x.id").alias(id_col), F.col("x.source").alias("source"), size.alias("size"), F.col("x.source_size").alias("source_size"), F.col("x.target").alias("target"), F.col("x.copies").cast("long").alias("copies"), (F.col("x.copies") * size).cast("long").alias("taken"))


def repeated(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus itself: every document as often as ``mix`` takes it."""
    times = mix.where("copies > 0").select(id_col, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return docs.join(times, id_col)
