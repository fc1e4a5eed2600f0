"""The corpus pipeline: language identification, line dedup, near copies, decontamination,
mixing. Each stage calls one operator of ``quirestream.llm`` on all that its predecessor
kept; all but the last return the columns of documents. Extra columns of ``docs`` pass
through; columns that are missing or null follow the operators' own rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestream.llm import decontam, jaccard, langid, linededup, mixing
from quirestream.llm.naming import free
from quirestream.llm.staging import few, stage

#: Ids of dropped documents that are sent to every task; more are joined by a shuffle.
SEND = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors tell; rejected ones go."""
    found = langid.identify(docs, langid.train(docs))
    return found.where(~F.col(found.columns[-1])["rejected"]).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; the source is the host here.
    ``n_chars`` is that of the new text."""
    source = F.coalesce(F.col("source"), F.lit(""))
    found = linededup.drop_boilerplate(docs, host=source, text=F.col("text"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents, that of the least id (no id comes
    last); of rows that repeat one document, one. A row is told by its id and its text, so
    rows without id, or of one id with several texts, are documents like others."""
    own = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"))
    (key,) = free(docs.columns, "key")
    found = stage(few(jaccard.near_copies(docs.select(own.alias("doc_id"), "text"))), "components")
    twice = stage(few(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key))), "twice")
    dropped = stage(few(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(key)).distinct()), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= SEND else dropped
    kept = docs.withColumn(key, own).join(dropped, key, "left_anti")
    if not twice.isEmpty():
        sent = F.broadcast(twice) if twice.count() <= SEND else twice
        kept = kept.join(sent, key, "left_anti").unionByName(kept.join(sent, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document that is left goes into the mix."""
    return mixing.mix_to_weights(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", clean_of_benchmark),
    ("source_mixing", mix),
]

#: The compressors of the first stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
