"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestream.llm import decontam, jaccard, langid, linededup, mixing, neighbours, pii, pyp_lm, repeats, toxicity
from quirestream.llm.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def is_fold(n: int, k: int) -> Column:
    return F.coalesce(fold(n) == k, F.lit(False))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to weights 5, 2, 1, repeating, over the sources in order."""
    mix = mixing.mix_to_weights(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT reach.x AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.x GROUP BY reach.x
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, where=~is_fold(4, 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", is_fold(4, 2).alias("held_out"), "language.lang_pred", "language.score", "language.margin", "language.rejected")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item, w, least(len(w), 13) AS n FROM iw WHERE len(w) > 0),
iwin AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, d.n, i, item FROM dwin d JOIN iwin USING (n, win)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY 1),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone", "pii.base_sha256", "pii.spans")


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=~is_fold(5, 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", is_fold(5, 0).alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = pyp_lm.train(docs, where=~is_fold(5, 1), rare_contexts=True)
    found = pyp_lm.score(docs, model, counts)
    return found.select("doc_id", is_fold(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``pages``: visible lines, less those on more than a fifth of the host's pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lines = stage(pages.select("page_id", linededup.host_of(F.col("url")).alias("host"), linededup.html_lines(F.col("html")).alias("text")), "lines")
    found = linededup.drop_boilerplate(lines, host=F.col("host"), text=F.col("text"))
    return found.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH t AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(html, '%s', '', 'g'), '%s', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages),
l AS (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
k AS (SELECT *, trim(translate(line, chr(9) || chr(13), '  '), ' ') AS key FROM l),
totals AS (SELECT host, count(*) AS pages FROM t GROUP BY host),
bad AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT page_id) AS n FROM k WHERE key <> '' GROUP BY host, key) JOIN totals USING (host) WHERE n >= 2 AND n > 0.2 * pages)
SELECT k.page_id, k.host, CAST(count(*) FILTER (key <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (bad.key IS NOT NULL) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bad.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad USING (host, key) GROUP BY k.page_id, k.host
""" % (linededup.HIDDEN.replace("'", "''"), linededup.BLOCK_TAG.replace("'", "''"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_language_id": op3_language_id,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_personal_data": op5_personal_data,
        "op6_repeated_substrings": op6_repeated_substrings,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_toxicity": op8_toxicity,
        "op9_language_model": op9_language_model,
        "op10_boilerplate_lines": op10_boilerplate_lines,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op4_benchmark_decontamination": OP4_SQL, "op10_boilerplate_lines": OP10_SQL}
