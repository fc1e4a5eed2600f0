"""The registered queries of the library's own operators, each with its SQL where SQL can
express it. Inputs are whole tables; what they lack (ligatures, layout, spreadsheets) is put
in by the same expression on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.functions import markdown as M
from quirestream.functions import tables as T
from quirestream.functions import text as X
from quirestream.operators import cells as C
from quirestream.operators import guards as G
from quirestream.operators import layout as L
from quirestream.operators import ocr as O
from quirestream.operators import page_tables as P
from quirestream.plans.convert import convert_pages
from quirestream.plans.staging import stage
from quirestream.sources import plain
from quirestream.sources.files import audit, output_names, route
from quirestream.sources.html import read_html
from quirestream.streaming import limits
from quirestream.streaming.folder import sessions, windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# SQL pieces, in the dialect of the oracle.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def s_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def s_punct(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[ \t]+([,.;:!?)\]»])', '\1', 'g'), '([(\[«])[ \t]+', '\1', 'g')"


def s_clean(x: str) -> str:
    return s_punct(s_squeeze(x))


def s_escape(x: str) -> str:
    return rf"regexp_replace({x}, '([\\`*_])', '\\\1', 'g')"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# Text --------------------------------------------------------------------------------


@query(
    rf"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n[ \t]*\n'), lambda x: {s_clean("x")}), lambda x: x <> '') AS parts FROM documents)
    SELECT doc_id, array_to_string(list_transform(parts, lambda x: {s_escape("x")}), chr(10) || chr(10)) || chr(10) AS markdown FROM b"""
)
def q01_txt_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return read(spark, d, "documents").select("doc_id", M.render_sections(plain.text_sections(text)).alias("markdown"))


@query(f"SELECT doc_id, {s_escape('text')} AS escaped FROM documents")
def q02_escape_markdown(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", M.escape(F.col("text")).alias("escaped"))


@query("SELECT doc_id, replace(replace(replace(replace(text, 'fi', 'f' || 'i'), ', ', '\", '), 'th', 't-h'), 'and', '...and') AS plain FROM documents")
def q03_normalize_unicode(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    for a, b in (("fi", "ﬁ"), (", ", "”, "), ("th", "t–h"), ("and", "…​and")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return read(spark, d, "documents").select("doc_id", X.normalize_unicode(t).alias("plain"))


@query("SELECT doc_id, text AS plain FROM documents")
def q04_strip_private(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.strip_private(F.replace(F.col("text"), F.lit(" "), F.lit(" "))).alias("plain"))


@query("SELECT doc_id, replace(text, 'of', 'f') AS repaired FROM documents")
def q05_repair_cid(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace(F.col("text"), F.lit("the"), F.lit("(cid:116)he")), F.lit("of"), F.lit("(cid:7)f"))
    return read(spark, d, "documents").select("doc_id", X.repair_cid(t).alias("repaired"))


@query(f"SELECT doc_id, {s_punct(chr(39).join(['replace(replace(text, ', ', ', ', ', ' , ', '), ', '.', ', ', ' .(  ', ')']))} AS spaced FROM documents")
def q06_punctuation_spacing(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" , ")), F.lit("."), F.lit(" .(  "))
    return read(spark, d, "documents").select("doc_id", X.punctuation_spacing(t).alias("spaced"))


@query(rf"SELECT doc_id, regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g') AS one_line, {s_clean('text')} AS clean FROM documents")
def q07_collapse_blanks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.collapse_blank(F.col("text")).alias("one_line"), X.clean_text(F.col("text")).alias("clean"))


@query(
    r"""WITH t AS (SELECT upper(c_mktsegment) AS t FROM customer UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_name FROM part)
    SELECT t, regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '\p{Ll}') AS caps, count(*) AS n FROM t GROUP BY t"""
)
def q08_is_all_caps(spark: SparkSession, d: str) -> DataFrame:
    names = [read(spark, d, "customer").select(F.upper("c_mktsegment").alias("t")), read(spark, d, "region").select("r_name"), read(spark, d, "nation").select("n_name"), read(spark, d, "part").select("p_name")]
    t = names[0]
    for n in names[1:]:
        t = t.union(n)
    return t.groupBy("t").agg(F.count(F.lit(1)).alias("n")).select("t", X.is_all_caps(F.col("t")).alias("caps"), "n")


def _s_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


_S_CAP = "upper(w[1]) || lower(w[2:])"


@query(
    rf"""WITH t AS (SELECT p_partkey, upper(p_name) || ' DE LA 2B' AS t FROM part), w AS (SELECT p_partkey, t, string_split(t, ' ') AS ws FROM t)
    SELECT p_partkey, CASE WHEN regexp_matches(t, '\p{{Lu}}') AND NOT regexp_matches(t, '\p{{Ll}}') THEN array_to_string(list_transform(ws, lambda w, i: CASE WHEN w = '' OR list_contains({_s_list(X.ACRONYMS_ES)}, w) OR regexp_matches(w, '[0-9]') THEN w WHEN i > 1 AND list_contains({_s_list(X.MINOR_ES)}, lower(w)) THEN lower(w) ELSE {_S_CAP} END), ' ') ELSE t END AS title FROM w"""
)
def q09_title_case_es(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", X.title_case(F.concat(F.upper("p_name"), F.lit(" DE LA 2B")), "es").alias("title"))


@query(
    rf"""WITH t AS (SELECT p_partkey, upper(p_name) || ' OF THE 2B UP' AS t FROM part), w AS (SELECT p_partkey, t, string_split(t, ' ') AS ws FROM t)
    SELECT p_partkey, CASE WHEN regexp_matches(t, '\p{{Lu}}') AND NOT regexp_matches(t, '\p{{Ll}}') THEN array_to_string(list_transform(ws, lambda w, i: CASE WHEN w = '' OR regexp_matches(w, '[0-9]') THEN w WHEN i > 1 AND i < len(ws) AND list_contains({_s_list(X.MINOR_EN)}, lower(w)) THEN lower(w) ELSE {_S_CAP} END), ' ') ELSE t END AS title FROM w"""
)
def q10_title_case_en(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", X.title_case(F.concat(F.upper("p_name"), F.lit(" OF THE 2B UP")), "en").alias("title"))


def _s_language(x: str) -> str:
    hits = lambda words: f"len(list_filter(ws, lambda w: list_contains({_s_list(words)}, w)))"
    return f"(SELECT CASE WHEN len(ws) >= 8 AND {hits(X.STOP_EN)} > {hits(X.STOP_ES)} THEN 'en' ELSE 'es' END FROM (SELECT regexp_extract_all(lower(substring({x}, 1, 20000)), '{X.LANGUAGE_WORD}') AS ws))"


@query(f"SELECT doc_id AS id, {_s_language('text')} AS language FROM documents UNION ALL SELECT conv_id * 1000 + turn, {_s_language('text')} FROM conversations")
def q11_detect_language(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    talk = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return docs.union(talk).select("id", X.detect_language(F.col("text")).alias("language"))


@query(f"SELECT lang, language, count(*) AS n FROM (SELECT lang, {_s_language('text')} AS language FROM documents) GROUP BY CUBE (lang, language)")
def q12_language_confusion(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("lang", X.detect_language(F.col("text")).alias("language")).cube("lang", "language").agg(F.count(F.lit(1)).alias("n"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_ord", "text"))


S_LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_ord FROM documents)"


def s_key(x: str) -> str:
    return s_strip(f"regexp_replace(lower({x}), '[0-9]+', '#', 'g')")


@query(f"WITH {S_LINES} SELECT {s_key('text')} AS key, count(*) AS n, min(doc_id) AS first_doc FROM lines GROUP BY 1")
def q13_line_keys(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy(X.line_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    rf"""WITH u AS (SELECT page_id, 'see *this* ' || url || ', and_more.' AS t, regexp_extract('see *this* ' || url || ', and_more.', 'https?://[^\s)]+') AS raw FROM pages),
    v AS (SELECT page_id, t, raw, regexp_replace(raw, '[.,;:)\]]+$', '') AS url FROM u)
    SELECT page_id, CASE WHEN raw = '' THEN {s_escape("t")} ELSE {s_escape("split_part(t, raw, 1)")} || '[' || regexp_extract(url, '^https?://([^/]*)', 1) || '](' || url || ')' || {s_escape("substring(raw, length(url) + 1)")} || {s_escape("substring(t, strpos(t, raw) + length(raw))")} END AS markdown FROM v"""
)
def q14_autolink(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", M.inline(F.concat(F.lit("see *this* "), F.col("url"), F.lit(", and_more."))).alias("markdown"))


# Files and guards --------------------------------------------------------------------

EXTENSIONS = (".TXT", ".md", ".csv", ".tsv", ".html", ".HTM", ".docx", ".pptx", ".xlsx", ".pdf", ".exe", "")


@query(
    f"""WITH f AS (SELECT doc_id, '/in/doc.v' || doc_id || {_s_list(list(EXTENSIONS))}[doc_id % 12 + 1] AS path FROM documents), e AS (SELECT *, lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) AS extension FROM f)
    SELECT doc_id, extension, CASE WHEN extension IN ('.html', '.htm') THEN 'html' WHEN extension IN ('.csv', '.tsv') THEN 'csv' WHEN extension = '.md' THEN 'markdown' WHEN extension = '.txt' THEN 'text' WHEN extension IN ('.pdf', '.docx', '.pptx', '.xlsx') THEN extension[2:5] END AS format,
      regexp_replace(regexp_extract(path, '([^/]+)$', 1), '(.)\\.[^.]*$', '\\1') || '.md' AS output, row_number() OVER (PARTITION BY regexp_replace(regexp_extract(path, '([^/]+)$', 1), '(.)\\.[^.]*$', '\\1') ORDER BY path) > 1 AS collision FROM e"""
)
def q15_route_formats(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 12).cast("int"))
    files = read(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/doc.v"), F.col("doc_id").cast("string"), name).alias("path"))
    return output_names(route(files, F.col("path")), F.col("path")).select("doc_id", "extension", "format", "output", "collision")


@query(
    """WITH w AS (SELECT doc_id, source, n_chars * 20000 AS length, count(*) OVER (PARTITION BY source) AS n_files, CAST(sum(n_chars * 20000) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_bytes FROM documents)
    SELECT doc_id, n_files, total_bytes, CASE WHEN n_files > 20 THEN 'INFRA_TOO_MANY_FILES' WHEN length > 26214400 OR total_bytes > 62914560 THEN 'INFRA_FILE_TOO_LARGE' END AS error_code FROM w"""
)
def q16_request_limits(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") * 20000).alias("length"))
    return G.request_limits(files, "source", "doc_id", "length").select("doc_id", "n_files", "total_bytes", "error_code")


# Tables -----------------------------------------------------------------------------


@query(
    """SELECT p_partkey AS tbl, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '' ELSE p_brand END AS cell, count(*) AS n FROM part GROUP BY ALL"""
)
def q17_blank_errors(spark: SparkSession, d: str) -> DataFrame:
    cell = F.when(F.col("p_size") % 3 == 0, " #N/A ").when(F.col("p_size") % 3 == 1, "#DIV/0!").otherwise(F.col("p_brand"))
    cells = read(spark, d, "part").select(F.col("p_partkey").alias("tbl"), cell.alias("cell"))
    return C.blank_errors(cells).groupBy("tbl", "cell").agg(F.count(F.lit(1)).alias("n"))


def _customer_cells(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    blank = F.col("c_custkey") % 4 == 0
    values = [F.col("c_name"), F.lit(""), F.col("c_mktsegment"), F.when(F.col("c_nationkey") > 25, "x").otherwise("")]
    return c.select(F.col("c_nationkey").cast("long").alias("tbl"), F.col("c_custkey").alias("row_ord"), F.posexplode(F.array(*[F.when(blank, "").otherwise(v) for v in values])).alias("col_ord", "cell"))


@query(
    """SELECT CAST(c_nationkey AS BIGINT) AS tbl, c_custkey AS row_ord, CAST(u.k AS INTEGER) AS col_ord, CASE WHEN u.k = 0 THEN c_name ELSE c_mktsegment END AS cell
    FROM customer, (VALUES (0), (2)) u(k) WHERE c_custkey % 4 <> 0"""
)
def q18_trim_empty(spark: SparkSession, d: str) -> DataFrame:
    return C.trim_empty(_customer_cells(spark, d))


def _lineitem_cells(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_discount").alias("a"), F.sum("l_tax").alias("b"))
    text = lambda c: F.replace(F.format_string("%.2f", F.col(c)), F.lit("."), F.lit(","))
    return li.select(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").alias("row_ord"), F.posexplode(F.array(text("a"), text("b"))).alias("col_ord", "cell"))


S_LINEITEM = """c AS (SELECT l_orderkey AS tbl, l_linenumber AS row_ord, u.k AS col_ord, replace(printf('%.2f', CASE WHEN u.k = 0 THEN a ELSE b END), '.', ',') AS cell
    FROM (SELECT l_orderkey, l_linenumber, sum(l_discount) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1, 2), (VALUES (0), (1)) u(k))"""


@query(
    f"""WITH {S_LINEITEM}, r AS (SELECT * FROM c QUALIFY max(CAST(cell <> '0,00' AS INT)) OVER (PARTITION BY tbl, row_ord) = 1)
    SELECT tbl, row_ord, CAST(col_ord AS INT) AS col_ord, cell FROM r QUALIFY max(CAST(cell <> '0,00' AS INT)) OVER (PARTITION BY tbl, col_ord) = 1"""
)
def q19_drop_zero_only(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_zero_only(_lineitem_cells(spark, d))


@query(
    """WITH grid AS (SELECT u.user_id AS row_ord, CAST(t.k AS INT) AS col_ord, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(1, 32)) AS k) t
      LEFT JOIN events e ON e.user_id = u.user_id AND day(e.ts) = t.k AND e.event_type = 'purchase' GROUP BY 1, 2),
    fill AS (SELECT col_ord, count(*) FILTER (n > 0) / count(*) AS fill FROM grid GROUP BY 1)
    SELECT CAST(0 AS BIGINT) AS tbl, col_ord, fill, fill >= 0.08 AS kept FROM fill"""
)
def q20_column_fill(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    days = e.select("user_id").distinct().select(F.col("user_id").alias("row_ord"), F.explode(F.sequence(F.lit(1), F.lit(31))).alias("col_ord"))
    n = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("row_ord"), F.dayofmonth("ts").alias("col_ord")).agg(F.count(F.lit(1)).alias("n"))
    cells = days.join(n, ["row_ord", "col_ord"], "left").select(F.lit(0).cast("long").alias("tbl"), "row_ord", "col_ord", F.coalesce(F.col("n").cast("string"), F.lit("")).alias("cell"))
    kept = C.trim_sparse_columns(cells).select("tbl", "col_ord").distinct().withColumn("kept", F.lit(True))
    return C.column_fill(cells).join(kept, ["tbl", "col_ord"], "left").select("tbl", "col_ord", "fill", F.coalesce("kept", F.lit(False)).alias("kept"))


def _order_cells(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = o.withColumn("r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("o_custkey")))
    live = F.col("r") * 2 <= F.col("n")
    cells = F.array(F.col("o_orderkey").cast("string"), F.when(live, F.col("o_orderpriority")).otherwise(""), F.when(live, F.col("o_orderstatus")).otherwise("0,0"))
    return rows.select(F.col("o_custkey").alias("tbl"), F.col("r").alias("row_ord"), F.posexplode(cells).alias("col_ord", "cell"))


S_ORDERS = """o AS (SELECT o_custkey AS tbl, o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    c AS (SELECT tbl, CAST(r AS INT) AS row_ord, CAST(u.k AS INT) AS col_ord, n, CASE u.k WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CASE WHEN 2 * r <= n THEN o_orderpriority ELSE '' END ELSE CASE WHEN 2 * r <= n THEN o_orderstatus ELSE '0,0' END END AS cell FROM o, (VALUES (0), (1), (2)) u(k))"""


@query(
    f"""WITH {S_ORDERS}, v AS (SELECT *, TRY_CAST(replace(cell, ',', '.') AS DOUBLE) AS x FROM c WHERE cell <> ''),
    w AS (SELECT *, lag(x) OVER (PARTITION BY tbl, col_ord ORDER BY row_ord) AS p FROM v WHERE x = floor(x)),
    up AS (SELECT tbl, col_ord, count(*) AS whole, bool_and(p IS NULL OR x > p) AS up FROM w GROUP BY 1, 2)
    SELECT v.tbl, v.col_ord, coalesce(any_value(whole) >= 3 AND any_value(whole) >= 0.6 * count(*) AND any_value(up), false) AS is_counter FROM v LEFT JOIN up USING (tbl, col_ord) GROUP BY 1, 2"""
)
def q21_counter_columns(spark: SparkSession, d: str) -> DataFrame:
    return C.counter_columns(_order_cells(spark, d))


@query(f"""WITH {S_ORDERS}, last AS (SELECT tbl, max(n) AS n FROM c GROUP BY 1)
    SELECT c.tbl, row_ord, col_ord, cell FROM c JOIN last USING (tbl) WHERE row_ord <= CASE WHEN last.n < 3 THEN last.n ELSE greatest(last.n // 2, 1) END""")
def q22_dead_tail(spark: SparkSession, d: str) -> DataFrame:
    return C.trim_dead_tail(_order_cells(spark, d))


def _nation_tables(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    rows = n.groupBy(F.col("n_regionkey").cast("long").alias("tbl")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.concat(F.col("n_name"), F.lit("|x")), F.lower("n_name")).alias("r")))).alias("x"))
    return rows.select("tbl", F.concat(F.array(F.array(F.lit("Key"), F.lit("Name"))), F.transform("x", lambda s: s["r"])).alias("rows"))


@query(
    r"""SELECT CAST(n_regionkey AS BIGINT) AS tbl, '| Key | Name |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || '\|x | ' || lower(n_name) || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1"""
)
def q23_render_table(spark: SparkSession, d: str) -> DataFrame:
    return _nation_tables(spark, d).select("tbl", M.table(F.col("rows")).alias("markdown"))


@query(
    """WITH c AS (SELECT CAST(n_regionkey AS BIGINT) AS tbl, unnest([length(CAST(n_nationkey AS VARCHAR)), length(n_name) + 2, length(n_name)]) AS n FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), unnest([3, 4, 0]) FROM region),
    a AS (SELECT tbl, count(*) FILTER (n > 0) / count(*) AS fill, max(n) / sum(n) AS concentration, avg(n) FILTER (n > 0) AS mean, count(*) // 3 AS rows FROM c GROUP BY 1)
    SELECT tbl, fill, concentration, mean AS mean_length, rows >= 3 AND fill >= 0.8 AND concentration <= 0.35 AND mean <= 60 AS clean FROM a"""
)
def q24_clean_data_table(spark: SparkSession, d: str) -> DataFrame:
    r = T.padded(F.col("rows"))
    return _nation_tables(spark, d).select("tbl", T.fill_ratio(r).alias("fill"), T.concentration(r).alias("concentration"), T.mean_cell_length(r).alias("mean_length"), T.is_clean_data_table(r).alias("clean"))


@query(
    """WITH s AS (SELECT s_nationkey AS tbl, count(*) AS n, count(*) FILTER (s_suppkey % 4 = 0) AS marked FROM supplier GROUP BY 1)
    SELECT CAST(tbl AS BIGINT) AS tbl, marked / n >= 0.5 AS bullets FROM s"""
)
def q25_bullet_list(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    text = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "• ").otherwise(""), F.col("s_name"))
    rows = s.groupBy(F.col("s_nationkey").cast("long").alias("tbl")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", text.alias("t")))), lambda x: F.array(F.lit(""), x["t"])).alias("rows"))
    return rows.select("tbl", T.is_bullet_list(F.col("rows")).alias("bullets"))


@query(
    """WITH r AS (SELECT l_orderkey AS tbl, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, [l_partkey, l_suppkey, l_linenumber] AS cells FROM lineitem)
    SELECT tbl, count(*) AS n_rows, CAST(sum(len(list_slice(cells, 1, 2))) AS BIGINT) AS n_cells FROM r WHERE k <= 3 GROUP BY 1"""
)
def q26_row_and_column_caps(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a delimited file of its lines, read under caps of three rows and two columns."""
    line = F.concat_ws(",", "l_partkey", "l_suppkey", "l_linenumber")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))))
    files = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("tbl")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    rows = plain.parse_delimited(3, 2)(F.col("text"), F.lit(".csv"))["rows"]
    return files.select("tbl", rows.alias("rows")).select("tbl", F.size("rows").cast("long").alias("n_rows"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + F.size(r)).alias("n_cells"))


# Layout -----------------------------------------------------------------------------


def _sized_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, laid out: forty to a page, sizes and weight by position."""
    n = F.col("line_ord")
    page = (F.floor(n / 40) + 1).cast("int")
    size = F.when((n + F.col("doc_id")) % 11 == 0, 16.0).when((n + F.col("doc_id")) % 7 == 0, 13.0).otherwise(10.0)
    top = (n % 40) * 12.0 + F.when(n % 5 == 4, 6.0).otherwise(0.0)
    return _lines(spark, d).select("doc_id", page.alias("page"), (n % 40).alias("line_ord"), "text", size.alias("size"), ((n + F.col("doc_id")) % 5 == 0).alias("bold"), top.alias("top"), F.lit(50.0).alias("x0"))


S_SIZED = f"""{S_LINES}, sized AS (SELECT doc_id, CAST(line_ord // 40 + 1 AS INT) AS page, CAST(line_ord % 40 AS INT) AS line_ord, text, CASE WHEN (line_ord + doc_id) % 11 = 0 THEN 16.0::DOUBLE WHEN (line_ord + doc_id) % 7 = 0 THEN 13.0 ELSE 10.0 END AS size,
    (line_ord + doc_id) % 5 = 0 AS bold, ((line_ord % 40) * 12.0 + CASE WHEN line_ord % 5 = 4 THEN 6.0 ELSE 0.0 END)::DOUBLE AS top FROM lines)"""
S_BODY = f"""body AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, count(*) AS n, min(page * 100000 + line_ord) AS f FROM sized WHERE {s_strip('text')} <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)"""


@query(f"WITH {S_SIZED}, {S_BODY} SELECT doc_id, body FROM body")
def q27_body_size(spark: SparkSession, d: str) -> DataFrame:
    return L.body_size(_sized_lines(spark, d))


@query(
    rf"""WITH {S_SIZED}, {S_BODY}, lv AS (SELECT doc_id, size, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS level FROM (SELECT DISTINCT s.doc_id, size FROM sized s JOIN body USING (doc_id) WHERE {s_strip("text")} <> '' AND size >= 1.15 * body)),
    m AS (SELECT doc_id, max(level) AS m FROM lv WHERE level <= 4 GROUP BY 1), t AS (SELECT *, {s_strip("text")} AS p FROM sized)
    SELECT t.doc_id, t.page, t.line_ord, CAST(coalesce(CASE WHEN level <= 4 THEN level END, CASE WHEN bold AND length(p) BETWEEN 1 AND 80 AND p NOT LIKE '%.' AND (regexp_matches(p, '^[0-9]+[.)]\s') OR p LIKE '%:') THEN least(coalesce(m, 0) + 1, 4) END, 0) AS INT) AS heading_level
    FROM t LEFT JOIN lv USING (doc_id, size) LEFT JOIN m USING (doc_id)"""
)
def q28_heading_levels(spark: SparkSession, d: str) -> DataFrame:
    from quirestream.config import DEFAULT

    return L.assign_headings(_sized_lines(spark, d), DEFAULT.but(heading_demote_title_block=False)).select("doc_id", "page", "line_ord", "heading_level")


def _source_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A source as a document, its documents as pages."""
    source = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    lines = _lines(spark, d).select(source.alias("doc_id"), F.col("doc_id").alias("page"), "line_ord", "text")
    return lines, read(spark, d, "documents").select(source.alias("doc_id"), F.col("doc_id").alias("page"))


@query(
    rf"""WITH {S_LINES}, f AS (SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS doc_id, doc_id AS page, line_ord, {s_key("text")} AS key FROM lines WHERE {s_strip("text")} <> ''),
    e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_ord) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_ord DESC) AS z FROM f),
    k AS (SELECT doc_id, key, count(DISTINCT page) AS n FROM e WHERE (a <= 3 OR z <= 3) AND key <> '' GROUP BY 1, 2),
    c AS (SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS doc_id, count(*) AS pages FROM documents GROUP BY 1)
    SELECT doc_id, key FROM k JOIN c USING (doc_id) WHERE pages >= 3 AND n >= 0.04 * pages"""
)
def q29_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    from quirestream.config import DEFAULT

    return L.repeated_keys(*_source_pages(spark, d), DEFAULT.but(repeated_page_ratio=0.04))


@query(rf"""WITH {S_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length({s_strip("text")}) <= 3 AND NOT regexp_matches({s_strip("text")}, '^[●•‣▪◦\-*·]')) AS n_junk FROM lines GROUP BY 1""")
def q30_junk_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(L.is_junk(F.col("text"))).alias("n_junk"))


@query(
    f"""WITH {S_SIZED}, g AS (SELECT *, top - lag(top) OVER (PARTITION BY doc_id, page ORDER BY top, line_ord) AS gap FROM sized), h AS (SELECT *, median(gap) OVER (PARTITION BY doc_id, page) AS mid FROM g)
    SELECT doc_id, page, line_ord, CAST(sum(CASE WHEN mid > 0 AND gap > 1.6 * mid THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY top, line_ord) AS INT) AS block_ord FROM h"""
)
def q31_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return L.lines_to_paragraphs(_sized_lines(spark, d)).select("doc_id", "page", "line_ord", "block_ord")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of documents: 270 words each, as an array."""
    docs = read(spark, d, "documents").select("doc_id", F.array_remove(F.split("text", r"\s+"), "").alias("all")).where("size(all) > 0")
    at = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / 270).cast("int"))
    return docs.select("doc_id", F.explode(F.transform(at, lambda p: F.struct((p + 1).alias("page"), F.slice("all", p * 270 + 1, 270).alias("texts")))).alias("p")).select("doc_id", "p.page", "p.texts")


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents, laid out: nine to a line, thirty lines to a page, a little uneven."""
    w = read(spark, d, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("i", "text"))
    return _laid_out(w)


def _laid_out(w: DataFrame, page: Column | None = None) -> DataFrame:
    """``w`` (doc_id, i, text: the words of each document by number) with page and place."""
    page = (F.floor(F.col("i") / 270) + 1).cast("int") if page is None else page
    n = F.col("i") % 270
    x0 = 40.0 + (n % 9) * 58.0
    top = F.floor(n / 9) * 14.0 + (F.col("i") * 7 % 4) * 0.9
    size = F.when(F.floor(n / 9) == 0, 18.0).otherwise(10.0)
    return w.select("doc_id", page.alias("page"), n.alias("word_ord"), "text", x0.alias("x0"), (x0 + 50.0).alias("x1"), top.alias("top"), (top + 10.0).alias("bottom"), size.alias("size"), F.when(F.floor(n / 9) == 0, "Arial-Bold").otherwise("Arial").alias("fontname"))


@query()
def q32_words_to_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.words_to_lines(_words(spark, d))


S_WORDS = r"""raw AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents), flat AS (SELECT doc_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS i FROM raw),
    words AS (SELECT doc_id, CAST(i // 270 + 1 AS INT) AS page, CAST(i % 270 AS INT) AS word_ord, text, (40.0 + (i % 270 % 9) * 58.0)::DOUBLE AS x0, ((i % 270 // 9) * 14.0 + (i * 7 % 4) * 0.9)::DOUBLE AS top FROM flat)"""


def _boxes(spark: SparkSession, d: str, pages: DataFrame | None = None) -> DataFrame:
    """Three boxes a page; the third holds the first."""
    pages = _pages(spark, d).select("doc_id", "page").distinct() if pages is None else pages
    box = lambda k, *v: F.struct(F.lit(k).alias("tbl_ord"), *(F.lit(float(x)).alias(n) for n, x in zip(("x0", "top", "x1", "bottom"), v, strict=True)))
    return pages.select("doc_id", "page", F.explode(F.array(box(0, 90, 50, 300, 120), box(1, 300, 200, 500, 260), box(2, 80, 40, 320, 130))).alias("b")).select("doc_id", "page", "b.*")


@query(
    f"""WITH {S_WORDS} SELECT doc_id, page, count(*) AS kept FROM words WHERE NOT (x0 + 25 BETWEEN 90 AND 300 AND top + 5 BETWEEN 50 AND 120) AND NOT (x0 + 25 BETWEEN 300 AND 500 AND top + 5 BETWEEN 200 AND 260) AND NOT (x0 + 25 BETWEEN 80 AND 320 AND top + 5 BETWEEN 40 AND 130) GROUP BY 1, 2"""
)
def q33_words_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    return L.words_outside_tables(_words(spark, d), _boxes(spark, d)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("kept"))


@query(f"WITH {S_WORDS} SELECT DISTINCT doc_id, page, 2 AS tbl_ord FROM words")
def q34_container_boxes(spark: SparkSession, d: str) -> DataFrame:
    return L.containers(_boxes(spark, d)).select("doc_id", "page", "tbl_ord")


@query(f"WITH {S_WORDS} SELECT doc_id, page FROM (SELECT doc_id, page, text, round_even((x0 - (word_ord % 2) * 58) / 1.0, 0) AS gx, word_ord // 2 AS gy FROM words) GROUP BY doc_id, page HAVING count(*) > count(DISTINCT (text, gx, gy))")
def q35_duplicate_glyphs(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    chars = w.select("doc_id", "page", F.col("word_ord").alias("char_ord"), "text", (F.col("x0") - (F.col("word_ord") % 2) * 58.0).alias("x0"), F.floor(F.col("word_ord") / 2).cast("double").alias("top"))
    return L.duplicate_glyphs(chars)


@query(rf"SELECT doc_id, {s_punct('array_to_string(list_transform(string_split(' + chr(39).join(['regexp_replace(replace(text, ', 'th', ', ', 't-', ' || chr(10) || ', 'h', '), ', '-' + chr(92) + 'n([a-z])', ', ', chr(92) + '1', ', ', 'g', ')']) + ', chr(10)), lambda x: trim(x)), ' + chr(39) + ' ' + chr(39) + ')')} AS joined FROM documents")
def q36_join_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.col("text"), F.lit("th"), F.lit("t-\nh"))
    return read(spark, d, "documents").select("doc_id", X.join_lines(F.split(t, "\n")).alias("joined"))


@query(
    """SELECT c_custkey, '| Field | Detail |' || chr(10) || '| --- | --- |' || chr(10) || '| 1.1 Name | ' || c_name || ' |' || chr(10) || '| 1.2 Segment | ' || c_mktsegment || ' |' || chr(10) || '| 1.3 Nation | ' || c_nationkey || ' |' AS markdown FROM customer"""
)
def q37_key_value_table(spark: SparkSession, d: str) -> DataFrame:
    t = F.format_string("1.1 Name: %s 1.2. Segment: %s 1.3 Nation: %d", "c_name", "c_mktsegment", "c_nationkey")
    return read(spark, d, "customer").select("c_custkey", M.table(X.key_value_rows(t, "en")).alias("markdown"))


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.?])\s+([A-ZÁÉÍÓÚÑ])', '\1' || chr(1) || '\2', 'g'), '\s+[\-–]\s*([A-ZÁÉÍÓÚÑ])', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \-–]+|[ \-–]+$', '', 'g')), lambda x: x <> '') AS items FROM documents)
    SELECT doc_id, CASE WHEN len(items) >= 2 THEN len(items) END AS n, CASE WHEN len(items) >= 2 THEN array_to_string(items, '|') END AS items FROM s"""
)
def q38_syllabus_items(spark: SparkSession, d: str) -> DataFrame:
    items = X.syllabus_items(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.when(items.isNotNull(), F.size(items).cast("long")).alias("n"), F.array_join(items, "|").alias("items"))


@query("SELECT c_nationkey AS doc_id, count(*) AS kept FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 3 <> 0) GROUP BY 1 UNION ALL SELECT c_nationkey + 100, count(*) FROM customer GROUP BY 1")
def q39_furniture_labels(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    label = M.element("paragraph", text=F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lit("Bibliografía")))
    other = F.when(F.col("c_custkey") % 3 == 0, M.element("paragraph", text=F.col("c_name"))).otherwise(M.element("heading", level=F.lit(1), text=F.col("c_name")))
    rows = c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("page"), F.posexplode(F.array(label, other)).alias("elem_ord", "element"))
    left = L.furniture_labels(rows)
    doc = F.when(F.col("elem_ord") == 1, F.col("doc_id") + 100).otherwise(F.col("doc_id"))
    return left.groupBy(doc.alias("doc_id")).agg(F.count(F.lit(1)).alias("kept"))


@query(
    f"""WITH {S_WORDS}, ok AS (SELECT doc_id, page, word_ord, trim(text) AS t, word_ord // 30 AS block_num, word_ord // 9 % 3 AS line_num FROM words WHERE word_ord * 37 % 100 >= 40)
    SELECT doc_id, page, CAST(block_num AS INT) AS block_num, CAST(0 AS INT) AS par_num, CAST(line_num AS INT) AS line_num, string_agg(t, ' ' ORDER BY word_ord) AS line, min(word_ord) AS first_ord FROM ok GROUP BY ALL"""
)
def q40_ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("word_ord")
    w = _words(spark, d).select("doc_id", "page", n.alias("ord"), "text", (n * 37 % 100).cast("double").alias("conf"), F.floor(n / 30).cast("int").alias("block_num"), F.lit(0).alias("par_num"), (F.floor(n / 9) % 3).cast("int").alias("line_num"))
    return O.words_to_lines(w, ["doc_id", "page"])


@query(
    f"""WITH {S_WORDS}, p AS (SELECT DISTINCT doc_id, page FROM words), i AS (SELECT doc_id, page, CAST(k AS INT) AS img_ord, x0::DOUBLE AS x0, top::DOUBLE AS top, x1::DOUBLE AS x1, bottom::DOUBLE AS bottom FROM p, (VALUES (0, 0, 0, 100, 100), (1, 0, 430, 600, 800), (2, 40, 0, 600, 400)) v(k, x0, top, x1, bottom)),
    n AS (SELECT i.*, count(w.x0) AS n_words FROM i LEFT JOIN words w ON i.doc_id = w.doc_id AND i.page = w.page AND w.x0 + 25 BETWEEN i.x0 AND i.x1 AND w.top + 5 BETWEEN i.top AND i.bottom GROUP BY ALL)
    SELECT doc_id, page, img_ord, (x1 - x0) * (bottom - top) / 480000.0::DOUBLE AS area_ratio, n_words, CASE WHEN (x1 - x0) * (bottom - top) / 480000 < 0.12 THEN 'small' WHEN n_words > 5 THEN 'text' WHEN (x1 - x0) * (bottom - top) / 480000 < 0.5 THEN 'skip' ELSE 'placeholder' END AS decision FROM n"""
)
def q40b_image_decisions(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    pages = w.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    box = lambda k, *v: F.struct(F.lit(k).alias("img_ord"), *(F.lit(float(x)).alias(n) for n, x in zip(("x0", "top", "x1", "bottom"), v, strict=True)))
    images = pages.select("doc_id", "page", F.explode(F.array(box(0, 0, 0, 100, 100), box(1, 0, 430, 600, 800), box(2, 40, 0, 600, 400))).alias("b")).select("doc_id", "page", "b.*")
    return O.image_decisions(images, w, pages, recogniser=False)


# Events, pages, conversations --------------------------------------------------------


@query()
def q41_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Each user's own limit, three requests in six hours."""
    return limits.limit_by_key(read(spark, d, "events"), "user_id", F.col("ts").cast("timestamp").cast("double"), "event_id", most=3, window=21600.0)


@query()
def q41b_rate_limit_total(spark: SparkSession, d: str) -> DataFrame:
    """Both limits: nine requests of all users and two of one in an hour."""
    return limits.limit_all(read(spark, d, "events"), "user_id", F.col("ts").cast("timestamp").cast("double"), "event_id", per_key=2, total=9, window=3600.0)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def q42_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows(read(spark, d, "events"), "ts", "1 hour").select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def q42b_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(read(spark, d, "events"), "ts", "user_id", "6 hours").select("user_id", F.col("session.start").alias("start"), "n")


@query()
def q43_html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    pages = read_html(read(spark, d, "pages"), F.col("html"))
    return pages.select("page_id", "language", M.render_sections(F.col("sections"), F.col("language")).alias("markdown"))


@query(
    rf"""SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || {s_escape(s_clean('text'))}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM conversations GROUP BY 1"""
)
def q44_conversations(spark: SparkSession, d: str) -> DataFrame:
    from quirestream.config import DEFAULT

    turn = F.array(M.element("heading", level=F.lit(2), text=F.col("role")), M.element("paragraph", text=X.clean_text(F.col("text"))))
    sections = F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("s")))), lambda x: x["s"])
    talks = read(spark, d, "conversations").groupBy("conv_id").agg(sections.alias("sections"))
    return talks.select("conv_id", M.render_sections(F.col("sections"), "es", DEFAULT.but(page_break=True)).alias("markdown"))


@query(
    """SELECT '{"timestamp":"2024-01-01 00:00:00","format_origen":"txt","tamano_bytes":' || n_chars || ',"duracion_ms":' || doc_id % 7 || CASE WHEN doc_id % 5 = 0 THEN ',"resultado":"error","codigo_error":"INFRA_CORRUPT_FILE","capa":"infra"}' ELSE ',"resultado":"ok","codigo_error":null,"capa":null}' END AS line FROM documents"""
)
def q45_audit_log(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("doc_id") % 5 == 0, "INFRA_CORRUPT_FILE")
    done = read(spark, d, "documents").select(F.lit("2024-01-01 00:00:00").alias("timestamp"), F.lit("txt").alias("format"), F.col("n_chars").alias("length"), (F.col("doc_id") % 7).alias("duration_ms"), *G.error_columns(bad))
    return audit(done)


@query(
    rf"""WITH p AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-záéíóúñü]+')) AS a, list_distinct(regexp_extract_all(lower({s_escape(s_clean("text"))}), '[a-záéíóúñü]+')) AS b FROM documents)
    SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS n_lost FROM p"""
)
def q46_word_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Words of the input that the Markdown has lost."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(X.LANGUAGE_WORD), F.lit(0)))
    docs = read(spark, d, "documents").select("doc_id", words(F.col("text")).alias("a"), words(M.render_sections(plain.text_sections(F.col("text")))).alias("b"))
    return docs.select("doc_id", F.size("a").cast("long").alias("n_words"), F.size(F.array_except("a", "b")).cast("long").alias("n_lost"))


@query()
def q47_pages_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Whole laid-out documents: words, table candidates and pages to Markdown."""
    # pages of 270 words are cut and dealt as text, before their words become rows: rows or arrays of words are more bytes to shuffle
    cut = F.regexp_extract_all("text", F.lit(r"(?:\S++\s++){0,269}\S++"), F.lit(0))
    pages = read(spark, d, "documents").select("doc_id", F.posexplode(cut).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")
    words = pages.repartition("doc_id", "page").select("doc_id", "page", F.posexplode(F.split("text", r"\s+")).alias("at", "text"))
    words = _laid_out(words.select("doc_id", ((F.col("page") - 1) * 270 + F.col("at")).alias("i"), "text", "page"), F.col("page"))
    grid = F.array(*[F.array(*[F.concat(F.lit(f"{r}.{c} "), F.col("doc_id").cast("string")) for c in range(4)]) for r in range(3)])
    numbers = stage(pages.select("doc_id", "page").distinct(), "pages")
    return convert_pages(words, _boxes(spark, d, numbers).withColumn("rows", grid), numbers)


@query()
def q48_table_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every table candidate's verdict."""
    grid = F.array(*[F.array(*[F.when((F.col("doc_id") + F.col("tbl_ord")) % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(f"{r}.{c} "), F.col("doc_id").cast("string"))) for c in range(4)]) for r in range(3)])
    return P.select_tables(_boxes(spark, d).withColumn("rows", grid)).groupBy("tbl_ord", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query()
def q49_clean_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a worksheet, cleaned as arrays: errors, dead tail, empty lines."""
    rows = T.clean_sheets(C.to_rows(_order_cells(spark, d)), "rows")
    return rows.select("tbl", M.table(F.col("rows")).alias("markdown"))


@query()
def q50_polish_tables(spark: SparkSession, d: str) -> DataFrame:
    """Score rows and split words of tables."""
    n = read(spark, d, "nation")
    grid = F.array(F.array(F.lit("presentac ón"), F.col("n_name"), F.lit("nivel A"), F.lit("nivel B")), F.array(F.lit(""), F.lit(""), F.col("n_nationkey").cast("string"), F.lit("3")), F.array(F.lit("--"), F.lit("---"), F.lit(""), F.lit("--")))
    return n.select("n_nationkey", M.table(T.polish(grid)).alias("markdown"))


from quirestream import catalogue_files  # noqa: E402, F401  its queries are registered here, too
