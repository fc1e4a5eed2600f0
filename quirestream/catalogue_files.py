"""Registered queries of the readers and of what stands around them: files are made from
rows of the tables, converted, and compared with the Markdown that SQL writes for these rows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestream.catalogue import S_WORDS, _words, query, read
from quirestream.config import DEFAULT
from quirestream.functions import text as X
from quirestream.operators import guards as G
from quirestream.operators import layout as L
from quirestream.plans.convert import convert
from quirestream.sources.files import output_names

NL = "chr(10)"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def _run(text: str, style: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{style}</w:rPr>" if style else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def _item(text: str, level: int, number: int) -> str:
    return f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr></w:pPr>{_run(text)}</w:p>'


def _cells(*texts: str) -> str:
    return "<w:tr>" + "".join(f"<w:tc><w:p>{_run(t)}</w:p></w:tc>" for t in texts) + "</w:tr>"


#: Parts of the archives; @1 to @3 stand for a row's values.
WORD = {
    "word/document.xml": f"""<w:document {_W}><w:body><w:p><w:pPr><w:pStyle w:val="T"/></w:pPr>{_run("@1")}</w:p>
      <w:p>{_run("plain ")}{_run("@2", "<w:b/>")}{_run(" and ")}{_run("tilted", "<w:i/>")}{_run(" ")}<w:hyperlink r:id="r1">{_run("site")}</w:hyperlink></w:p>
      {_item("one @3", 0, 1)}{_item("below", 1, 1)}{_item("two", 0, 1)}{_item("first", 0, 2)}{_item("second", 0, 2)}
      <w:tbl>{_cells("key", "segment")}{_cells("@3", "@2|x")}</w:tbl></w:body></w:document>""",
    "word/styles.xml": f'<w:styles {_W}><w:style w:type="paragraph" w:styleId="T"><w:name w:val="heading 2"/></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {_W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
    "word/_rels/document.xml.rels": _REL.format('<Relationship Id="r1" Type="x/hyperlink" Target="https://x.y/@3" TargetMode="External"/>'),
}
_SHAPE = '<p:sp><p:nvSpPr><p:cNvPr id="{0}" name="s"/><p:nvPr>{1}</p:nvPr></p:nvSpPr><p:txBody>{2}</p:txBody></p:sp>'
_PARA = "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"
SLIDES = {
    "ppt/presentation.xml": f'<p:presentation {_A}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": _REL.format('<Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/>'),
    "ppt/slides/slide1.xml": f"<p:sld {_A}><p:cSld><p:spTree>{_SHAPE.format(2, '<p:ph type="title"/>', _PARA.format('@1'))}{_SHAPE.format(3, '', _PARA.format('@2') + _PARA.format('key @3'))}{_SHAPE.format(4, '', _PARA.format('alone'))}</p:spTree></p:cSld></p:sld>",
    "ppt/slides/_rels/slide1.xml.rels": _REL.format('<Relationship Id="r1" Type="x/notesSlide" Target="../notesSlides/notes1.xml"/>'),
    "ppt/notesSlides/notes1.xml": f"<p:notes {_A}><p:cSld><p:spTree>{_SHAPE.format(2, '<p:ph type="body"/>', _PARA.format('note of @3'))}</p:spTree></p:cSld></p:notes>",
}
SHEETS = {
    "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="Ventas" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": _REL.format('<Relationship Id="r1" Type="x/worksheet" Target="worksheets/sheet1.xml"/>'),
    "xl/sharedStrings.xml": f"<sst {_S}><si><t>Mes</t></si><si><r><t>To</t></r><r><t>tal</t></r></si><si><t>@1</t></si></sst>",
    "xl/styles.xml": f'<styleSheet {_S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f"""<worksheet {_S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>@2</t></is></c></row>
      <row r="3"><c r="A3" s="1"><v>45292</v></c><c r="C3"><v>@3</v></c><c r="D3" t="s"><v>2</v></c></row>
      <row r="4"><c r="A4" t="str"><v>x</v></c><c r="C4" t="e"><v>#REF!</v></c><c r="D4" t="b"><v>1</v></c></row></sheetData></worksheet>""",
}


def archive(parts: dict[str, str], *values: Column) -> Column:
    """A ZIP file of the parts, with a row's values."""

    @F.pandas_udf("binary")
    def pack(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                for name, text in parts.items():
                    for i, v in enumerate(row):
                        text = text.replace(f"@{i + 1}", v)
                    z.writestr(name, text)
            out.append(data.getvalue())
        return pd.Series(out)

    return pack(*values)


def _converted(files: DataFrame, key: str, kinds: tuple[str, ...], config=DEFAULT) -> DataFrame:
    """key and Markdown; files are named by their key."""
    done = convert(files, config, formats=kinds)
    return done.select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias(key), "markdown")


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, list[Column]]:
    return read(spark, d, "customer"), [F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")]


@query(
    f"""SELECT c_custkey, '## ' || c_name || {NL} || {NL} || 'plain **' || c_mktsegment || '** and *tilted*  [site](https://x.y/' || c_custkey || ')' || {NL} || {NL} || '- one ' || c_custkey || {NL} || '  - below' || {NL} || '- two' || {NL} || {NL}
    || '1. first' || {NL} || '1. second' || {NL} || {NL} || '| key | segment |' || {NL} || '| --- | --- |' || {NL} || '| ' || c_custkey || ' | ' || c_mktsegment || '\\|x |' || {NL} AS markdown FROM customer"""
)
def q51_word_files(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a Word file: heading, marked runs, link, nested and numbered lists, table."""
    rows, values = _customers(spark, d)
    return _converted(rows.select(F.concat(F.lit("/in/"), values[2], F.lit(".docx")).alias("path"), archive(WORD, *values).alias("content")), "c_custkey", ("docx",))


@query(f"SELECT c_custkey, '# ' || c_name || {NL} || {NL} || '- ' || c_mktsegment || {NL} || '- key ' || c_custkey || {NL} || {NL} || 'alone' || {NL} || {NL} || '## Notas' || {NL} || {NL} || 'note of ' || c_custkey || {NL} AS markdown FROM customer")
def q52_slide_files(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a presentation: title, shapes of one and of several paragraphs, notes."""
    rows, values = _customers(spark, d)
    return _converted(rows.select(F.concat(F.lit("/in/"), values[2], F.lit(".pptx")).alias("path"), archive(SLIDES, *values).alias("content")), "c_custkey", ("pptx",))


@query(
    f"""SELECT c_custkey, '# Ventas' || {NL} || {NL} || '| Mes | Total | ' || c_mktsegment || ' |' || {NL} || '| --- | --- | --- |' || {NL}
    || '| 2024-01-01 00:00:00 | ' || c_custkey || ' | ' || c_name || ' |' || {NL} || '| x |  | True |' || {NL} AS markdown FROM customer"""
)
def q53_sheet_files(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a workbook: shared, inline and rich strings, dates, errors, empty rows and columns."""
    rows, values = _customers(spark, d)
    return _converted(rows.select(F.concat(F.lit("/in/"), values[2], F.lit(".xlsx")).alias("path"), archive(SHEETS, *values).alias("content")), "c_custkey", ("xlsx",))


@query(
    f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '| a | b |' || {NL} || '| --- | --- |' || {NL} || '| ' || c_name || ';1 |  |' || {NL}
    ELSE '(Filas recortadas a 3 columnas.)' || {NL} || {NL} || '| h | k | l |' || {NL} || '| --- | --- | --- |' || {NL} || '| ' || c_name || '\\|x | ' || c_mktsegment || ' | 1 |' || {NL} END AS markdown FROM customer"""
)
def q54_delimited_files(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as CSV or TSV: quotes, errors, a bar in a cell, rows and columns beyond the limits."""
    rows, (name, segment, key) = _customers(spark, d)
    even = F.col("c_custkey") % 2 == 0
    csv = F.concat(F.lit('a;b\r\n"'), name, F.lit(';1";#N/A\r\ncut;1\r\n'))
    tsv = F.concat(F.lit("h\tk\tl\tm\n"), name, F.lit("|x\t"), segment, F.lit("\t1\t2\ncut\t\t\t\n"))
    files = rows.select(F.concat(F.lit("/in/"), key, F.when(even, ".csv").otherwise(".tsv")).alias("path"), F.when(even, csv).otherwise(tsv).cast("binary").alias("content"))
    return _converted(files, "c_custkey", ("csv",), DEFAULT.but(xlsx_max_rows=2, xlsx_max_cols=3))


@query(
    f"""SELECT c_custkey, '# ' || c_name || {NL} || {NL} || 'a **' || c_mktsegment || '**  *c*  [d](https://x.y/' || c_custkey || ')e' || {NL} || {NL} || '- one' || {NL} || '  - two' || {NL} || '- three' || {NL} || {NL} || '1. n' || {NL} || {NL}
    || '| a | b |' || {NL} || '| --- | --- |' || {NL} || '| ' || c_custkey || ' | x\\|y |' || {NL} || {NL} || '> quote of ' || c_custkey || {NL} || {NL} || '```' || {NL} || 'p' || {NL} || '  q' || {NL} || '```' || {NL} || {NL} || '---' || {NL} || {NL} || '[Imagen: pic]' || {NL} || {NL} || '**h** l' || {NL} AS markdown FROM customer"""
)
def q55_html_files(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a page: all block and inline elements, ignored ones, styles against tags, tags left open."""
    rows, (name, segment, key) = _customers(spark, d)
    page = F.concat(
        F.lit("<script>x<b></script><div><h1>"), name, F.lit("</h1><p>a <b>"), segment, F.lit("</b> <em>c</em> <a href='https://x.y/"), key, F.lit("'>d</a><a href='#z'>e</a></p><ul><li>one<ul><li>two</li></ul></li><li>three</li></ul><ol><li>n</ol>"),
        F.lit("<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>"), key, F.lit("</td><td>x|y</td></tr></tbody></table><blockquote>quote\nof "), key, F.lit("</blockquote><pre>p\n  q</pre><hr><img alt='pic'>"),
        F.lit("<p><b style='font-weight:normal'><span style='font-weight:700'>h</span> l</b></p><style>.x{}</style></div><form>gone</form>"),
    )
    return _converted(rows.select(F.concat(F.lit("/in/"), key, F.lit(".html")).alias("path"), page.cast("binary").alias("content")), "c_custkey", ("html",))


def _bomb() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "0" * 8_000_000)
    return out.getvalue()


@query(
    """SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'INFRA_UNSUPPORTED_FORMAT' WHEN 1 THEN 'INFRA_CORRUPT_FILE' WHEN 2 THEN 'INFRA_CORRUPT_FILE' WHEN 3 THEN 'INFRA_FILE_TOO_LARGE' WHEN 4 THEN 'INFRA_FILE_TOO_LARGE' WHEN 5 THEN 'INFRA_UNSUPPORTED_FORMAT' END AS error_code,
    CASE WHEN s_suppkey % 7 < 6 THEN 'infra' END AS error_layer, CASE s_suppkey % 7 WHEN 0 THEN 400 WHEN 1 THEN 422 WHEN 2 THEN 422 WHEN 3 THEN 413 WHEN 4 THEN 413 WHEN 5 THEN 400 END AS http_status, s_suppkey % 7 = 6 AS converted FROM supplier"""
)
def q56_refused_files(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier as a file that is refused for its own reason: unknown, wrong signature, broken archive, too large, an archive that explodes, no reader; one in seven is fine."""
    k = F.col("s_suppkey") % 7
    suffix = F.element_at(F.array(*map(F.lit, (".exe", ".docx", ".xlsx", ".txt", ".xlsx", ".pdf", ".txt"))), (k + 1).cast("int"))
    content = F.when(k == 2, F.concat(F.unhex(F.lit("504B0304")), F.lit("broken").cast("binary"))).when(k == 3, F.repeat(F.lit("x"), 10_001).cast("binary")).when(k == 4, F.lit(_bomb())).otherwise(F.concat(F.lit("file of "), F.col("s_name")).cast("binary"))
    files = read(spark, d, "supplier").select(F.concat(F.lit("/in/"), F.col("s_suppkey"), suffix).alias("path"), content.alias("content"))
    done = convert(files, DEFAULT.but(max_file_size_bytes=10_000), formats=("text", "docx"))
    return done.select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("s_suppkey"), "error_code", "error_layer", "http_status", F.col("markdown").isNotNull().alias("converted"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id ELSE '9.9.9.9' END AS ip, event_id % 4 IN (0, 1, 2) AS allowed, event_id % 2 = 0 AS known,
    CASE WHEN event_id % 5 = 0 THEN 'documento' ELSE 'a' || event_type || ' ñ' END AS stem,
    CASE WHEN event_id % 5 = 0 THEN 'attachment; filename="documento.md"; filename*=UTF-8''''documento.md' ELSE 'attachment; filename="a' || event_type || ' _.md"; filename*=UTF-8''''a' || event_type || '%20%C3%B1.md' END AS header FROM events"""
)
def q57_serving_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a request: its client, origin and key, and the name of what it downloads."""
    e = read(spark, d, "events")
    i = F.col("event_id")
    ip = G.client_ip(F.when(i % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id"), F.lit(" , 1.2.3.4"))).when(i % 3 == 1, ""), F.lit("9.9.9.9"))
    origin = F.when(i % 4 == 0, "https://a.b").when(i % 4 == 1, "https://a.b/").when(i % 4 == 3, "https://evil.c")
    stem = G.safe_stem(F.when(i % 5 == 0, '/"\n.md').otherwise(F.concat(F.lit('/a"'), F.col("event_type"), F.lit(" ñ.pdf"))))
    return e.select("event_id", ip.alias("ip"), G.origin_allowed(origin, ["https://a.b/"]).alias("allowed"), G.key_matches(F.when(i % 2 == 0, "secret").when(i % 4 == 1, "wrong"), "secret").alias("known"), stem.alias("stem"), G.content_disposition(stem).alias("header"))


@query("SELECT doc_id, text AS decoded FROM documents")
def q58_decode_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Texts as UTF-8 with a mark, as UTF-8 and as Latin-1."""
    t, i = F.col("text"), F.col("doc_id") % 3
    latin = F.decode(F.encode(t, "ISO-8859-1"), "ISO-8859-1") == t
    data = F.when(i == 0, F.concat(F.unhex(F.lit("EFBBBF")), t.cast("binary"))).when((i == 1) & latin, F.encode(t, "ISO-8859-1")).otherwise(t.cast("binary"))
    return read(spark, d, "documents").select("doc_id", X.decode_bytes(data).alias("decoded"))


@query(
    f"""WITH {S_WORDS} SELECT doc_id, page, CAST(count(*) AS BIGINT) AS n, CAST(sum(word_ord) AS BIGINT) AS firsts
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, text, round_even((x0 - (word_ord % 2) * 58) / 1.0, 0), word_ord // 2 ORDER BY word_ord) AS k FROM words) WHERE k = 1 GROUP BY 1, 2"""
)
def q59_unique_glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs of every page without those printed twice at one place."""
    w = _words(spark, d)
    chars = w.select("doc_id", "page", F.col("word_ord").alias("char_ord"), "text", (F.col("x0") - (F.col("word_ord") % 2) * 58.0).alias("x0"), F.floor(F.col("word_ord") / 2).cast("double").alias("top"))
    return L.without_duplicate_glyphs(chars).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.sum("char_ord").cast("long").alias("firsts"))


@query(
    """SELECT doc_id, 'd' || doc_id % 50 || CASE WHEN doc_id % 4 = 1 THEN '.b' ELSE '' END || '.md' AS output,
    row_number() OVER (PARTITION BY doc_id % 50, doc_id % 4 = 1 ORDER BY '/' || source || '/' || doc_id || '/d') > 1 AS collision FROM documents"""
)
def q60_output_names(spark: SparkSession, d: str) -> DataFrame:
    """Output names of files in many folders, and which were given before."""
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("/d"), F.col("doc_id") % 50, F.when(F.col("doc_id") % 4 == 1, ".b.txt").otherwise(".html"))
    return output_names(read(spark, d, "documents").select("doc_id", path.alias("p")), F.col("p")).select("doc_id", "output", "collision")
