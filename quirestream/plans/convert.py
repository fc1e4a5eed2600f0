"""Whole conversions: a table of files (or of page relations) to a table of Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirestream.config import DEFAULT, Config
from quirestream.functions.markdown import join_parts, render_element, render_sections
from quirestream.functions.text import decode_bytes, normalize_unicode, strip, strip_private
from quirestream.operators import assemble, layout, ocr, page_tables
from quirestream.operators.documents import documents_to_pieces
from quirestream.operators.guards import bad_signature, error_columns, too_large, zip_index, zip_verdict
from quirestream.operators.lines import LINES, words_to_page_lines
from quirestream.plans.staging import stage
from quirestream.sources import office, plain
from quirestream.sources.files import route
from quirestream.sources.html import read_html

#: Lines of images are numbered from here on, behind those of words.
IMAGE_LINES = 1_000_000
#: Own readers by format: a function from (files, config) to files with sections, language and read_error.
READERS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {}


def register_reader(extension: str, reader: Callable[[DataFrame, Config], DataFrame]) -> None:
    """Let ``reader`` convert files of a further extension (with its dot)."""
    READERS[extension.lower()] = reader


def _text(files: DataFrame, sections: Column, language: Column | None = None) -> DataFrame:
    return files.withColumn("sections", sections).withColumn("language", language if language is not None else F.lit("es")).withColumn("read_error", F.lit(None).cast("string"))


def _read(files: DataFrame, kind: str, config: Config) -> DataFrame:
    content = F.col("content")
    if kind == "text":
        return _text(files, plain.text_sections(decode_bytes(content), config))
    if kind == "markdown":
        return _text(files, plain.markdown_sections(decode_bytes(content)))
    if kind == "html":
        return read_html(files, decode_bytes(content), config).withColumn("read_error", F.lit(None).cast("string"))
    if kind == "csv":
        parsed = files.withColumn("__p", plain.parse_delimited(config.xlsx_max_rows, config.xlsx_max_cols)(decode_bytes(content), F.col("extension")))
        out = _text(parsed, plain.delimited_sections(F.col("__p"), config))
        return out.withColumn("read_error", F.when(F.col("__p.error").isNotNull(), "INFRA_CORRUPT_FILE")).drop("__p")
    parsed = files.withColumn("__p", office.parse_office(config)(content, F.col("extension")))
    out = office.clean_sections(_text(parsed, F.col("__p.sections")), "sections", config)
    return out.withColumn("read_error", F.col("__p.error")).drop("__p")


def convert(files: DataFrame, config: Config = DEFAULT, *, path: str = "path", content: str = "content", formats: tuple[str, ...] | None = None) -> DataFrame:
    """Files (path, content) to path, format, length, language, markdown and, where a file
    was refused or broken, error_code, error_layer and http_status. PDF files need a reader
    that is registered; see ``convert_pages`` for their words and tables. ``formats``: those
    that occur, where the caller knows them; the plan then has no branches for others."""
    own = list(READERS)
    src = route(files.select(F.col(path).alias("path"), F.col(content).alias("content")), F.col("path"))
    src = src.withColumn("format", F.when(F.col("extension").isin(own), F.col("extension")).otherwise(F.col("format"))) if own else src
    src = src.withColumn("length", F.length("content").cast("long"))
    zipped = F.col("format").isin("docx", "pptx", "xlsx")
    first = F.when(F.col("format").isNull() | ((F.col("format") == "pdf") & F.lit(".pdf" not in own)), "INFRA_UNSUPPORTED_FORMAT").when(too_large(F.col("length"), config), "INFRA_FILE_TOO_LARGE").when(bad_signature(F.col("content"), F.col("extension")), "INFRA_CORRUPT_FILE")
    src = src.withColumn("guard", first)
    index = zip_index(F.when(zipped & F.col("guard").isNull(), F.col("content")))
    src = src.withColumn("__i", index).withColumn("guard", F.coalesce("guard", F.when(zipped, zip_verdict(F.col("__i"), config)))).drop("__i")
    parts = [src.where(F.col("guard").isNotNull()).withColumn("sections", F.lit(None).cast(plain.SECTIONS)).withColumn("language", F.lit(None).cast("string")).withColumn("read_error", F.col("guard"))]
    good = src.where(F.col("guard").isNull())
    for kind, names in (("text", ["text"]), ("markdown", ["markdown"]), ("html", ["html"]), ("csv", ["csv"]), ("office", ["docx", "pptx", "xlsx"])):
        if formats is None or set(names) & set(formats):
            parts.append(_read(good.where(F.col("format").isin(names)), kind, config))
    parts += [reader(good.where(F.col("format") == x), config) for x, reader in READERS.items()]
    columns = ["path", "format", "length", "language", "sections", "read_error"]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    markdown = F.when(F.col("read_error").isNull(), render_sections(F.col("sections"), F.col("language"), config))
    return out.select("path", "format", "length", "language", markdown.alias("markdown"), *error_columns(F.col("read_error")))


def _recognised_lines(words: DataFrame, tables: DataFrame, lines: DataFrame, images: DataFrame, pages: DataFrame, recognised: DataFrame | None, config: Config) -> DataFrame:
    """Lines that images give: what was recognised on large ones without words of their own,
    or a notice where that could not be done; and of pages without words, if ``config.ocr``."""
    page = ["doc_id", "page"]
    blank = pages.select(*page).distinct().join(lines.select(*page).distinct(), page, "left_anti").join(tables.select(*page).distinct(), page, "left_anti")
    whole = recognised is not None and config.ocr
    shown = images.join(blank, page, "left_anti") if whole else images
    first = ocr.image_decisions(shown.select(*page, "img_ord", "x0", "top", "x1", "bottom"), words, pages, recogniser=recognised is not None, config=config)
    if "seconds" in images.columns:
        first = first.join(images.select(*page, "img_ord", "seconds"), [*page, "img_ord"])
        first = ocr.within_budget(first, F.coalesce("seconds", F.lit(0.0)), config)
    decided = first.join(images.select(*page, "img_ord", "x0", "top"), [*page, "img_ord"])
    reason = "instala Tesseract para activar el OCR" if recognised is None else "presupuesto de tiempo de OCR agotado"
    notice = F.concat(F.lit("[Imagen en la página "), F.col("page"), F.lit(f": su contenido no se pudo extraer — {reason}]"))
    own = F.lit(IMAGE_LINES).cast("long") + F.col("img_ord")
    line = lambda text, order, top, x0: [*page, order.cast("long").alias("line_ord"), text.alias("text"), F.lit(0.0).alias("size"), F.lit(False).alias("bold"), top.alias("top"), x0.alias("x0")]
    out = decided.where("decision = 'placeholder'").select(*line(notice, own * 1000, F.col("top"), F.col("x0")), own.cast("int").alias("block_ord"))
    if recognised is not None:
        read = ocr.words_to_lines(recognised.where("img_ord is not null"), [*page, "img_ord"], config).join(decided.where("decision = 'ocr'"), [*page, "img_ord"])
        text = strip(normalize_unicode(strip_private(F.col("line"), config)))
        out = out.unionByName(read.select(*line(text, own * 1000 + F.col("first_ord"), F.col("top"), F.col("x0")), own.cast("int").alias("block_ord")))
    if whole:
        read = ocr.words_to_lines(recognised.where("img_ord is null"), page, config).join(blank, page)
        read = read.withColumn("k", F.row_number().over(layout.Window.partitionBy(*page).orderBy("first_ord")) - 1)
        out = out.unionByName(layout.lines_to_paragraphs(read.select(*line(normalize_unicode(strip_private(F.col("line"), config)), F.col("k"), F.col("k").cast("double"), F.lit(0.0)))))
    return out.where("text <> ''")


def convert_pages(words: DataFrame, boxes: DataFrame, pages: DataFrame, config: Config = DEFAULT, *, images: DataFrame | None = None, recognised: DataFrame | None = None) -> DataFrame:
    """doc_id, markdown and error_code from the words, table candidates and pages of laid-out
    documents: tables are chosen and joined across pages, repeated lines go, headings are
    found by size, blocks become elements, elements Markdown. Words become lines page by page, and
    from there each document is one fold over its pages, so lines are dealt once and never written.
    Documents of more than ``pdf_max_pages`` pages are refused.

    ``images`` (doc_id, page, img_ord, x0, top, x1, bottom; ``pages`` then has width and height):
    large ones without words give the words of ``recognised`` (doc_id, page, img_ord, ord, text,
    conf, block_num, par_num, line_num; img_ord null: the whole page) or a notice. What an image
    takes, if it has ``seconds``, counts against the budget of its document."""
    counts = stage(pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")), "counts")
    long = stage(counts.where(F.col("pages") > config.pdf_max_pages).select("doc_id"), "refused")
    within = lambda df: df.join(long, "doc_id", "left_anti")
    words, boxes, pages = within(words), within(boxes), within(pages)
    tables = stage(page_tables.select_tables(boxes, config).where("verdict = 'accepted'"), "tables")
    outside = layout.words_outside_tables(words, tables)
    lines = words_to_page_lines(outside, config)
    if images is not None:
        flat = stage(lines.select("doc_id", "page", F.inline("lines")), "lines")
        more = _recognised_lines(outside, tables, flat, within(images), pages, None if recognised is None else within(recognised), config)
        order = ["line_ord", "text", "size", "bold", "top", "x0", "block_ord"]
        lines = flat.unionByName(more).groupBy("doc_id", "page").agg(F.collect_list(F.struct(*order)).cast(LINES).alias("lines"))
    made = documents_to_pieces(lines, tables, within(counts), config)
    part = lambda e: render_element(e, F.col("language"), config)
    parts = F.flatten(F.transform("pages", lambda p: F.transform(assemble.page_elements(p, F.col("language"), config), part)))
    done = made.select("doc_id", join_parts(parts).alias("markdown"), F.lit(None).cast("string").alias("error_code"))
    return done.unionByName(long.select("doc_id", F.lit(None).cast("string").alias("markdown"), F.lit("INFRA_FILE_TOO_LARGE").alias("error_code")))
