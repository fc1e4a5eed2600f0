"""Convert one file on the driver's terms, and the command line.

``python -m quirestream INPUT [-o OUT]``: exit code 0 when something was converted, 1 for
an input that can't be used, 2 when all failed.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirestream import __version__
from quirestream.config import DEFAULT, Config
from quirestream.operators.guards import extension_of, format_of
from quirestream.plans.convert import convert as convert_files
from quirestream.sources.files import beside, discover, exit_code, output_names, write_markdown


class ConversionError(Exception):
    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


def convert(spark: SparkSession, source: bytes | str, config: Config = DEFAULT, *, filename: str | None = None) -> str:
    """Markdown of one file (a path, or bytes with a file name)."""
    if isinstance(source, bytes):
        if not filename:
            raise ValueError("bytes need a file name")
        files = spark.createDataFrame([(filename, bytearray(source))], "path string, content binary")
    else:
        files = spark.read.format("binaryFile").load(source)
    suffix = os.path.splitext(filename or str(source))[1].lower()
    kind = {".txt": "text", ".md": "markdown", ".htm": "html", ".tsv": "csv"}.get(suffix, suffix[1:])
    row = convert_files(files, config, formats=(kind,)).first()
    if row.error_code:
        raise ConversionError(row.error_code)
    return row.markdown


#: Flags of the command line: names, and what they do.
FLAGS = (
    (("-r", "--recursive"), "look for documents in subfolders, too"),
    (("--overwrite",), "replace files that are there"),
    (("--stdout",), "print instead of writing files"),
    (("-v", "--verbose"), "tell what is done"),
    (("--no-tables",), "leave tables out"),
    (("--no-headings",), "find no headings"),
    (("--no-bold",), "mark nothing bold"),
    (("--keep-repeated", "--no-remove-repeated"), "keep lines that repeat on pages"),
    (("--no-join", "--no-join-lines"), "keep lines as they are"),
    (("--single-column",), "read pages as one column"),
    (("--no-polish",), "leave titles, key-value paragraphs, lists and links as they are"),
    (("--page-markers",), "mark where pages begin"),
    (("--page-break",), "a rule between pages"),
    (("--ocr",), "recognise pages without text"),
    (("--no-ocr-images",), "leave images alone"),
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirestream")
    p.add_argument("input")
    p.add_argument("-o", "--output")
    for names, told in FLAGS:
        p.add_argument(*names, action="store_true", help=told)
    p.add_argument("--ocr-lang", default="spa")
    p.add_argument("--version", action="version", version=f"quirestream {__version__}")
    return p


def config_of(a: argparse.Namespace) -> Config:
    c = Config(extract_tables=not a.no_tables, detect_headings=not a.no_headings, mark_bold=not a.no_bold, join_lines=not a.no_join, remove_repeated=not a.keep_repeated, single_column=a.single_column, page_markers=a.page_markers, page_break=a.page_break, overwrite=a.overwrite, ocr=a.ocr, ocr_lang=a.ocr_lang, ocr_images=not a.no_ocr_images, verbose=a.verbose)
    return c.but(titlecase_headings=False, heading_strip_trailing_colon=False, heading_demote_title_block=False, merge_consecutive_headings=False, remove_furniture=False, kv_to_table=False, autolink_urls=False, temario_to_bullets=False) if a.no_polish else c


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if not os.path.exists(a.input):
        print(f"no such input: {a.input}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("quirestream").getOrCreate()
    config = config_of(a)
    source = os.path.abspath(a.input)
    files = discover(spark, source, recursive=a.recursive, config=config)
    # only the readers that the listing needs get into the plan
    kinds = tuple(r.k for r in files.select(format_of(extension_of(F.col("path"))).alias("k")).distinct().collect() if r.k)
    whole = os.path.isdir(source)
    folder, name = (a.output or source, None) if whole else os.path.split(source)
    if a.output and not whole:
        folder, name = (a.output, None) if os.path.isdir(a.output) else os.path.split(os.path.abspath(a.output))
    done = convert_files(files, config, formats=kinds)
    if whole and not a.output:
        done = done.withColumn("output", beside(F.col("path"), source))
    elif a.output and name:
        done = done.withColumn("output", F.lit(name))
    else:
        done = output_names(done, F.col("path"))
    done = done.persist()
    try:
        good = done.where(F.col("error_code").isNull())
        if a.stdout:
            for r in good.orderBy("path").select("markdown").toLocalIterator():
                sys.stdout.write(r.markdown)
        else:
            far = "://" in folder
            for r in write_markdown(good, folder if far else os.path.abspath(folder), overwrite=config.overwrite).orderBy("output").toLocalIterator():
                print(f"{r.status}: {r.output}")
        for r in done.where(F.col("error_code").isNotNull()).orderBy("path").select("path", "error_code").toLocalIterator():
            print(f"failed: {r.path}: {r.error_code}", file=sys.stderr)
        return exit_code(done)
    finally:
        done.unpersist()
