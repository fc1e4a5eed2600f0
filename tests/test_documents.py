"""Whole laid-out documents: the folds over pages and documents against the operators one by one."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.config import DEFAULT
from quirestream.functions.markdown import join_parts, render_element
from quirestream.functions.text import detect_language
from quirestream.operators import assemble, layout, page_tables
from quirestream.operators.documents import rounded
from quirestream.operators.lines import words_to_page_lines
from quirestream.plans.convert import convert_pages

WORD = "doc_id long, page int, word_ord int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string"
BOX = "doc_id long, page int, tbl_ord int, x0 double, top double, x1 double, bottom double, rows array<array<string>>"
TEXTS = ["the", "and", "of", "for", "que", "más", "TEMARIO", "AVISO", "COVER", "1.", "2)", "1.1", "a:", "x.", "fin:", "-", "• uno", "Página 7", "Ⅳ", "ǅ", "٣", " ", "http://biblioteca.x/y_z).", "pro-", "İx", "Σ", "*b*", "a|b", "🙂", "1.2 b: c 1.3 d: e 1.4 f: g", "", "Uno. Dos. Tres"]


def rows(seed: int, documents: int = 60) -> tuple[list, list]:
    r = random.Random(seed)
    words, boxes = [], []
    for doc in range(documents):
        for page in sorted(r.sample(range(1, 9), r.randint(1, 6))):
            n = r.choice([0, 1, 3, 40, 90])
            for i in range(n):
                top = r.choice([0.0, 12.0, 24.0, 24.0, 60.0, 74.0, 90.5, 140.0]) + r.choice([0.0, 0.0, 0.9, 1.9, 2.1])
                text = TEXTS[i % 4] if page % 2 and top < 3 and doc % 2 else r.choice(TEXTS)
                size = r.choice([10.0, 10.0, 10.05, 10.15, 10.25, 12.0, 12.5, 18.0, 20.0, 22.0, 26.0])
                place = [x if r.random() > 0.004 else None for x in (r.choice([0.0, 50.0, 100.0, 150.0]), 30.0, top, top + r.choice([8.0, 10.0, 30.0]), size)]
                words.append((doc, page, r.randint(0, 20), text if r.random() > 0.01 else None, place[0], (place[0] or 0.0) + 40.0, place[2], place[3], place[4], r.choice(["Arial", "Arial-Bold", "Semibold", None])))
            for k in range(r.choice([0, 0, 1, 2, 4])):
                x, y, wide, high = r.choice([0.0, 60.0, 400.0]), r.choice([-20.0, 20.0, 70.0, 300.0]), r.randint(2, 5), r.randint(1, 4)
                cells = [[r.choice(["3", "", "presentac ón", "n " + str(a), "--", "• x", "a  , b"]) for _ in range(wide)] for a in range(high)]
                if r.random() < 0.3:
                    cells[0] = ["", ""] + ["4,5"] * max(wide - 2, 0)
                boxes.append((doc, page, k, x, y, x + r.choice([50.0, 200.0]), y + r.choice([15.0, 60.0]), cells))
    return words, boxes


def by_rows(words, boxes, pages, config):
    """The conversion with a row for each line and piece."""
    tables = page_tables.select_tables(boxes, config).where("verdict = 'accepted'").localCheckpoint()
    lines = layout.lines_to_paragraphs(layout.words_to_lines(layout.words_outside_tables(words, tables), config)).localCheckpoint()
    text = lines.groupBy("doc_id", "page", "block_ord").agg(F.min("top").alias("top")).select("doc_id", "page", F.lit("text").alias("kind"), "block_ord", "top", F.lit(None).cast("array<array<string>>").alias("rows"))
    found = tables.select("doc_id", "page", F.lit("table").alias("kind"), F.col("tbl_ord").alias("block_ord"), "top", "rows")
    order = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("top", F.col("kind") == "table", "own_ord")) - 1
    blocks = text.unionByName(found).withColumnRenamed("block_ord", "own_ord").withColumn("block_ord", order.cast("int")).localCheckpoint()
    grown = page_tables.merge_across_pages(blocks, config)
    kept = layout.remove_repeated(lines, pages, config).where(~layout.is_junk(F.col("text"), config)).localCheckpoint()
    kept = layout.assign_headings(kept, config).localCheckpoint()
    lang = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "top", "line_ord", "text"))), lambda x: x["text"]), " ").alias("t")).select("doc_id", detect_language(F.col("t")).alias("language"))
    each = kept.groupBy("doc_id", "page", F.col("block_ord").alias("own_ord")).agg(F.array_sort(F.collect_list(F.struct("top", "line_ord", "text", F.col("heading_level").alias("level"), "bold"))).alias("lines"))
    texts = blocks.where("kind = 'text'").select("doc_id", "page", "own_ord", "block_ord").join(each, ["doc_id", "page", "own_ord"])
    texts = texts.select("doc_id", "page", "block_ord", F.lit("text").alias("kind"), "lines", F.lit(None).cast("array<array<string>>").alias("rows"))
    lined = grown.where("kind = 'table'").select("doc_id", "page", "block_ord", "kind", F.lit(None).cast(texts.schema["lines"].dataType).alias("lines"), "rows")
    made = assemble.blocks_to_pieces(texts.unionByName(lined), config).join(lang, "doc_id", "left")
    elements = assemble.pieces_to_elements(made, F.coalesce("language", F.lit("es")), config)
    part = render_element(F.col("element"), F.coalesce(F.col("language"), F.lit("es")), config)
    parts = elements.withColumn("part", part).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "elem_ord", "part"))), lambda x: x["part"]).alias("parts"))
    return {r.doc_id: r.markdown for r in parts.select("doc_id", join_parts(F.col("parts")).alias("markdown")).collect()}


OTHER = replace(DEFAULT, remove_repeated=False, heading_demote_title_block=False, merge_tables_across_pages=False, remove_furniture=False, join_lines=False, mark_bold=False, table_min_cols=2)


@pytest.mark.parametrize(("seed", "config"), [(1, DEFAULT), (2, DEFAULT), (3, OTHER), (4, replace(DEFAULT, detect_headings=False, table_min_cols=2))])
def test_documents_as_by_rows(spark, seed, config):
    words, boxes = (spark.createDataFrame(x, schema) for x, schema in zip(rows(seed), (WORD, BOX), strict=True))
    pages = words.select("doc_id", "page").union(boxes.select("doc_id", "page")).distinct()
    got = {r.doc_id: r.markdown for r in convert_pages(words, boxes, pages, config).collect()}
    expected = by_rows(words, boxes, pages, config)
    assert len(got) > 40 and got.keys() == expected.keys()
    assert [k for k in got if got[k] != expected[k]] == []


def test_page_lines_as_by_rows(spark):
    """Also where a page has more words than a batch, and pages cross batches."""
    words = spark.createDataFrame(rows(5)[0], WORD)
    expected = sorted(layout.lines_to_paragraphs(layout.words_to_lines(words)).collect(), key=lambda r: (r.doc_id, r.page, r.line_ord))
    for size in ("7", "50", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = words_to_page_lines(words).select("doc_id", "page", F.inline("lines")).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        names = ("doc_id", "page", "line_ord", "text", "size", "bold", "top", "x0", "block_ord")
        assert [[r[n] for n in names] for r in sorted(got, key=lambda r: (r.doc_id, r.page, r.line_ord))] == [[r[n] for n in names] for r in expected]


def test_sizes_are_rounded_as_bround(spark):
    sizes = [10.05, 10.15, 10.25, 10.35, 0.05, 12.0, 1e-7, 123456.75]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s double")
    assert [rounded(s) for s in sizes] == [r.b for r in df.select("i", F.bround("s", 1).alias("b")).orderBy("i").collect()]


def test_words_and_lines_are_dealt_as_pages(spark):
    """From words to Markdown no row stands for a line or piece: words are laid page by page, documents dealt once."""
    words, boxes = (spark.createDataFrame(x, schema) for x, schema in zip(rows(6, 3), (WORD, BOX), strict=True))
    pages = words.select("doc_id", "page").distinct()
    plan = convert_pages(words, boxes, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "FlatMapGroups" not in plan  # 2 FlatMapGroupsInPandas before
