"""Layout, guards, limits: against folds in plain Python or expected values."""

from __future__ import annotations

from collections import deque

import pytest
from pyspark.sql import functions as F

from quirestream.config import DEFAULT
from quirestream.functions import tables
from quirestream.functions.markdown import element
from quirestream.operators import assemble, guards, layout, ocr, page_tables
from quirestream.streaming import limits

LINE = "doc_id long, page int, line_ord int, text string, size double, bold boolean, top double, x0 double"


def test_line_fold_is_by_anchor(spark):
    rows = [(1, 1, i, f"w{i}", float(i), cy - 2.5, cy + 2.5, 10.0, "Arial-Bold" if i else "Arial") for i, cy in enumerate([0, 1.5, 3.0, 3.1])]
    w = spark.createDataFrame(rows, "doc_id long, page int, word_ord int, text string, x0 double, top double, bottom double, size double, fontname string")
    got = {r.line_ord: (r.text, r.bold) for r in layout.words_to_lines(w).collect()}
    assert got == {0: ("w0 w1", False), 1: ("w2 w3", True)}


def test_order_of_input_is_nothing(spark):
    rows = [(1, p, i, f"w{i}", float(i % 7), float(i // 7 * 12), float(i // 7 * 12 + 10), 10.0, "A") for p in (1, 2) for i in range(50)]
    schema = "doc_id long, page int, word_ord int, text string, x0 double, top double, bottom double, size double, fontname string"
    a = layout.words_to_lines(spark.createDataFrame(rows, schema)).collect()
    b = layout.words_to_lines(spark.createDataFrame(rows[::-1], schema).repartition(7)).collect()
    assert sorted(a) == sorted(b)


def test_repeated_lines(spark):
    rows = [(1, p, i, t, 10.0, False, i * 12.0, 0.0) for p in range(1, 5) for i, t in enumerate([f"Página {p}", "cuerpo de texto " + "abcd"[p - 1], "x", "y", "z", "Pie común", "fin " + "abcd"[p - 1]])]
    lines = spark.createDataFrame(rows, LINE)
    left = {r.text for r in layout.remove_repeated(lines, lines.select("doc_id", "page").distinct()).collect()}
    assert "Pie común" not in left and "Página 1" not in left and "cuerpo de texto a" in left


def test_headings(spark):
    rows = [(1, 1, 0, "SÍLABO", 20.0, True, 0.0, 0.0), (1, 1, 1, "Curso", 20.0, True, 20.0, 0.0), (1, 1, 2, "texto normal aquí", 10.0, False, 40.0, 0.0), (1, 1, 3, "1. Tema:", 10.0, True, 60.0, 0.0), (1, 1, 4, "más texto normal", 10.0, False, 80.0, 0.0)]
    got = lambda c: [r.heading_level for r in layout.assign_headings(spark.createDataFrame(rows, LINE), c).orderBy("line_ord").collect()]
    assert got(DEFAULT.but(heading_demote_title_block=False)) == [1, 1, 0, 2, 0]
    assert got(DEFAULT) == [-1, 0, 0, 2, 0]


def test_furniture(spark):
    for text, kept in (("COVER", False), ("Bibliografía", True), ("AVISO.", True)):
        df = spark.createDataFrame([(1, 1, 0, text), (1, 1, 1, "T")], "doc_id long, page int, elem_ord int, t string")
        e = df.select("doc_id", "page", "elem_ord", F.when(F.col("elem_ord") == 1, element("heading", level=F.lit(1), text=F.col("t"))).otherwise(element("paragraph", text=F.col("t"))).alias("element"))
        assert (layout.furniture_labels(e).count() == 2) is kept


def test_pieces():
    got = assemble.pieces([("Gran", 2, True), ("título", 2, True), ("texto", 0, True), ("más", 0, False), ("• uno", 0, False), ("sigue", 0, False), ("• dos", 0, False), ("3. Otro", 2, True)], DEFAULT)
    assert [(p["kind"], p["parts"]) for p in got] == [("heading", [["Gran"], ["título"]]), ("paragraph", [["texto", "más"]]), ("list", [["uno", "sigue"], ["dos"]]), ("heading", [["3. Otro"]])]


def test_ocr(spark):
    w = spark.createDataFrame([(1, 0, "Fase", 92.0, 1, 1, 1), (1, 1, "ruido", 5.0, 1, 1, 1), (1, 2, "Real", 60.0, 1, 1, 1)], "img long, ord int, text string, conf double, block_num int, par_num int, line_num int")
    assert ocr.words_to_lines(w, ["img"]).first()["line"] == "Fase Real"
    images = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 160.0, 1000.0), (1, 1, 1, 0.0, 0.0, 800.0, 1000.0), (1, 1, 2, 0.0, 0.0, 10.0, 10.0)], "doc_id long, page int, img_ord int, x0 double, top double, x1 double, bottom double")
    none = spark.createDataFrame([], "doc_id long, page int, x0 double, top double, x1 double, bottom double")
    pages = spark.createDataFrame([(1, 1, 800.0, 1000.0)], "doc_id long, page int, width double, height double")
    for there, expected in ((False, ["skip", "placeholder", "small"]), (True, ["ocr", "ocr", "small"])):
        assert [r.decision for r in ocr.image_decisions(images, none, pages, recogniser=there).orderBy("img_ord").collect()] == expected


def test_ocr_budget(spark):
    rows = [(1, 1, i, 0.6 if i == 3 else 0.2, "small" if i == 1 else "ocr") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, page int, img_ord int, area_ratio double, decision string")
    got = ocr.within_budget(df, F.lit(2.0)).orderBy("img_ord")
    assert [r.decision for r in got.collect()] == ["ocr", "small", "ocr", "placeholder", "skip"]


def test_serving_rules(spark):
    df = spark.createDataFrame([('a"b\r\n\\c/d', "1.2.3.4, 5.6.7.8", "https://x.y/", "k"), ("   ...   ", "", None, None)], "n string, f string, o string, k string")
    got = df.select(guards.safe_stem(F.col("n")), guards.client_ip(F.col("f"), F.lit("9.9.9.9")), guards.origin_allowed(F.col("o"), ["https://x.y"]), guards.key_matches(F.col("k"), "k")).collect()
    assert [tuple(r) for r in got] == [("abcd", "1.2.3.4", True, True), ("documento", "9.9.9.9", True, False)]
    assert df.select(guards.content_disposition(F.lit("año 1"))).first()[0] == "attachment; filename=\"a_o 1.md\"; filename*=UTF-8''a%C3%B1o%201.md"


def replay(events, per_key, total, window):
    marks, own, out = deque(), {}, {}
    for t, o, k in sorted(events):
        while marks and marks[0] <= t - window:
            marks.popleft()
        q = own.setdefault(k, deque())
        while q and q[0] <= t - window:
            q.popleft()
        if len(marks) >= total:
            out[o] = window - (t - marks[0])
        elif len(q) >= per_key:
            out[o] = window - (t - q[0])
        else:
            marks.append(t)
            q.append(t)
            out[o] = None
    return out


@pytest.fixture(scope="module")
def events(spark):
    rows = [(float(i * 7 % 500), i, i * i % 5) for i in range(400)]
    return rows, spark.createDataFrame(rows, "t double, event_id long, user_id long")


def test_limit_all(events):
    rows, df = events
    got = {r.event_id: r.retry_after for r in limits.limit_all(df, "user_id", F.col("t"), "event_id", per_key=3, total=10, window=20.0).collect()}
    assert got == replay(rows, 3, 10, 20.0)


def test_limit_by_key_batch_and_stream(spark, events, tmp_path):
    rows, df = events
    got = {r.event_id: r.retry_after for r in limits.limit_by_key(df, "user_id", F.col("t"), "event_id", most=3, window=20.0).collect()}
    assert got == replay(rows, 3, 10**9, 20.0)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limits.limit_stream(stream, "user_id", F.col("t"), "event_id", most=3, window=20.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.retry_after for r in spark.sql("select * from limited").collect()} == got


def test_tables_are_not_tidied_for_each_mention(spark):
    """A filter on the verdict does not compute the cells anew for each mention of them."""
    box = [F.lit(float(i)).alias(n) for i, n in enumerate(("x0", "top", "x1", "bottom"))]
    boxes = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("tbl_ord"), *box, F.array(F.array(F.col("id").cast("string"), F.lit("b")), F.array(F.lit("c"), F.lit("d"))).alias("rows"))
    cleaned = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("cid:")
    once = cleaned(boxes.select(tables.tidy(F.col("rows"))))
    accepted = page_tables.select_tables(boxes).where("verdict = 'accepted'")
    assert once and cleaned(accepted) <= 2 * once  # nine times before
    assert sorted(r.doc_id for r in accepted.collect()) == sorted(r.doc_id for r in page_tables.select_tables(boxes).collect() if r.verdict == "accepted")
