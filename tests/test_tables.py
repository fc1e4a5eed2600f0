"""Table shaping against expected values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirestream.config import DEFAULT
from quirestream.functions import tables as T
from quirestream.operators import cells as C
from quirestream.operators.page_tables import grow


def rows(spark, function, table):
    return spark.createDataFrame([(table,)], "r array<array<string>>").select(function(F.col("r"))).first()[0]


def test_trim_and_errors(spark):
    assert rows(spark, T.clean_csv, [["a", "", "#N/A"], ["", ""], ["b"]]) == [["a"], ["b"]]
    assert rows(spark, T.trim_empty, [["", ""]]) == []
    assert rows(spark, T.trim_empty, []) == []
    once = rows(spark, T.trim_empty, [["x", "", "y"], ["", "", "z"]])
    assert once == rows(spark, T.trim_empty, once) == [["x", "y"], ["", "z"]]


def test_zero_only(spark):
    assert rows(spark, T.drop_zero_only, [["0", "a"], ["0,0", "0"], ["", "b"]]) == [["a"], ["b"]]


def sheet(spark, table, config=DEFAULT):
    return T.clean_sheets(spark.createDataFrame([(table,)], "r array<array<string>>"), "r", config).first()[0]


def test_dead_tail(spark):
    real = [["N°", "Name", "Value"], ["1", "a", "5"], ["2", "b", "6"]]
    tail = [[str(i), "", "0"] for i in range(3, 43)]
    assert sheet(spark, real + tail) == real
    numbers = [[str(i)] for i in range(1, 31)]
    assert sheet(spark, numbers) == numbers


def test_wide_layout(spark):
    head = [["Task", "Owner", "Days"] + [""] * 40]
    body = [[f"t{i}", "x", str(i + 1)] + ["1" if i == d else "" for d in range(40)] for i in range(40)]
    out = sheet(spark, head + body)
    assert {len(r) for r in out} == {3}
    assert len(out) == 41


def test_counters(spark):
    df = spark.createDataFrame([(["n", "1", "2", "3"],), (["1", "3", "2"],), (["1", "2"],), (["a", "b", "1", "2", "3"],), (["nan", "1", "2", "3"],)], "c array<string>")
    assert [r[0] for r in df.select(T.is_counter(F.col("c"))).collect()] == [True, False, False, True, True]


def test_scores(spark):
    table = [["Criterio", "Def", "nivel A", "nivel B"], ["", "", "5", "3"], ["--", "---", "", "--"]]
    assert rows(spark, T.polish, table) == [["Criterio", "Def", "nivel A **(5)**", "nivel B **(3)**"]]
    got = spark.createDataFrame([(["Criterio", "Def", "nivel A", "nivel B"], ["5", "3"])], "r array<string>, s array<string>").select(T.append_scores(F.col("r"), F.col("s"))).first()[0]
    assert got == ["Criterio", "Def", "nivel A **(5)**", "nivel B **(3)**"]


def test_split_words(spark):
    df = spark.createDataFrame([("presentac ió n",), ("desarrollo de",), ("conocimient o s",)], "c string")
    assert [r[0] for r in df.select(T.join_split_words(F.col("c"))).collect()] == ["presentació n", "desarrollo de", "conocimiento s"]


def test_shapes(spark):
    good = [["Fase", "Fecha"], ["a", "1"], ["b", "2"], ["c", "3"]]
    bullets = [["", "• uno"], ["", "• dos"], ["", "tres"]]
    df = spark.createDataFrame([(good,), (bullets,), ([],)], "r array<array<string>>").select(T.is_clean_data_table(F.col("r")), T.is_bullet_list(F.col("r")))
    assert [tuple(r) for r in df.collect()] == [(True, False), (False, True), (False, False)]


def test_long_form_is_array_form(spark):
    table = [["k", "", "v", "0"], ["", "", "", ""], ["1", "", "x", "0"], ["2", "", "", "0,0"], ["3", "", "", ""]]
    cells = spark.createDataFrame([(1, i, j, c) for i, r in enumerate(table) for j, c in enumerate(r)], "tbl long, row_ord int, col_ord int, cell string")
    for long, array in ((C.trim_empty, T.trim_empty), (C.drop_zero_only, T.drop_zero_only), (C.trim_dead_tail, T.trim_dead_tail)):
        assert C.to_rows(long(cells)).first()["rows"] == rows(spark, array, table)


def test_tables_grow_across_pages():
    table = lambda *r: {"kind": "table", "rows": [list(x) for x in r]}
    text = {"kind": "text", "rows": []}
    pages = [[text, table(("a", "b", "c", "d"), ("1", "2", "x", "y"))], [table(("", "", "5", "3"))], [], [table(("a", "b", "c", "d"), ("3", "4", "5", "6"))], [table(("7", "8"))], [text]]
    out = grow(pages, DEFAULT)
    assert [len(p) for p in out] == [2, 0, 0, 0, 0, 1]
    assert out[0][1]["rows"] == [["a", "b", "c", "d"], ["1", "2", "x **(5)**", "y **(3)**"], ["3", "4", "5", "6"], ["", "", "7", "8"]]
