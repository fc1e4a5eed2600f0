"""Scalar text functions against expected values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirestream.functions import markdown as M
from quirestream.functions import text as X


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (X.repair_cid, "espec(cid:237)ficos", "específicos"), (X.repair_cid, "a(cid:0)b", "ab"), (X.repair_cid, "(cid:65)(cid:999)", "A"),
        (X.title_case, "AVANCE DE PROYECTO FINAL 1", "Avance de Proyecto Final 1"), (X.title_case, "MODELO UML", "Modelo UML"), (X.title_case, "EVALUACIÓN PC2", "Evaluación PC2"), (X.title_case, "Ya mixto", "Ya mixto"),
        (lambda c: X.title_case(c, "en"), "A GUIDE TO THE FUTURE OF", "A Guide to the Future Of"),
        (X.punctuation_spacing, "aprendizaje , creatividad", "aprendizaje, creatividad"), (X.punctuation_spacing, "texto ( aclaración) fin", "texto (aclaración) fin"),
        (X.detect_language, "Hi", "es"), (X.detect_language, "the cat and the dog of this house were not in the garden", "en"), (X.is_all_caps, "N°7", True), (X.is_all_caps, "12", False),
        (X.clean_text, "  ﬁn de “cita”…​ ", 'fin de "cita"...'), (X.strip_private, "ab", "ab"), (X.line_key, " Página 12 de 30 ", "página # de #"),
        (M.escape, "esto *no* es `x_y`\\", "esto \\*no\\* es \\`x\\_y\\`\\\\"), (M.cell, "a|b\nc", "a\\|b c"),
        (M.inline, "Ver https://example.com/x.", "Ver [example.com](https://example.com/x)."), (M.inline, "https://a.b/c_d y *z*", "[a.b](https://a.b/c_d) y \\*z\\*"),
        (M.inline, "https://biblioteca.x.edu/y", "[Ver en biblioteca](https://biblioteca.x.edu/y)"), (lambda c: M.inline(c, "en"), "https://biblioteca.x.edu/y", "[View in library](https://biblioteca.x.edu/y)"),
    ],
)
def test_scalar(spark, function, given, expected):
    assert value(spark, function, given) == expected


def test_key_value(spark):
    t = "1.1 Carrera: Ingeniería de Software 1.2 Créditos: 4 1.3 Horas semanales: 4"
    assert value(spark, X.key_value_rows, t) == [["Campo", "Detalle"], ["1.1 Carrera", "Ingeniería de Software"], ["1.2 Créditos", "4"], ["1.3 Horas semanales", "4"]]
    assert value(spark, lambda c: X.key_value_rows(c, "en"), t)[0] == ["Field", "Detail"]
    assert value(spark, X.key_value_rows, "prosa: sin números") is None


def test_syllabus(spark):
    items = value(spark, X.syllabus_items, "Modelo de RUP. -Especificación de Requerimientos -Matriz")
    assert items == ["Modelo de RUP.", "Especificación de Requerimientos", "Matriz"]
    assert value(spark, X.syllabus_items, "una sola frase") is None


def test_join_lines(spark):
    df = spark.createDataFrame([(["palabra cor-", "tada , aquí", "Fin-", "Otra"],), ([],)], "l array<string>")
    assert [r[0] for r in df.select(X.join_lines(F.col("l"))).collect()] == ["palabra cortada, aquí Fin- Otra", ""]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("ñ".encode()),), (bytearray("ñ".encode("latin-1")),), (bytearray(b"\xef\xbb\xbfa"),)], "b binary")
    assert [r[0] for r in df.select(X.decode_bytes(F.col("b"))).collect()] == ["ñ", "ñ", "a"]


@pytest.mark.parametrize("function", [X.normalize_unicode, X.punctuation_spacing, X.collapse_blank, X.clean_text])
def test_idempotent(spark, function):
    t = "a ﬁ “b” , ( c )\t d  (cid:101)  …\n"
    assert value(spark, lambda c: function(function(c)), t) == value(spark, function, t)
