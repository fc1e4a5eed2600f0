"""The registered queries on the small tables: against SQL, against brute force, and the pipeline."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirestream.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    import duckdb

    from tools_compare import views

    con = duckdb.connect()
    views(con, DATA)
    return con


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_same_as_sql(spark, sql, name):
    from tools_compare import normal

    got, want = Q.queries()[name](spark, DATA).toPandas(), sql.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


@pytest.mark.parametrize("name", [n for n in Q.queries() if n not in Q.oracle_sql()])
def test_whole_table(spark, name):
    got = Q.queries()[name](spark, DATA)
    assert got.count() == (50 if name.startswith("op7") else 200)


def test_personal_data_is_brute_force(spark):
    import hashlib

    from tests.llm.test_small import brute_pii

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in Q.op5_personal_data(spark, DATA).collect():
        want = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")]


def test_repeats_are_brute_force(spark):
    from tests.llm.test_small import brute_repeats

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(texts, brute_repeats(list(texts.values())), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op6_repeated_substrings(spark, DATA).collect()} == want


def test_pipeline(spark):
    """Each stage by its operator alone: what it keeps, and that it changes nothing else."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "source_mixing"]
    from tests.llm.test_small import brute_components, brute_hits

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, step in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = step(spark, docs, DATA)
        if name != "source_mixing":
            assert out.columns == docs.columns
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "language_id":
            assert len(after) >= 0.95 * len(before) and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            pages = Counter(r.source for r in before.values())
            seen = Counter((r.source, x) for r in before.values() for x in {y.strip(" \t\r") for y in r.text.split("\n")} - {""})
            for i, r in before.items():
                kept = [x for x in r.text.split("\n") if not (seen[r.source, x.strip(" \t\r")] >= 2 and seen[r.source, x.strip(" \t\r")] > 0.2 * pages[r.source])]
                assert after[i].text == "\n".join(kept) and after[i].n_chars == len(after[i].text)
        elif name == "ngram_jaccard_join":
            assert set(after) == {c for _, c in brute_components([(i, r.text) for i, r in before.items()]).values()}
        elif name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not brute_hits(r.text, items)[3]}
        else:
            assert set(after) == set(before)
        docs = out.select(*docs.columns).cache() if name != "source_mixing" else out
    assert {r.doc_id: r.taken for r in C.run(spark, DATA).collect()} == {r.doc_id: r.taken for r in docs.collect()}


def test_odd_rows_in_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    schema = "doc_id long, text string, lang string, source string, n_chars long, host string"
    rows = [(1, "the cat sat on the mat", "en", "a", 22, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 0, None), (None, "the dog ran to the house", "en", None, 24, None), (1, "the cat sat on the mat", "en", "a", 22, "x"), (5, "der hund lief in das haus", "de", "b", 25, "y")]
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = C.run(spark, str(tmp_path / name)).collect()
        assert len(out) <= len(some)
