"""Registered queries against their SQL on the smallest tables, and the entry module alone."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from quirestream import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    import duckdb

    from tools_compare import views

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    views(con, DATA)
    return con


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_same_as_sql(spark, sql, name):
    from tools_compare import normal

    got, want = catalogue.queries()[name](spark, DATA).toPandas(), sql.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in catalogue.oracle_sql()])
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
