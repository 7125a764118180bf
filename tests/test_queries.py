"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, FOLDER)
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    b = sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=repr)
    assert a == b


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    report = entry.entry(spark)
    assert report.count() == 40 and report.filter("score > 0").count() > 0
