"""Every registered conversion query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from glyphflow import queries as conversion


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(conversion.oracle_sql()))
def test_query(spark, sf, db, name):
    df, want = conversion.queries()[name](spark, sf), db.sql(conversion.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(conversion.queries()) - set(conversion.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert conversion.queries()[name](spark, sf).count() > 0


def test_html_round_trip_gives_the_text_back(spark, sf):
    got = {r["page_id"]: r["html"] for r in conversion.html_round_trip(spark, sf).collect()}
    want = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html

    assert {k: html.unescape(v) for k, v in got.items()} == {k: html.unescape(v) for k, v in want.items()}


def test_entry(spark):
    assert set(conversion.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
