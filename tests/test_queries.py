"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from lexmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 5)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in catalogue.SQL:
        return
    found = oracle.sql(catalogue.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
