"""Every registered query runs on the smallest tables, and those with SQL agree with DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    result = duck.sql(SQL[name])
    at = [result.columns.index(c) for c in columns]
    assert len(result.columns) == len(columns)
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
