"""Every named query with SQL against DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
# these run for a while; check.py covers them
SLOW = {"tokenizer_grid", "unigram_vocab", "unigram_roundtrip"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
