"""Every registered query with SQL against DuckDB on the smallest test tables."""

import glob
import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tools.check import fingerprint

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    cursor = db.execute(SQL[name])
    want = fingerprint([d[0] for d in cursor.description], cursor.fetchall())
    assert fingerprint(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == entry.entry(spark).columns and df.count() > 0
