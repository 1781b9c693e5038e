"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from leadweave.workload import fixtures, oracle, queries

SF_DIR = os.environ.get("LEADWEAVE_TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries.QUERIES, oracle.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in fixtures.GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, values.itertuples(index=False, name=None)))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    got = rows(QUERIES[name](spark, SF_DIR).toPandas())
    assert got[1], "no rows"
    assert got == rows(engine.execute(SQL[name]).df())


def test_entry(spark):
    df = contract.entry(spark)
    scores = [r["score"] for r in df.collect()]
    assert scores and scores == sorted(scores, reverse=True)
