"""Every query with an SQL counterpart gives the same rows as DuckDB; the others give rows."""

import pytest
from compare_with_duckdb import compare, connect
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    verdict = compare(con, QUERIES[name](spark, SMALL), SQL[name])
    assert verdict.startswith("exact") and "types" not in verdict, verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 1
