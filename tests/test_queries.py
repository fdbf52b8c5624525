"""Every registered query with SQL, held against DuckDB."""

from __future__ import annotations

import pytest
from oracle import connect, of_duckdb, of_spark

from lanewise.plans import memory_queries, vector_queries

DATA = "/root/testdata/sf0.01"
QUERIES = memory_queries.QUERIES | vector_queries.QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query(spark, con, name):
    run, sql = QUERIES[name]
    (columns, got), (want_columns, want) = of_spark(run(spark, DATA)), of_duckdb(con, sql)
    assert columns == want_columns
    assert len(got) == len(want) and got == want


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_rows_only(spark, name):
    assert QUERIES[name][0](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
