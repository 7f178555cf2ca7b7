"""Queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from docloom.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted((tuple(row) for row in df.select(*names).collect()), key=repr) == sorted((tuple(row[i] for i in at) for row in want.fetchall()), key=repr)
