"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from docloom.plans.all import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "isoformat"):
        return str(value)
    return value


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = db.sql(ORACLE_SQL[name])
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    got = sorted((tuple(map(plain, row)) for row in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
