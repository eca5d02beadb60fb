"""Registered queries against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
from loomgraph.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})")
    assert len(db.sql(f"SELECT * FROM ({ORACLE_SQL[name]})").columns) == len(columns)
    assert got == Counter(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 200
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE_SQL) <= set(entry_point.oracle_sql())
