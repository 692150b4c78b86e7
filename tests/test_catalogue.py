"""Every query of the entry that has SQL, against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from verdigris.plans import catalogue

TABLES = "documents embeddings pages benchmark labels conversations part".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if x is None or x != x else str(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
