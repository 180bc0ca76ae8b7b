"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vectide.plans import catalog

SF = os.environ.get("VECTIDE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = ordered(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == ordered(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"kmeans_trained"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["word", "similarity"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
