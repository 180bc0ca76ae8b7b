"""The corpus queries that have SQL give DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from vectide.llm import catalog

SF = "/root/testdata/sf0.001"


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=key)
