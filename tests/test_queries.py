"""Every query with SQL against DuckDB on the smallest tables; the others run and keep their schema."""

import math
import os

import duckdb
import pytest

from dotgrain.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    ours = sorted(tuple(str(plain(r[c])) for c in names) for r in df.collect())
    assert ours == sorted(tuple(str(plain(r[i])) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
