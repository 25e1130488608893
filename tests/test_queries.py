"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from pointweave.plans import catalog
from pointweave.plans.registry import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, float) or "float" in type(x).__name__:
            return round(float(x), 9) + 0.0
        return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


def same(x, y):
    return len(x) == len(y) and all(a == b or all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6) for p, q in zip(a, b, strict=True)) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf, name):
    mine = catalog.queries()[name](spark, sf).toPandas()
    theirs = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert same(rows(mine), rows(theirs))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
