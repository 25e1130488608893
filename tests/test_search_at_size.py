"""Searches of near points over six times the parts of sf0.1: each is stopped, and fails, when it takes too long."""

import threading

import duckdb
import numpy as np
import pytest

from pointweave.plans import catalog

PARTS, SECONDS = 120_000, 90


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("six")
    spark.range(PARTS).selectExpr("id AS p_partkey", "CAST(id * 7 % 50 + 1 AS INT) AS p_size").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def answered(spark, name, folder):
    sc = spark.sparkContext
    sc.setJobGroup(name, name, interruptOnCancel=True)
    stop = threading.Timer(SECONDS, sc.cancelJobGroup, [name])
    stop.start()
    try:
        return catalog.queries()[name](spark, folder).toPandas()
    finally:
        stop.cancel()
        sc._jsc.sc().clearJobGroup()


def mean_of_three(gids):
    """By all pairs, in whole tenths; no two of these points share a position."""
    key = np.arange(PARTS)
    at = np.stack([key * 37 % 101, key * 53 % 97, key * 71 % 89], axis=1)
    return [np.sort(((at - at[g]) ** 2).sum(1))[1:4].mean() / 100 for g in gids]


def test_starts_at_size(spark, parts):
    got = answered(spark, "initial_points", parts).set_index("gid")["scale"]
    some = range(0, PARTS, 400)
    assert sorted(got.index) == list(range(PARTS))
    assert np.allclose(got[list(some)], np.log(np.sqrt(mean_of_three(some))), atol=1e-6, rtol=0)


def test_mean_distances_at_size(spark, parts):
    got = answered(spark, "knn_mean3", parts).set_index("gid")["mean_d2"]
    some = range(0, PARTS, 400)
    assert sorted(got.index) == list(range(PARTS))
    assert np.allclose(got[list(some)], mean_of_three(some), atol=1e-6, rtol=0)


def test_fill_at_size(spark, parts):
    got = answered(spark, "nearest_fill", parts)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{parts}/part.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["nearest_fill"]).fetchall()
    assert sorted(got[["gid", "d2"]].itertuples(index=False, name=None)) == sorted(want)
