"""Iterated codebook builders against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import codebook as cb


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-8)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    v = unit(rng.standard_normal((90, 6)) + 2 * rng.standard_normal((4, 6))[rng.integers(0, 4, 90)])
    w = rng.integers(1, 4, 90).astype(float)
    df = spark.createDataFrame([(i, v[i].tolist(), float(w[i])) for i in range(90)], "gid bigint, vec array<double>, w double").cache()
    return df, v, w


def plain_kmeans(v, codes, rounds, w=None, keep=True):
    w = np.ones(len(v)) if w is None else w
    codes = codes.copy()
    for _ in range(rounds):
        at = (v @ codes.T).argmax(1)
        score = (v @ codes.T).max(1)
        empty = [j for j in range(len(codes)) if not (at == j).any()]
        for j in set(range(len(codes))) - set(empty):
            codes[j] = unit((v[at == j] * w[at == j, None]).sum(0))
        if empty and not keep:
            for j, i in zip(empty, np.argsort(score, kind="stable"), strict=False):
                codes[j] = unit(v[i])
    return codes


def table(df, key="code_id"):
    return {r[key]: np.array(r["vec"]) for r in df.collect()}


def test_farthest_first(spark, cloud):
    df, v, _ = cloud
    got = table(cb.farthest_first(df, 5))
    start = next(i for i in range(90) if np.allclose(v[i], got[0]))
    chosen = [start]
    for _ in range(4):
        chosen.append(int((1 - (v @ v[chosen].T).max(1)).argmax()))
    assert np.allclose([got[i] for i in range(5)], v[chosen])
    codes = table(cb.kmeans(df, 5, 4, init=cb.farthest_first(df, 5)))
    assert np.allclose([codes[i] for i in range(5)], plain_kmeans(v, v[chosen], 4))
    assert cb.farthest_first(df, 200).count() == 90


def test_as_many_codes_as_points(spark, cloud):
    df, v, _ = cloud
    few = df.where("gid < 7")
    assert np.allclose([*table(cb.kmeans(few, 7, 3)).values()], v[:7])
    assert np.allclose([*table(cb.kmeans(few, 9, 3, spherical=False)).values()], v[:7])


def test_residual_spherical(spark, cloud):
    df, v, w = cloud
    codes, ids, rebuilt = cb.residual_spherical(df, [4, 4], 3, "w")
    left, total = v.copy(), np.zeros_like(v)
    for level in range(2):
        book = plain_kmeans(left, unit(left[:4]), 3, w, keep=False)
        at = (left @ book.T).argmax(1)
        got = {r["gid"]: r["code_id"] for r in ids.where(F.col("level") == level).collect()}
        assert [got[i] for i in range(90)] == at.tolist()
        total = unit(total + book[at])
        left = unit(v - (v * total).sum(1, keepdims=True) * total)
    got = table(rebuilt, "gid")
    assert np.allclose([got[i] for i in range(90)], total)
    assert codes.count() == 8


def test_adaptive_codebook(spark, cloud):
    df, v, _ = cloud
    codes, rows, histogram = cb.adaptive_codebook(df, 6, 3, 3, 0.002, 0.97)
    n = {}
    for r in rows.collect():
        n[r["gid"]] = n.get(r["gid"], 0) + 1
    assert {r["slots"]: r["points"] for r in histogram.collect()} == {k: list(n.values()).count(k) for k in set(n.values())}
    assert codes.count() == 6 and set(n) == set(range(90))
    again = cb.adaptive_codebook(df, 6, 3, 3, 0.002, 0.97, codes=codes)[2]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in histogram.collect()}


def test_extension(spark, cloud):
    df, v, _ = cloud
    codes = cb.kmeans(df, 4, 3)
    book = table(codes)
    slots = cb.nearest_code(df, codes).select("gid", "code_id", F.lit(255).alias("weight"))
    ext = cb.learn_extension(df, slots, codes, 5, 3)
    more = table(ext)
    assert sorted(more) == [4, 5, 6, 7, 8]
    now = np.array([book[i] for i in range(4)])[(v @ np.array([book[i] for i in range(4)]).T).argmax(1)]
    left = unit(v - now)
    assert np.allclose([more[i] for i in range(4, 9)], plain_kmeans(left, left[:5], 3, keep=False))
    e = np.array([more[i] for i in range(4, 9)])
    at = (left @ e.T).argmax(1)
    coef = np.clip(((v - now) * e[at]).sum(1), 0, 1)
    old, new = (v * now).sum(1), (v * unit(now + coef[:, None] * e[at])).sum(1)
    for r in cb.extend_codes(df, slots, codes, ext, 0.01).collect():
        i = r["gid"]
        good = coef[i] > 1e-6 and new[i] - old[i] >= 0.01
        assert (r["code_id"], r["accepted"]) == (at[i] + 4, good)
        assert abs(r["coefficient"] - coef[i]) < 1e-9 and abs(r["cosine"] - (new[i] if good else old[i])) < 1e-9


def test_hierarchy(spark, cloud):
    df, v, _ = cloud
    top, book, own = cb.hierarchical_codebook(df, 3, 4, 3)
    coarse = table(top)
    parent = {r["gid"]: r["parent"] for r in own.collect()}
    assert [parent[i] for i in range(90)] == (v @ np.array([coarse[j] for j in range(3)]).T).argmax(1).tolist()
    rows = book.orderBy("code_id").collect()
    assert [r["code_id"] for r in rows] == list(range(len(rows)))
    for p in range(3):
        mine = v[[i for i in range(90) if parent[i] == p]]
        assert np.allclose([r["vec"] for r in rows if r["parent"] == p], plain_kmeans(mine, mine[:4], 3))


def test_bank_takes_alike_of_each_source(spark, cloud):
    df, _, _ = cloud
    rows = df.withColumn("view", (F.col("gid") > 9).cast("int"))
    bank = cb.query_bank(rows, "view", 10, 4, 3)
    assert bank.count() == 4 and all(abs(np.linalg.norm(r["vec"]) - 1) < 1e-9 for r in bank.collect())
