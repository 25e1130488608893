"""Literal cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import vec
from pointweave.operators import codebook as cb
from pointweave.operators import consensus as con
from pointweave.operators import evaluate as ev
from pointweave.operators import observe as obs
from pointweave.operators import query as qry
from pointweave.operators import spatial as sp
from pointweave.operators import track as trk


def hits(spark, rows, seg=()):
    seg = dict(seg)
    return spark.createDataFrame([(0, p, g, float(w), seg.get(p, 0)) for p, g, w in rows], "view_id int, pixel_id int, gid int, weight double, seg_id int")


def test_visibility_truncation(spark):
    w = lambda ws: hits(spark, [(0, g, x) for g, x in enumerate(ws)])
    kept = lambda df, *a: sorted(r["gid"] for r in obs.truncate_visibility(df, ["pixel_id"], ["gid"], *a).collect())
    assert kept(w([0.60, 0.20, 0.10, 0.05]), 0.90, 0.01, 1) == [0, 1, 2]
    assert kept(w([0.80, 0.15, 0.05]), 0.5, 0.5, 2) == [0, 1]
    assert kept(hits(spark, [(0, 2, 0.10), (0, 0, 0.60), (0, 1, 0.20)]), 0.8, 0.0, 1) == [0, 1]


def test_signed_ownership(spark):
    df = hits(spark, [(0, 0, 0.6), (0, 1, 0.2), (1, 0, 0.2), (2, 0, 0.3), (2, 1, 0.4), (2, 2, 0.5), (3, 2, 0.5)], [(0, 0), (1, 0), (2, 1), (3, 0)])
    got = {r["gid"]: r for r in obs.signed_ownership(df, ["view_id"]).collect()}
    assert [got[g]["owner"] for g in (0, 1, 2)] == [0, 1, 0]
    assert np.allclose([got[g]["total"] for g in (0, 1, 2)], [1.1, 0.6, 1.0])
    assert np.allclose([got[g]["confidence"] for g in (0, 1, 2)], [0.5 / 1.1, 0.2 / 0.6, 0])


def test_surface_responsibility(spark):
    df = spark.createDataFrame([(0, 0, 0.5, 1.0), (0, 1, 0.5, 2.0)], "pixel_id int, gid int, weight double, depth double")
    got = {r["gid"]: r["weight"] for r in obs.surface_responsibility(df, ["pixel_id"], ["depth", "gid"], 0.2, 0.02, steps=32).collect()}
    assert got[0] > got[1] and math.isclose(sum(got.values()), 1)
    kl = sum(p * math.log(p / 0.5) for p in got.values())
    assert kl <= 0.02001 and got[0] / got[1] <= 5.01


def test_composite_equals_a_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(p, g, float(rng.uniform(0.05, 0.95)), float(rng.uniform())) for p in range(20) for g in range(30)]
    df = spark.createDataFrame(rows, "pixel_id int, gid int, alpha double, depth double")
    got = {(r["pixel_id"], r["gid"]): r["weight"] for r in obs.composite(df, ["pixel_id"], ["depth", "gid"]).collect()}
    want = {}
    for p in range(20):
        t = 1.0
        for _, g, a, _ in sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[1])):
            if t * (1 - a) < 1e-4:
                break
            want[p, g] = a * t
            t *= 1 - a
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_pack_and_entropy(spark):
    rows = spark.createDataFrame([(0, 0, 0.6), (0, 1, 0.9), (0, 2, 0.7), (1, 1, 0.4)], "gid int, track int, score double")
    assert [(r["gid"], r["slot"], r["track"]) for r in trk.pack_memberships(rows, 2, 0.5).orderBy("slot").collect()] == [(0, 0, 1), (0, 1, 2)]
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (1, 4)], "h int, n int").select(vec.binary_entropy("h", "n")).collect()
    assert [r[0] for r in e[:3]] == [0, 1, 0] and 0 < e[3][0] < 1


def test_rofa(spark):
    rows = [(0, 0, [1.0, 0.0]), (0, 1, [0.99, 0.01]), (0, 2, [0.98, 0.02]), (0, 3, [0.0, 1.0]), (1, 4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "track int, node int, vec array<double>")
    assert [r["keep"] for r in trk.rofa_filter(df, "track", "node", "vec", 1.0).orderBy("node").collect()] == [True, True, True, False, True]


def test_split_reliability(spark):
    cases = [([1.0, 0.0], [1.0, 0.0], 1.0, 1.0), ([1.0, 0.0], [0.0, 1.0], 1.0, 1.0), ([1.0, 0.0], [1.0, 0.0], 4.0, 1.0)]
    df = spark.createDataFrame(cases, "v array<double>, w array<double>, a double, b double")
    got = [r[0] for r in df.select(con.split_reliability(*map(F.col, ("v", "w", "a", "b")), 0.2)).collect()]
    assert math.isclose(got[0], 1) and got[1] == 0 and 0 < got[2] < 1


def test_geometric_median(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1.0)] * 3 + [(0, [0.0, 1.0], 1.0)], "k int, vec array<double>, w double")
    x, y = con.geometric_median(df, ["k"], "vec", "w", 12).first()["median"]
    assert x > 0.99 and y < 0.05


def test_kl_trust_region(spark):
    df = spark.createDataFrame([([0.9, 0.1], [0.5, 0.5]), ([0.51, 0.49], [0.5, 0.5])], "p array<double>, q array<double>")
    a, b = (r[0] for r in df.select(vec.kl_trust_region("p", "q", 0.02)).collect())
    assert sum(x * math.log(x / 0.5) for x in a) <= 0.02 and a[0] > 0.59
    assert b == [0.51, 0.49]


def test_codebook(spark):
    eye = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "code_id bigint, vec array<double>")
    unit = lambda v: (np.array(v) / np.linalg.norm(v)).tolist()
    p = spark.createDataFrame([(0, unit([1, 0.5, 0, 0]), 1), (1, [0.0, 0.0, 1.0, 0.0], 1)], "gid bigint, vec array<double>, cap int")
    got = cb.sparse_code(p, eye, 3, 0.01, 0.999).collect()
    assert [sum(r["gid"] == g for r in got) for g in (0, 1)] == [2, 1]
    must = cb.sparse_code(p.withColumn("cap", F.lit(3)), eye, 3, 0.01, 0.999, "cap").collect()
    assert [sum(r["gid"] == g for r in must) for g in (0, 1)] == [3, 3]
    codes = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (1, 0, [0.1, 0.2]), (1, 1, [-0.2, 0.1])], "level int, code_id bigint, vec array<double>")
    ids = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)], "gid int, level int, code_id bigint")
    merged, moved = cb.merge_levels(codes, ids)
    assert sorted((r["gid"], r["code_id"]) for r in moved.collect()) == [(0, 0), (0, 3), (1, 1), (1, 2)]
    a = {r["gid"]: r["feature"] for r in cb.reconstruct(ids, codes, ["gid"], ["level", "code_id"]).collect()}
    b = {r["gid"]: r["feature"] for r in cb.reconstruct(moved, merged, ["gid"], ["code_id"]).collect()}
    assert a == b


def test_kmeans_policies(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 16))
    v = centres[np.arange(192) % 8] + 0.05 * rng.standard_normal((192, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "gid bigint, vec array<double>")
    for empty in ("keep", "reseed", "farthest"):
        codes = cb.kmeans(p, 8, 8, empty=empty)
        assert codes.count() == 8
        assert cb.nearest_code(p, codes).agg(F.avg("score")).first()[0] > 0.9


def test_routing(spark):
    base = spark.createDataFrame([(0, 0.2), (1, 0.6), (2, 0.1), (3, 0.4)], "gid int, base double")
    cand = [(g, s, c, 1.0) for s, cs in enumerate(([0.5, 0.5, 0.2, 0.9], [0.3, 0.4, 0.8, 0.1])) for g, c in enumerate(cs)]
    c = spark.createDataFrame(cand, "gid int, slot int, cand double, member double")
    got = {r["gid"]: (r["score"], r["routed"]) for r in qry.route_budget(base, c, 0.25).collect()}
    assert [got[g][0] for g in range(4)] == [0.2, 0.6, 0.8, 0.4] and sum(r for _, r in got.values()) == 1
    one = spark.createDataFrame([(0, 0.1)], "gid int, base double")
    two = spark.createDataFrame([(0, 0, 0.9, 0.1), (0, 1, 0.7, 1.0)], "gid int, slot int, cand double, member double")
    assert qry.route_budget(one, two, 1.0, "membership_gain").first()["score"] == 0.7


def test_relevancy_identity(spark):
    rng = np.random.default_rng(2)
    rows = [[rng.standard_normal(4).tolist() for _ in range(4)] for _ in range(50)]
    df = spark.createDataFrame([tuple(r) for r in rows], "v array<double>, p array<double>, n1 array<double>, n2 array<double>")
    got = [r[0] for r in df.select(vec.relevancy("v", "p", ["n1", "n2"])).collect()]
    for g, (v, p, *neg) in zip(got, rows, strict=True):
        s = [math.exp(10 * np.dot(v, x)) for x in (p, *neg)]
        assert math.isclose(g, min(s[0] / (s[0] + x) for x in s[1:]), rel_tol=1e-9)


def test_evaluation(spark):
    s = spark.createDataFrame([("a", 0.25), ("a", 0.50), ("b", 0.75)], "category string, iou double")
    r = ev.summarise(s.withColumn("k", F.lit(0)), ["k"]).first()
    assert (r["miou"], round(r["acc25"], 6), round(r["acc50"], 6)) == (0.5, round(2 / 3, 6), round(1 / 3, 6))
    t = spark.createDataFrame([("one", 0.4, 0.9), ("one", 0.5, 0.5), ("two", 0.4, 0.0), ("two", 0.5, 0.6)], "scene string, threshold double, iou double")
    b = ev.shared_threshold(t).first()
    assert b["threshold"] == 0.5 and math.isclose(b["miou"], 0.55)
    tie = spark.createDataFrame([(0.5, 0.4), (0.4, 0.4)], "threshold double, miou double")
    assert ev.best_threshold(tie, []).first()["threshold"] == 0.4
    with pytest.raises(ValueError):
        ev.check_thresholds([0.0, 0.5])


def test_ssim_equals_convolution(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((9, 12)), rng.random((9, 12))
    w = np.array(ev.gaussian_window(11, 1.5))
    k = np.outer(w, w)

    def conv(x):
        p = np.pad(x, 5)
        return np.array([[(p[i : i + 11, j : j + 11] * k).sum() for j in range(12)] for i in range(9)])

    ma, mb = conv(a), conv(b)
    va, vb, cov = conv(a * a) - ma**2, conv(b * b) - mb**2, conv(a * b) - ma * mb
    want = ((2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4))).mean()
    df = spark.createDataFrame([(0, x, y, float(a[y, x]), float(b[y, x])) for x in range(12) for y in range(9)], "image int, px int, py int, a double, b double")
    assert math.isclose(ev.ssim(df, ["image"], "a", "b").first()["ssim"], want, rel_tol=1e-9)


def test_spatial(spark):
    rng = np.random.default_rng(4)
    xyz = rng.random((120, 3)) * 5
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(xyz)], "gid bigint, pos array<double>")
    got = {(r["gid"], r["rank"]): r["neighbour"] for r in sp.knn(p, p, 5, 3, 0.5).collect()}
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert all(got[i, r + 1] == j for i in range(120) for r, j in enumerate(np.argsort(d[i], kind="stable")[:5]))
    assert sp.knn(p.limit(0), p, 3, 3, 1.0).count() == 0
    assert sp.knn(p.where("gid = 0"), p.where("gid = 0"), 3, 3, 1.0).count() == 0
    e = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3)], "scene int, a bigint, b bigint")
    sizes = {r["node"]: r["size"] for r in sp.bounded_components(e, "scene", ["a", "b"], 3).collect()}
    assert max(sizes.values()) == 3 and sizes[3] == 1
    s = spark.createDataFrame([(0, 0, True), (1, 0, True), (2, 0, False), (3, 1, True), (4, 1, False)], "gid int, g int, c boolean")
    assert [r["support"] for r in sp.leave_one_out_support(s, "g", F.col("c")).orderBy("gid").collect()] == [0.5, 0.5, 0.0, 0.0, 0.0]


def test_streams_equal_batch(spark, sf, tmp_path):
    from pointweave.streaming import windows as win

    ev_ = spark.read.parquet(f"{sf}/events.parquet")
    ev_.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ev_.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    build = lambda df: win.tumbling(df, "1 day", "3650 days", ["event_type"], "value")
    got = win.run_to_memory(build(stream), "tumbled", "complete")
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(got) == key(build(ev_))
