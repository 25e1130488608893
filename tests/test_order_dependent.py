"""Operators without SQL, against plain code."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pointweave.operators import consensus as con
from pointweave.operators import evaluate as ev
from pointweave.operators import fit
from pointweave.operators import fusion as fus
from pointweave.operators import graph, order, sample
from pointweave.operators import spatial as sp
from pointweave.operators import track as trk
from pointweave.streaming import windows as win


def cloud(spark, n=80, seed=5):
    rng = np.random.default_rng(seed)
    xyz, v = rng.random((n, 3)) * 4, rng.standard_normal((n, 6))
    hit = rng.random(n) < 0.4
    df = spark.createDataFrame([(i, xyz[i].tolist(), v[i].tolist(), bool(hit[i])) for i in range(n)], "gid bigint, pos array<double>, vec array<double>, hit boolean")
    return df, xyz, v, hit


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def test_two_source_fill(spark):
    df, xyz, v, _ = cloud(spark)
    got = {}
    for r in sp.two_source_fill(df.where("gid % 3 = 0"), df.where("gid % 3 <> 0"), 3, 0.7, 0.0, 1.5).collect():
        got.setdefault(r["gid"], {})[r["source"]] = r["weight"]
    src = [i for i in range(80) if i % 3]
    for q in range(0, 80, 3):
        d = np.sqrt(((xyz[src] - xyz[q]) ** 2).sum(1))
        a, b = np.argsort(d)[:2]
        want = {src[a]: 255}
        if unit(v[src[a]]) @ unit(v[src[b]]) >= 0 and d[b] <= 1.5 * d[a]:
            w = int(np.rint(255 * d[b] / (d[a] + d[b])))
            want = {src[a]: w, src[b]: 255 - w}
        assert got[q] == {k: x for k, x in want.items() if x}


def test_neighbour_support(spark):
    df, xyz, v, hit = cloud(spark)
    near = sp.knn(df, df, 6, 3, 0.8)
    got = {r["gid"]: r["support"] for r in sp.neighbour_support(near, df, "hit", 0.0).collect()}
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for i in range(80):
        j = np.argsort(d[i])[:6]
        k = np.exp(-d[i, j] / d[i, j].max()) * (unit(v[j]) @ unit(v[i]) >= 0)
        assert abs(got[i] - (k * hit[j]).sum() / max(k.sum(), 1e-12)) < 1e-9


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 999)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in graph.components(links).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1000] == 999
    assert graph.components(links.limit(0)).count() == 0


def test_suppression_and_regions(spark):
    boxes = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 1.0, 0.0, 11.0, 10.0, 0.8), (0, 2, 20.0, 0.0, 30.0, 10.0, 0.7)], "image int, box int, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted(r["box"] for r in trk.box_nms(boxes, "image", 0.5).collect()) == [0, 2]
    px = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 9, 9)], "image int, px int, py int")
    assert sorted(r["px"] for r in ev.small_regions(px, "image", 2).collect()) == [0, 1, 2]


_NODE = "scene int, view int, node bigint, ids array<bigint>, ws array<double>, vec array<double>, mass double"


def plain_trace(rows, least_overlap, least_cos, keep):
    """Dense matrices, view after view."""
    ids = sorted({i for r in rows for i in r[3]})
    place = {i: n for n, i in enumerate(ids)}
    memory, sums, counts, out = [], [], [], {}

    def norm(x):
        return x / max(np.linalg.norm(x), 1e-8)

    def cut(x):
        order = np.lexsort((np.arange(len(x)), -x))
        y = np.zeros_like(x)
        y[order[:keep]] = x[order[:keep]]
        return norm(y)

    for view in sorted({r[1] for r in rows}):
        now = sorted((r for r in rows if r[1] == view), key=lambda r: r[2])
        sig = np.zeros((len(now), len(ids)))
        for a, r in enumerate(now):
            sig[a, [place[i] for i in r[3]]] = r[4]
            sig[a] = norm(sig[a])
        vec = np.array([norm(np.array(r[5])) for r in now])
        match = {}
        if memory:
            over, cos = sig @ np.array(memory).T, vec @ np.array([norm(s) for s in sums]).T
            score = over * np.clip((cos - least_cos) / (1 - least_cos), 0, 1)
            score[(over < least_overlap) | (cos < least_cos)] = 0
            for a in range(len(now)):
                m = int(score[a].argmax())
                if score[a, m] > 0 and score[:, m].argmax() == a:
                    match[a] = m
        for a, r in enumerate(now):
            if a in match:
                m = match[a]
                memory[m] = cut(memory[m] * counts[m] + sig[a])
                sums[m] = sums[m] + vec[a] * r[6]
                counts[m] += 1
            else:
                m = len(memory)
                memory.append(cut(sig[a]))
                sums.append(vec[a] * r[6])
                counts.append(1)
            out[r[2]] = m
    return out


def test_trace_memory(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((5, 6))
    rows = []
    for view in range(6):
        for seg in range(7):
            k = int(rng.integers(0, 5))
            ids = sorted(set(rng.integers(20 * k, 20 * k + 20, 12).tolist()))
            rows.append((0, view, view * 10 + seg, ids, rng.random(len(ids)).tolist(), (centres[k] + 0.3 * rng.standard_normal(6)).tolist(), float(rng.random() + 0.5)))
    want = plain_trace(rows, 0.15, 0.3, 15)
    got = {r["node"]: r["track"] for r in trk.trace_memory(spark.createDataFrame(rows, _NODE), "scene", 0.15, 0.3, 15).collect()}
    assert got == want and 5 <= len(set(want.values())) < len(rows)


def test_lift_groups(spark):
    unit_x, unit_y = [1.0, 0.0], [0.0, 1.0]
    rows = [(0, 1, 1, [1, 2, 3], [2.0, 1.0, 1.0], unit_x, 4.0), (0, 2, 2, [1, 2, 4], [1.0, 1.0, 2.0], [0.8, 0.6], 2.0), (0, 3, 3, [1, 2, 3], [1.0, 1.0, 1.0], unit_y, 5.0), (0, 4, 4, [50], [1.0], unit_x, 1.0)]
    df = spark.createDataFrame(rows, _NODE.replace("view", "place").replace("node", "mask"))
    got = {r["mask"]: r for r in trk.lift_groups(df, "scene", 0.1, 0.5, 0.5, 0.4).collect()}
    # mask 2 shares 1/4 + 1/4 of its weight with mask 1: Jaccard 1/3, cosine 0.8; mask 3 differs in meaning
    assert [got[i]["group_id"] for i in (1, 2, 3, 4)] == [0, 0, 1, 2]
    assert got[1]["count"] == 2 and got[1]["mass"] == 6.0 and got[1]["ids"] == [1, 2, 3, 4]
    assert np.allclose(got[1]["ws"], np.array([0.5 * 4 + 0.25 * 2, 0.25 * 4 + 0.25 * 2, 0.25 * 4, 0.5 * 2]) / 6)
    assert np.allclose(got[2]["feature"], unit(np.array([1.0 * 4 + 0.8 * 2, 0.6 * 2])))
    assert trk.lift_groups(df, "scene", 0.1, 0.5, 0.5, 0.6).select("group_id").distinct().count() == 4


def plain_importance(v, support, heat, most_kl, ratio):
    base = support / support.sum()
    centre = unit((base[:, None] * v).sum(0))
    info = support[:, None] * v * v
    known = 1e-4 + info.sum(0)
    gain = np.log(known / np.maximum(1e-4, known - info)).mean(1)
    logit = np.clip((gain / max(gain.max(), 1e-8) + np.log(np.maximum(np.clip(v @ centre, 0, 1), 1e-4))) / heat, -30, 30)
    target = base * np.exp(logit - logit.max())
    target /= target.sum()
    kl = lambda m: (m * np.log(m / base)).sum()
    if kl(target) > most_kl:
        low, high = 0.0, 1.0
        for _ in range(32):
            mid = (low + high) / 2
            low, high = (mid, high) if kl(base + mid * (target - base)) <= most_kl else (low, mid)
        target = base + low * (target - base)
    held = base * np.minimum(target / base, ratio)
    return held / held.sum()


def test_node_importance(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for track in range(4):
        v, s = unit(rng.standard_normal((7, 5)) + 0.6), rng.random(7) * 10 + 0.1
        rows += [(track, track * 10 + i, v[i].tolist(), float(s[i])) for i in range(7)]
        heat = 0.3
        want |= {track * 10 + i: x for i, x in enumerate(plain_importance(v, s, heat, 0.05 if track % 2 else 0.05, 2.0))}
    df = spark.createDataFrame(rows, "track bigint, node bigint, vec array<double>, support double")
    got = {r["node"]: r["importance"] for r in trk.node_importance(df, "information_kl", 0.3, 0.05, 2.0).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-7
    even = trk.node_importance(df, "uniform").collect()
    assert all(abs(r["importance"] - 1 / 7) < 1e-12 for r in even)


def test_equal_overlaps_tie_in_any_order(spark):
    """Nodes 0 and 1 share the same masses with node 9, over points in other orders (0.1 + 0.2 +
    0.3 is more than 0.3 + 0.2 + 0.1 in doubles): they tie, and the lower wins."""
    mass = [0.3, 0.2, 0.1]
    a = spark.createDataFrame([(0, n, g, mass[g if n == 0 else 2 - g]) for n in range(2) for g in range(3)], "view bigint, node bigint, gid bigint, w double")
    b = spark.createDataFrame([(1, 9, g, 1.0) for g in range(3)], "view bigint, node bigint, gid bigint, w double")
    v = spark.createDataFrame([(n, [1.0, 0.0]) for n in (0, 1, 9)], "node bigint, vec array<double>")
    for way in (F.col("gid").asc(), F.col("gid").desc()):
        rows = a.coalesce(1).sortWithinPartitions(way)
        (pair,) = trk.mutual_best(rows.drop("view"), b.drop("view"), v, v, 0.5, -0.5).collect()
        (link,) = trk.windowed_links(rows.unionByName(b), v, 1, 0.5, 0.05).collect()
        assert (pair["a"], pair["b"]) == (0, 9) and (link["a"], link["b"]) == (9, 0)


def test_windowed_links_of_repeated_nodes(spark):
    """Node 2 stands in views 1 and 2 and node 1 in views 0 and 1, with each other's vectors: the
    pair is given twice with one score, and is linked once, at any order of the rows."""
    sig = spark.createDataFrame([(2, 2, 7, 1.0), (1, 2, 8, 1.0), (1, 1, 7, 1.0), (0, 1, 9, 1.0)], "view bigint, node bigint, gid bigint, w double")
    x, y = [1.0, 0.0], [0.6, 0.8]
    nodes = spark.createDataFrame([(2, 2, x), (1, 2, y), (1, 1, y), (0, 1, x)], "view bigint, node bigint, vec array<double>")
    got = [tuple(r) for r in trk.windowed_links(sig, nodes, 2, 0.03, 0.05).collect()]
    assert got == [(2, 1, 1.0)]
    same = nodes.withColumn("vec", F.when(F.col("view") == 1, F.array(*map(F.lit, y))).otherwise(F.array(*map(F.lit, x))))
    assert trk.windowed_links(sig, same.where("node = 1 or view = 2").unionByName(same.where("node = 1")), 2, 0.03, 0.05).count() == 1


def test_tracks_of_repeated_nodes(spark):
    """A node id that two views share stands for two nodes, each counted once."""
    nodes = spark.createDataFrame([(5, 0, [1.0, 0.0], 10.0), (5, 1, [0.8, 0.6], 20.0), (6, 2, [0.9, 0.43588989], 30.0)], "node bigint, view bigint, vec array<double>, support double")
    links = spark.createDataFrame([(6, 5)], "a bigint, b bigint")
    for mode in ("support", "information_kl"):
        (r,) = trk.build_tracks(nodes, links, 3.0, mode)[0].collect()
        assert (r["root"], r["support"], r["views"]) == (5, 60.0, 3)


def test_knn_of_dense_and_equal_points(spark, monkeypatch):
    """Clusters far denser than the cell, copies of one point and lone points: the same as all
    pairs, and no tile holds more than a small share of them."""
    monkeypatch.setattr(sp, "OUTRIGHT", 0)
    rng = np.random.default_rng(12)
    xyz = np.concatenate([rng.integers(0, 60, (300, 3)) / 1000, rng.random((200, 3)) * 4, np.full((90, 3), 2.5), [[90.0, 90.0, 90.0]]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xyz)] + [(9000, None), (9001, [1.0, float("nan"), 2.0])], "gid bigint, pos array<double>")
    made = []
    tiles = sp._in_tiles
    monkeypatch.setattr(sp, "_in_tiles", lambda left, src, k, width, axes, schema: made.append(width) or tiles(left, src, k, width, axes, schema))
    got = {(r["gid"], r["rank"]): (r["neighbour"], r["d2"]) for r in sp.knn(df, df, 3, 3, 50.0).collect()}
    d = ((xyz[:, None, 0] - xyz[None, :, 0]) ** 2 + (xyz[:, None, 1] - xyz[None, :, 1]) ** 2) + (xyz[:, None, 2] - xyz[None, :, 2]) ** 2
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): (j, d[i, j]) for i in range(len(xyz)) for r, j in enumerate(np.lexsort((np.arange(len(xyz)), d[i]))[:3])}
    assert got == want and made[0] < 1


def test_means_and_starts_of_dense_points(spark, monkeypatch):
    """All points in one cell of the width given: mean distances, scales and fills are those of all
    pairs, and fewer distances are made than there are pairs."""
    monkeypatch.setattr(sp, "OUTRIGHT", 0)
    xyz = np.random.default_rng(13).random((3000, 3))
    df = spark.createDataFrame([(i, x.tolist(), [0.5] * 3) for i, x in enumerate(xyz)], "gid bigint, xyz array<double>, rgb array<double>").withColumn("pos", F.col("xyz"))
    made = []
    tiles = sp._in_tiles
    monkeypatch.setattr(sp, "_in_tiles", lambda left, src, k, width, axes, schema: made.append(width) or tiles(left, src, k, width, axes, schema))
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    mean = np.sort(d, axis=1)[:, :3].mean(1)
    got = {r["gid"]: r["mean_d2"] for r in sp.mean_nearest(df, 3, 2.0).collect()}
    assert len(got) == 3000 and all(abs(got[i] - mean[i]) < 1e-12 for i in got) and made[0] < 0.3
    start = {r["gid"]: r["scaling"][0] for r in fit.initialise(df.drop("pos"), 2.0).collect()}
    assert len(start) == 3000 and all(abs(start[i] - np.log(np.sqrt(max(mean[i], 1e-7)))) < 1e-9 for i in start)
    near = d[::3][:, [j for j in range(3000) if j % 3]].min(1)
    fill = sp.nearest_fill(df.where("gid % 3 = 0"), df.where("gid % 3 <> 0"), 40, 3, 2.0).collect()
    assert {r["gid"] for r in fill} == {int(i) * 3 for i in np.argsort(near)[:40]}


def test_lifting_holds_little(spark):
    """40,000 masks of one scene, each its own group, held and given out within 100 MB; a second
    scene starts afresh."""
    n, rng = 40_000, np.random.default_rng(3)

    def batches():
        for start in range(0, n, 1000):
            m = np.arange(start, start + 1000)
            yield pa.RecordBatch.from_pydict({"scene": m // (n - 10), "place": m, "mask": m, "ids": [[int(i) * 6 + j for j in range(6)] for i in m], "ws": [[1.0] * 6] * 1000, "vec": rng.standard_normal((1000, 64)).tolist(), "mass": np.ones(1000)})

    tracemalloc.start()
    rows, last = 0, None
    for b in trk.lifted(batches(), "scene", 0.02, 0.1, 0.5, 0.3, 200, 64, 64):
        rows, last = rows + b.num_rows, b
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and last.column(2).to_pylist() == list(range(10)) and peak < 100 << 20


def test_neighbours_at_any_distance(spark):
    """The third point lies far beyond any cell that the others share."""
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [1e9])], "gid bigint, pos array<double>")
    got = {(r["gid"], r["rank"]): (r["neighbour"], r["d2"]) for r in sp.knn(df, df, 2, 1, 1.0).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}
    assert got[3, 1][1] == (1e9 - 1) ** 2
    assert sp.knn(df.limit(0), df, 2, 1, 1.0).count() == 0 and sp.knn(df, df.limit(0), 2, 1, 1.0, drop_self=False).count() == 0


def test_places_and_first_rows_need_no_single_task(spark):
    df = spark.range(1000).selectExpr("id AS k", "id * 37 % 101 AS v")
    got = {r["k"]: r["place"] for r in order.numbered(df, [df["v"].desc(), df["k"]]).collect()}
    want = {k: i for i, (_, k) in enumerate(sorted((-(k * 37 % 101), k) for k in range(1000)))}
    assert got == want
    assert {r["k"] for r in order.first_n(df, 77, [df["v"].desc(), df["k"]]).collect()} == {k for k, i in want.items() if i < 77}
    assert order.numbered(df.limit(0), [df["v"]]).count() == 0


def test_vector_sums_over_hot_and_null_keys(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 11 == 0 else i % 3, f"g{i % 2}", rng.random(4).tolist(), float(i % 5)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, g string, vec array<double>, w double").repartition(7)
    got = {(r["k"], r["g"]): (r["total_w"], r["s"]) for r in con.vector_sum(df, ["k", "g"], "vec", "w").collect()}
    want = {}
    for k, g, v, w in rows:
        s = want.setdefault((k, g), [0.0, np.zeros(4)])
        s[0] += w
        s[1] = s[1] + w * np.array(v)
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and np.allclose(got[k][1], want[k][1]) for k in want)
    assert con.vector_sum(df.limit(0), ["k"], "vec").count() == 0


def test_weighted_sums_by_broadcast_and_by_join(spark, monkeypatch):
    rng = np.random.default_rng(2)
    c = spark.createDataFrame([(i % 40, int(rng.integers(0, 9)), float(rng.random())) for i in range(900)], "gid int, seg_id int, weight double")
    v = spark.createDataFrame([(i, rng.random(3).tolist()) for i in range(8)] + [(8, None)], "seg_id int, vec array<double>")
    near = {r["gid"]: (r["total_w"], *r["s"]) for r in con.weighted_sums(c, v, ["gid"]).collect()}
    monkeypatch.setattr(con, "BROADCAST_BYTES", 0)
    far = {r["gid"]: (r["total_w"], *r["s"]) for r in con.weighted_sums(c, v, ["gid"]).collect()}
    assert set(near) == set(far) and all(np.allclose(near[k], far[k]) for k in far)


def test_robust_shards(spark):
    """The reference's rule for one outlying shard, and plain Weiszfeld rounds."""
    rng = np.random.default_rng(3)
    rows = [(g, s, unit(rng.standard_normal(4)).tolist(), float(rng.random() + 0.1), float(rng.random())) for g in range(5) for s in range(4)]
    rows += [(9, 0, [1.0, 0.0, 0.0, 0.0], 0.0, 1.0)]
    got = {r["gid"]: r for r in fus.robust_shard_merge(spark.createDataFrame(rows, "gid int, shard int, feature array<double>, total_w double, mean_norm double"), 0.5, 8).collect()}
    for g in range(5):
        own = [r for r in rows if r[0] == g]
        v, e = np.array([r[2] for r in own]), np.array([r[3] * r[4] for r in own])
        w = np.sqrt(e)
        c = unit((v * w[:, None]).sum(0))
        for _ in range(8):
            a = w / np.maximum(np.linalg.norm(v - c, axis=1), 1e-4)
            c = unit((v * a[:, None]).sum(0))
        assert np.allclose(got[g]["feature"], c) and abs(got[g]["dispersion"] - (1 - v @ c).sum()) < 1e-9
        assert got[g]["supported"] == 4 and np.allclose(got[g]["sb"], unit((v[1::2] * e[1::2, None]).sum(0)))
    assert got[9]["supported"] == 0 and got[9]["feature"] == [0.0] * 4 and got[9]["sa"] is None


def test_robust_groups(spark):
    rng = np.random.default_rng(6)
    v = unit(rng.standard_normal((30, 4)))
    score, conf = rng.random((30, 3)), rng.random((30, 3)) + 0.1
    member = [(i, g, float(score[i, g])) for i in range(30) for g in range(3)]
    points = spark.createDataFrame([(i, v[i].tolist()) for i in range(30)], "gid int, feature array<double>")
    sure = spark.createDataFrame([(i, *map(float, sorted(conf[i, :2])[::-1]), float(conf[i, 2])) for i in range(30)], "gid int, best double, second double, weight double")
    got = {r["group_id"]: r for r in fus.teach_groups_robustly(points, spark.createDataFrame(member, "gid int, group_id int, score double"), sure, 3, 1.5, 2.0, 0.2).collect()}
    high, low = np.sort(conf[:, :2], 1)[:, ::-1].T
    c = (0.2 + 0.8 * np.clip((high - low) / high, 0, 1)) * np.sqrt(np.clip(conf[:, 2] / np.percentile(conf[:, 2], 90), 0, 1))
    t = unit((score[:, :, None] ** 1.5 * v[:, None]).sum(0))
    for _ in range(3):
        a = np.clip(v @ t.T, 0, 1)
        w = score**1.5 * c[:, None] * a**2
        t = unit((w[:, :, None] * v[:, None]).sum(0))
    for g in range(3):
        assert np.allclose(got[g]["feature"], t[g]) and abs(got[g]["agreement"] - (w * a)[:, g].sum() / w[:, g].sum()) < 1e-9


def test_samples(spark):
    df = spark.range(100).selectExpr("id AS k", "id % 4 AS g")
    assert sample.stratified(df, "g", "k", 5, 30).count() == 30
    assert {r["count"] for r in sample.balanced(df, "g", "k", 7).groupBy("g").count().collect()} == {7}
    p = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.75)], "group_id int, view_id int, p double")
    draws = spark.createDataFrame([(i, 0, i / 100) for i in range(100)], "draw int, group_id int, u double")
    got = sample.draw_views(p, draws).groupBy("view_id").count().collect()
    assert {r["view_id"]: r["count"] for r in got} == {0: 25, 1: 75}


def test_view_distributions(spark):
    rng = np.random.default_rng(9)
    share, score = rng.random((3, 6)) + 0.05, rng.random((3, 6))
    last = rng.dirichlet(np.ones(6), 3)
    share[2, 4] = 0.0
    rows = [(g, v, float(share[g, v]), float(score[g, v]), float(last[g, v]) if g == 1 else None) for g in range(3) for v in range(6)]
    df = spark.createDataFrame(rows, "group_id int, view_id int, share double, score double, last double")
    got = {(r["group_id"], r["view_id"]): r["p"] for r in sample.view_distributions(df, 2.0, 0.25, 0.2, 0.05).collect()}

    def held(base, target, limit):
        kl = lambda m: sum(x * np.log(x / b) for x, b in zip(m, base, strict=True) if x > 0)
        if kl(target) <= limit:
            return target
        low, high = 0.0, 1.0
        for _ in range(32):
            mid = (low + high) / 2
            low, high = (mid, high) if kl(base + mid * (target - base)) <= limit else (low, mid)
        return base + low * (target - base)

    for g in range(3):
        on = share[g] > 0
        base, s = share[g, on] / share[g, on].sum(), score[g, on]
        m = (base * s).sum()
        tilt = base * np.exp(np.clip(2.0 * (s - m) / max(np.sqrt((base * (s - m) ** 2).sum()), 1e-6), -12, 12))
        want = held(base, 0.75 * tilt / tilt.sum() + 0.25 * base, 0.2)
        want = held(last[g, on] if g == 1 else base, want, 0.05)
        assert np.allclose([got[g, v] for v in np.flatnonzero(on)], want, atol=1e-7)
    assert (2, 4) not in got
    seen = spark.createDataFrame([(0, 1, 5.0)], "group_id int, view_id int, priority double")
    after = {(r["group_id"], r["view_id"]): r["score"] for r in sample.observe_priority(df, seen, 0.9).collect()}
    assert abs(after[0, 1] - (0.9 * score[0, 1] + 0.5)) < 1e-12 and after[1, 1] == score[1, 1]


def test_superpoint_edges(spark):
    rng = np.random.default_rng(7)
    pos, rgb, size, v = rng.random((60, 3)) * 3, rng.random((60, 3)), rng.random(60), unit(rng.standard_normal((60, 4)))
    df = spark.createDataFrame([(i, pos[i].tolist(), rgb[i].tolist(), float(size[i]), v[i].tolist()) for i in range(60)], "gid bigint, pos array<double>, rgb array<double>, log_scale double, vec array<double>")
    near = sp.knn(df, df, 5, 3, 0.8)
    got = {(r["a"], r["b"]) for r in sp.superpoint_edges(near, df, 0.9, 0.7, 0.5, -0.1).collect()}
    d = np.sqrt(((pos[:, None] - pos[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, 1)[:, :5]
    r = np.take_along_axis(d, nn, 1)[:, -1]
    want = set()
    for i in range(60):
        for j in nn[i]:
            if d[i, j] <= 0.9 * min(r[i], r[j]) and np.linalg.norm(rgb[i] - rgb[j]) <= 0.7 and abs(size[i] - size[j]) <= 0.5 and v[i] @ v[j] >= -0.1:
                want.add((min(i, j), max(i, j)))
    assert got == want and len(want) > 10


def test_pca_colours(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((101, 6)) * np.array([5, 3, 2, 0.3, 0.2, 0.1]) + 1
    x[0] *= 40
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(101)], "gid int, vec array<double>")
    got = {r["gid"]: r["rgb"] for r in ev.pca_colours(df).collect()}
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    v = v[:3].T * np.sign(v[:3].T[np.abs(v[:3].T).argmax(0), np.arange(3)])
    code = x @ v
    off = np.abs(code - np.sort(code, 0)[50])
    inside = off / np.sort(off, 0)[50] < 3
    lo, hi = (f(np.where(inside, code, w), axis=0) for f, w in ((np.min, np.inf), (np.max, -np.inf)))
    want = np.clip((code - lo) / (hi - lo), 0, 1)
    assert np.allclose([got[i] for i in range(101)], want, atol=1e-8)


def test_associations_are_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(0, 1, 5, 2.0, False)], "view_id int, seg_id int, gid int, weight double, rescued boolean")

    for _ in range(2):
        assert trk.cached_associations(spark, f"file://{tmp_path}/a", build).count() == 1
    assert len(calls) == 1


def test_last_node_stream(spark, tmp_path):
    rows = [(g, v, 100 * v + g % 3) for g in range(6) for v in range(4) if (g + v) % 4]
    schema = "gid bigint, view bigint, node bigint"
    for v in range(4):  # a file a view, read in order
        spark.createDataFrame([r for r in rows if r[1] == v], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/s")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/s")
    got = sorted(tuple(r) for r in win.run_to_memory(win.last_node_stream(stream), "links", "append").collect())
    want = []
    for g in range(6):
        own = [n for i, _, n in sorted(rows) if i == g]
        want += [(g, a, b) for a, b in zip(own, own[1:], strict=False)]
    assert got == sorted(want)
