"""Queries that link segments, weigh memberships and search space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.vec import as_double, dot
from pointweave.operators import evaluate as ev
from pointweave.operators import graph, sample
from pointweave.operators import spatial as sp
from pointweave.operators import track as trk
from pointweave.plans.registry import CONTRIBS, POINTS, Inputs, query
from pointweave.plans.sqltext import unit, vsum

_D = "::DOUBLE[]"
_POS = "SELECT p_partkey AS gid, CAST(p_partkey * 37 % 101 AS DOUBLE) / 10 AS x, CAST(p_partkey * 53 % 97 AS DOUBLE) / 10 AS y, CAST(p_partkey * 71 % 89 AS DOUBLE) / 10 AS z, p_size FROM {part}"
_DIST2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def _pos(t: Inputs) -> DataFrame:
    return t(_POS).select("gid", F.array("x", "y", "z").alias("pos"), "p_size")


@query(f"WITH c AS ({CONTRIBS}) SELECT gid, seg_id AS track, round(sum(weight), 6) AS w FROM c GROUP BY ALL")
def pair_reduce(t: Inputs) -> DataFrame:
    """A7, A8, A10"""
    return trk.pair_reduce(t(CONTRIBS).select("gid", F.col("seg_id").alias("track"), F.col("weight").alias("w"))).select("gid", "track", F.round("w", 6).alias("w"))


@query(f"WITH c AS ({CONTRIBS}), m AS (SELECT view_id, seg_id, gid, sum(weight) AS m FROM c GROUP BY ALL) SELECT view_id, seg_id, gid, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY view_id, seg_id)), 1e-8), 7) AS w FROM m")
def segment_signatures(t: Inputs) -> DataFrame:
    """A10, A11, D16"""
    return trk.signatures(t(CONTRIBS), ["view_id", "seg_id"]).select("view_id", "seg_id", "gid", F.round("w", 7).alias("w"))


_MEM = f"""WITH c AS ({CONTRIBS}), st AS (SELECT DISTINCT view_id, seg_id, seg_id % 9 AS track FROM c WHERE seg_id % 4 <> 0), b AS (SELECT view_id, gid, seg_id, sum(weight) AS m FROM c GROUP BY ALL), tot AS (SELECT view_id, gid, sum(m) AS total FROM b GROUP BY ALL),
fg AS (SELECT view_id, gid, track, sum(m) AS fg FROM b JOIN st USING (view_id, seg_id) GROUP BY ALL), cand AS (SELECT DISTINCT gid, track FROM fg), vis AS (SELECT DISTINCT view_id, track FROM st),
r AS (SELECT cand.gid, cand.track, total, coalesce(fg, 0) AS fg FROM cand JOIN vis USING (track) JOIN tot ON tot.view_id = vis.view_id AND tot.gid = cand.gid LEFT JOIN fg ON fg.view_id = vis.view_id AND fg.gid = cand.gid AND fg.track = cand.track),
o AS (SELECT gid, track, sum(fg) / greatest(sum(total), 1e-8) AS score, count(*) FILTER (fg > 0.5 * total) AS votes, count(*) AS seen FROM r GROUP BY ALL)"""


def _membership(t: Inputs) -> DataFrame:
    c = t(CONTRIBS)
    st = c.where("seg_id % 4 <> 0").select("view_id", "seg_id", (F.col("seg_id") % 9).alias("track")).distinct()
    return trk.membership(c, st)


@query(_MEM + " SELECT gid, track, round(score, 7) AS score, votes, seen, round(CASE WHEN seen < 2 OR votes IN (0, seen) THEN 0 ELSE -(votes / seen * log2(votes / seen) + (1 - votes / seen) * log2(1 - votes / seen)) END, 6) AS entropy FROM o")
def membership_ratio(t: Inputs) -> DataFrame:
    """A9, P8, J9, J10"""
    return _membership(t).select("gid", "track", F.round("score", 7).alias("score"), "votes", "seen", F.round("entropy", 6).alias("entropy"))


@query(_MEM + ", k AS (SELECT gid, track, score, row_number() OVER (PARTITION BY gid ORDER BY round(score, 9) DESC, track) - 1 AS slot FROM o WHERE score > 0.2) SELECT gid, slot::INT AS slot, track FROM k WHERE slot < 2")
def pack_top_memberships(t: Inputs) -> DataFrame:
    """K2, W3, K13"""
    rows = _membership(t).withColumn("s", F.round("score", 9)).where("score > 0.2")
    return trk.pack_memberships(rows, 2, 0.0, "s").select("gid", F.col("slot").cast("int").alias("slot"), "track")


_SIG = "SELECT l_suppkey AS node, l_partkey AS gid, sum(l_quantity) / 100 AS w FROM {lineitem} WHERE l_orderkey %% 2 = %d GROUP BY 1, 2"
_MUT = f"""a AS ({_SIG % 0}), b AS ({_SIG % 1}), v AS (SELECT vec_id AS node, embedding AS vec FROM {{embeddings}}),
o AS (SELECT a.node AS a, b.node AS b, sum(a.w * b.w) AS ov FROM a JOIN b USING (gid) GROUP BY ALL HAVING sum(a.w * b.w) >= 0.5), s AS (SELECT o.a, o.b, ov * least(greatest((list_dot_product(x.vec{_D}, y.vec{_D}) + 0.5) / 1.5, 0), 1) AS s FROM o JOIN v x ON x.node = o.a JOIN v y ON y.node = o.b),
m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY s DESC, a) AS rb FROM s WHERE s > 0)"""


@query(f"WITH {_MUT} SELECT a, b, round(s, 6) AS score FROM m WHERE ra = 1 AND rb = 1")
def mutual_best_match(t: Inputs) -> DataFrame:
    """J11"""
    v = t("SELECT vec_id AS node, embedding AS vec FROM {embeddings}")
    return trk.mutual_best(t(_SIG % 0), t(_SIG % 1), v, v, 0.5, -0.5).select("a", "b", F.round("score", 6).alias("score"))


@query(f"WITH a AS ({_SIG % 0}), b AS ({_SIG % 1}), ta AS (SELECT node, sum(w) AS t FROM a GROUP BY 1), tb AS (SELECT node, sum(w) AS t FROM b GROUP BY 1), l AS (SELECT a.node AS a, b.node AS b, sum(least(a.w, b.w)) AS low FROM a JOIN b USING (gid) GROUP BY ALL) SELECT a, b, round(low / greatest(ta.t + tb.t - low, 1e-8), 6) AS jaccard FROM l JOIN ta ON ta.node = a JOIN tb ON tb.node = b")
def weighted_jaccard(t: Inputs) -> DataFrame:
    """J18, J19"""
    return trk.weighted_jaccard(t(_SIG % 0), t(_SIG % 1)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("WITH a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM {lineitem} WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM {lineitem} WHERE l_returnflag = 'A'), j AS (SELECT coalesce(a.k, b.k) AS k, count(a.i) AS na, count(b.i) AS nb, count(*) FILTER (a.i IS NOT NULL AND b.i IS NOT NULL) AS nab FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i GROUP BY 1) SELECT k, round(nab / (na + nb - nab), 8) AS jaccard FROM j")
def id_set_jaccard(t: Inputs) -> DataFrame:
    """U1, U2, U5"""
    a, b = (t(f"SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM {{lineitem}} WHERE l_returnflag = '{f}'").withColumn(n, F.lit(1)) for f, n in (("R", "in_a"), ("A", "in_b")))
    j = a.join(b, ["k", "i"], "full").groupBy("k").agg(F.count("in_a").alias("na"), F.count("in_b").alias("nb"), F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("both"))
    union = F.col("na") + F.col("nb") - F.col("both")
    return j.select("k", F.round(F.when(union > 0, F.col("both") / union).otherwise(1.0), 8).alias("jaccard"))


@query(f"""WITH p AS ({POINTS}), x AS (SELECT label, pos, sum(val) AS s FROM (SELECT label, generate_subscripts(vec, 1) AS pos, unnest(vec{_D}) AS val FROM p) u GROUP BY ALL), s AS (SELECT label, array_agg(s ORDER BY pos) AS s FROM x GROUP BY 1), n AS (SELECT label, count(*) AS n FROM p GROUP BY 1),
l AS (SELECT gid, label, (list_dot_product(vec{_D}, s) - list_dot_product(vec{_D}, vec{_D})) / (n - 1) AS loo FROM p JOIN s USING (label) JOIN n USING (label))
SELECT gid, round(loo, 6) AS loo, loo >= avg(loo) OVER w - stddev_pop(loo) OVER w - 1e-12 OR row_number() OVER (PARTITION BY label ORDER BY loo DESC, gid) = 1 AS keep FROM l WINDOW w AS (PARTITION BY label)""")
def rofa_filter(t: Inputs) -> DataFrame:
    """W6"""
    return trk.rofa_filter(t(POINTS), "label", "gid", "vec", 1.0).select("gid", F.round("loo", 6).alias("loo"), "keep")


@query(f"WITH c AS ({CONTRIBS}), v AS (SELECT seg_id AS track, view_id, sum(weight) AS v FROM c GROUP BY ALL), o AS (SELECT track, sum(v) AS support, count(*) AS views, sum(v) * sum(v) / greatest(sum(v * v), 1e-8) AS eff FROM v GROUP BY 1) SELECT track, round(support, 4) AS support, views, round(eff, 6) AS eff_views, round(eff / (eff + 1), 7) AS view_share FROM o")
def track_statistics(t: Inputs) -> DataFrame:
    """A31"""
    s = trk.track_statistics(t(CONTRIBS).select(F.col("seg_id").alias("track"), "view_id", F.col("weight").alias("w")))
    return s.select("track", F.round("support", 4).alias("support"), "views", F.round("eff_views", 6).alias("eff_views"), F.round("view_share", 7).alias("view_share"))


@query(f"WITH c AS ({CONTRIBS}), p AS ({_POS}), m AS (SELECT seg_id, gid, sum(weight) AS w FROM c GROUP BY ALL), s AS (SELECT seg_id, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * z) / sum(w) AS cz, sum(w * (x * x + y * y + z * z)) / sum(w) AS m2 FROM m JOIN p USING (gid) GROUP BY 1) SELECT seg_id, round(cx, 5) AS cx, round(cz, 5) AS cz, round(sqrt(greatest(m2 - cx * cx - cy * cy - cz * cz, 0)), 5) AS radius FROM s")
def segment_centroid_radius(t: Inputs) -> DataFrame:
    """A12"""
    s = trk.spatial_statistics(t(CONTRIBS), _pos(t), ["seg_id"])
    return s.select("seg_id", F.round("cx", 5).alias("cx"), F.round("cz", 5).alias("cz"), F.round("radius", 5).alias("radius"))


@query(f"WITH c AS ({CONTRIBS}), m AS (SELECT view_id, gid, seg_id, sum(weight) AS m FROM c GROUP BY ALL), d AS (SELECT view_id, gid, seg_id FROM m QUALIFY row_number() OVER (PARTITION BY view_id, gid ORDER BY m DESC, seg_id) = 1), l AS (SELECT lag(view_id * 1000 + seg_id) OVER (PARTITION BY gid ORDER BY view_id) AS a, view_id * 1000 + seg_id AS b FROM d) SELECT a, b, count(*) AS n FROM l WHERE a IS NOT NULL GROUP BY ALL")
def last_node_links(t: Inputs) -> DataFrame:
    """G4"""
    m = t(CONTRIBS).groupBy("view_id", "gid", "seg_id").agg(F.sum("weight").alias("m"))
    d = trk.first_rows(m, ["view_id", "gid"], [F.col("m").desc(), F.col("seg_id")]).withColumn("node", F.col("view_id") * 1000 + F.col("seg_id"))
    return trk.last_node_links(d).select("a", "b", "n")


@query(f"""WITH c AS ({CONTRIBS}), m AS (SELECT seg_id, gid, sum(weight) AS w, max(tax) AS sem FROM c GROUP BY ALL), p AS (SELECT *, CASE WHEN gid % 4 <> 0 THEN sem END AS s, row_number() OVER (PARTITION BY seg_id ORDER BY w DESC, gid) AS rw FROM m QUALIFY rw <= 40),
k AS (SELECT *, greatest(1, ceil(0.25 * count(*) OVER (PARTITION BY seg_id))) AS keep, row_number() OVER (PARTITION BY seg_id ORDER BY s DESC NULLS LAST, gid) AS rs FROM p) SELECT seg_id, gid, rw > keep AS rescued FROM k WHERE rw <= keep OR (rs <= keep AND s IS NOT NULL)""")
def saga_union(t: Inputs) -> DataFrame:
    """K5, K3"""
    m = t(CONTRIBS).groupBy("seg_id", "gid").agg(F.sum("weight").alias("w"), F.max("tax").alias("sem")).withColumn("s", F.when(F.col("gid") % 4 != 0, F.col("sem")))
    return trk.geometry_semantic_union(m, ["seg_id"], 40, 0.25, "w", "s").select("seg_id", "gid", "rescued")


@query(f"WITH a AS ({_SIG % 0}), b AS ({_SIG % 1}) SELECT node, gid, round(max(w), 6) AS w FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def signature_union(t: Inputs) -> DataFrame:
    """A29"""
    return t(_SIG % 0).unionByName(t(_SIG % 1)).groupBy("node", "gid").agg(F.round(F.max("w"), 6).alias("w"))


@query(f"WITH s AS (SELECT node, gid, w FROM ({_SIG % 0}) q), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, gid) AS k FROM s QUALIFY k <= 10) SELECT node, gid, round(w / sum(w) OVER (PARTITION BY node), 7) AS w FROM r")
def sparse_top_renormalised(t: Inputs) -> DataFrame:
    """K7"""
    r = trk.first_rows(t(_SIG % 0), ["node"], [F.col("w").desc(), F.col("gid")], 10)
    return r.select("node", "gid", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("node")), 7).alias("w"))


@query("WITH s AS (SELECT p_partkey AS gid, p_size AS g, p_retailprice > 950 AS c FROM {part}) SELECT gid, round(CASE WHEN count(*) OVER w > 1 AND c THEN (sum(c::INT) OVER w - c::INT) / (count(*) OVER w - 1) ELSE 0 END, 8) AS support FROM s WINDOW w AS (PARTITION BY g)")
def loo_component_support(t: Inputs) -> DataFrame:
    """A27"""
    s = t("SELECT p_partkey AS gid, p_size AS g, p_retailprice > 950 AS c FROM {part}")
    return sp.leave_one_out_support(s, "g", F.col("c")).select("gid", F.round("support", 8).alias("support"))


@query("WITH s AS (SELECT p_size, count(*) AS size FROM {part} GROUP BY 1) SELECT count(*) AS components, quantile_cont(size, 0.5) AS median, quantile_cont(size, 0.9) AS p90, max(size) AS largest, avg((size = 1)::INT)::DOUBLE AS singletons FROM s")
def component_diagnostics(t: Inputs) -> DataFrame:
    """A28, A32"""
    return sp.component_diagnostics(t("SELECT p_size, count(*) AS size FROM {part} GROUP BY 1"))


_KNN = f"p AS ({_POS}), d AS (SELECT a.gid, b.gid AS neighbour, {_DIST2} AS d2 FROM p a JOIN p b ON a.gid <> b.gid), k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY round(d2, 9), neighbour) AS rank FROM d QUALIFY rank <= 4)"


@query(f"WITH {_KNN} SELECT gid, rank::INT AS rank, round(d2, 6) AS d2 FROM k")
def knn_exact(t: Inputs) -> DataFrame:
    """J12"""
    p = _pos(t)
    return sp.knn(p, p, 4, 3, 1.5).select("gid", "rank", F.round("d2", 6).alias("d2"))


@query(f"WITH {_KNN} SELECT gid, round(avg(d2), 6) AS mean_d2 FROM k WHERE rank <= 3 GROUP BY 1")
def knn_mean3(t: Inputs) -> DataFrame:
    """J13"""
    return sp.mean_nearest(_pos(t), 3, 1.5).select("gid", F.round("mean_d2", 6).alias("mean_d2"))


@query(f"WITH p AS ({_POS}), n AS (SELECT a.gid, min({_DIST2}) AS d2 FROM p a JOIN p b ON a.gid % 3 = 0 AND b.gid % 3 <> 0 GROUP BY 1), f AS (SELECT *, row_number() OVER (ORDER BY d2, gid) AS r FROM n) SELECT gid, round(d2, 6) AS d2 FROM f WHERE r <= 50")
def nearest_fill(t: Inputs) -> DataFrame:
    """J14"""
    p = _pos(t)
    near = sp.nearest_fill(p.where("gid % 3 = 0"), p.where("gid % 3 <> 0"), 50, 3, 1.5)
    return near.select("gid", F.round("d2", 6).alias("d2"))


#: Whole positions, whose distances tie exactly, with vectors.
_WHOLE = f"SELECT p_partkey AS gid, CAST(p_partkey * 37 % 101 AS DOUBLE) AS x, CAST(p_partkey * 53 % 97 AS DOUBLE) AS y, CAST(p_partkey * 71 % 89 AS DOUBLE) AS z, vec, label < 4 AS hit FROM {{part}} JOIN ({POINTS}) e0 ON gid = p_partkey"
_COS = "list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 1e-8)"


def _whole(t: Inputs) -> DataFrame:
    return t(_WHOLE).select("gid", F.array("x", "y", "z").alias("pos"), "vec", "hit")


@query(f"WITH p AS (SELECT gid, x, y, z, vec{_D} AS v FROM ({_WHOLE}) w0), d AS (SELECT a.gid, b.gid AS source, sqrt({_DIST2}) AS d, b.v FROM p a JOIN p b ON a.gid % 3 = 0 AND b.gid % 3 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY d, source) AS r FROM d QUALIFY r <= 2), o AS (SELECT gid, max(source) FILTER (r = 1) AS s1, max(source) FILTER (r = 2) AS s2, max(d) FILTER (r = 1) AS d1, max(d) FILTER (r = 2) AS d2, any_value(v) FILTER (r = 1) AS v1, any_value(v) FILTER (r = 2) AS v2 FROM k GROUP BY 1), h AS (SELECT *, CASE WHEN s2 IS NOT NULL AND {_COS.format(a='v1', b='v2')} >= 0 AND d2 <= 3 * greatest(d1, 1e-8) THEN round_even(255 * d2 / greatest(d1 + d2, 1e-8), 0)::INT ELSE 255 END AS share FROM o) SELECT gid, s1 AS source, share AS weight FROM h WHERE share > 0 UNION ALL SELECT gid, s2, 255 - share FROM h WHERE share < 255")
def two_source_fill(t: Inputs) -> DataFrame:
    """J15, P9"""
    p = _whole(t)
    return sp.two_source_fill(p.where("gid % 3 = 0"), p.where("gid % 3 <> 0"), 3, 15.0, least_cos=0.0, most_ratio=3.0)


@query(f"WITH p AS (SELECT gid, x, y, z, hit, vec{_D} AS v FROM ({_WHOLE}) w0), d AS (SELECT a.gid, b.gid AS neighbour, {_DIST2} AS d2, {_COS.format(a='a.v', b='b.v')} AS cos, b.hit FROM p a JOIN p b ON a.gid <> b.gid), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY gid ORDER BY d2, neighbour) <= 8), w AS (SELECT gid, exp(-d2 / greatest(max(d2) OVER (PARTITION BY gid), 1e-12)) * (cos >= 0)::INT AS k, hit::INT AS h FROM k) SELECT gid, round(sum(k * h) / greatest(sum(k), 1e-12), 6) AS support, count(*) FILTER (k > 0) AS n FROM w GROUP BY 1")
def neighbour_support(t: Inputs) -> DataFrame:
    """J16"""
    p = _whole(t)
    return sp.neighbour_support(sp.knn(p, p, 8, 3, 15.0), p, "hit", 0.0).select("gid", F.round("support", 6).alias("support"), "n")


_EDGES = "SELECT DISTINCT l_partkey AS a, (l_partkey + l_suppkey * 13) % 2000 + 1 AS b FROM {lineitem} WHERE l_quantity > 49 AND l_discount > 0.08"


@query(f"WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM s UNION SELECT s.b, r.seen FROM r JOIN s ON s.a = r.node) SELECT node, min(seen) AS label FROM r GROUP BY 1")
def connected_components(t: Inputs) -> DataFrame:
    """G1"""
    return graph.components(t(_EDGES))


@query()
def bounded_union_find(t: Inputs) -> DataFrame:
    """No component over the bound"""
    e = t(_EDGES).withColumn("scene", F.col("a") % _SCENE)
    return sp.bounded_components(e, "scene", ["a", "b"], 8).select("scene", "node", "component", "size")


#: Segments of views as nodes, in scenes by point; a node's vector is its segment's.
_SCENE = 16


def _nodes(t: Inputs) -> DataFrame:
    """(scene, view, seg, node, ids, ws, mass, vec): what a scene's segments hold."""
    m = t(CONTRIBS).groupBy((F.col("gid") % _SCENE).alias("scene"), F.col("view_id").alias("view"), F.col("seg_id").alias("seg"), "gid").agg(F.sum("weight").alias("w"))
    m = m.groupBy("scene", "view", "seg").agg(F.sort_array(F.collect_list(F.struct("gid", "w"))).alias("o"), F.sum("w").alias("mass"))
    v = t("SELECT vec_id + 1 AS seg, embedding AS vec FROM {embeddings}").withColumn("vec", as_double("vec"))
    return m.join(v, "seg").select("scene", "view", "seg", (F.col("view") * 1000 + F.col("seg")).alias("node"), F.transform("o", lambda x: x["gid"]).alias("ids"), F.transform("o", lambda x: x["w"]).alias("ws"), "mass", "vec")


@query()
def trace_memory_tracks(t: Inputs) -> DataFrame:
    """Held against plain code in the tests"""
    return trk.trace_memory(_nodes(t), "scene", 0.2, 0.1, 50).select("scene", "node", "track")


@query()
def incremental_groups(t: Inputs) -> DataFrame:
    """Held against plain code in the tests"""
    m = _nodes(t).withColumnRenamed("node", "mask").withColumnRenamed("view", "place")
    return trk.lift_groups(m, "scene", 0.02, 0.1, 0.5, 0.3, 200).select("scene", "mask", "group_id", "count", "size", F.round("mass", 4).alias("mass"))


_NODES = f"""c AS ({CONTRIBS}), m AS (SELECT view_id, seg_id, gid, sum(weight) AS m FROM c GROUP BY ALL), n AS (SELECT view_id, view_id * 1000 + seg_id AS node, gid, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY view_id, seg_id)), 1e-8) AS w FROM m),
nv AS (SELECT view_id, node, support, vec::DOUBLE[] AS vec FROM (SELECT view_id, seg_id, view_id * 1000 + seg_id AS node, sum(m) AS support FROM m GROUP BY ALL) JOIN (SELECT vec_id + 1 AS seg_id, embedding AS vec FROM {{embeddings}}) USING (seg_id)),
ov AS (SELECT a.view_id AS va, a.node AS a, b.node AS b, sum(a.w * b.w) AS o FROM n a JOIN n b ON a.gid = b.gid AND b.view_id < a.view_id AND b.view_id >= a.view_id - 2 GROUP BY ALL HAVING sum(a.w * b.w) >= 0.03),
sl AS (SELECT va, a, b, o * least(greatest((list_dot_product(x.vec, y.vec) - 0.05) / 0.95, 0), 1) AS score FROM ov JOIN nv x ON x.node = a JOIN nv y ON y.node = b WHERE list_dot_product(x.vec, y.vec) >= 0.05),
lk AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS ra, row_number() OVER (PARTITION BY va, b ORDER BY score DESC, a) AS rb FROM sl WHERE score > 0) WHERE ra = 1 AND rb = 1)"""


def _links(t: Inputs) -> tuple[DataFrame, DataFrame]:
    c = t(CONTRIBS)
    sig = trk.signatures(c, ["view_id", "seg_id"]).select(F.col("view_id").alias("view"), (F.col("view_id") * 1000 + F.col("seg_id")).alias("node"), "gid", "w")
    v = t("SELECT vec_id + 1 AS seg_id, embedding AS vec FROM {embeddings}").withColumn("vec", as_double("vec"))
    nodes = c.groupBy("view_id", "seg_id").agg(F.sum("weight").alias("support")).join(v, "seg_id").select((F.col("view_id") * 1000 + F.col("seg_id")).alias("node"), F.col("view_id").alias("view"), "vec", "support")
    return nodes, trk.windowed_links(sig, nodes, 2, 0.03, 0.05)


@query(f"WITH {_NODES} SELECT a, b, round(score, 6) AS score FROM lk")
def windowed_links(t: Inputs) -> DataFrame:
    """Each view's nodes against the pooled two views before"""
    return _links(t)[1].select("a", "b", F.round("score", 6).alias("score"))


_TRACKS = f"""WITH RECURSIVE {_NODES}, ed AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), rc(node, seen) AS (SELECT a, a FROM ed UNION SELECT ed.b, rc.seen FROM rc JOIN ed ON ed.a = rc.node),
lb AS (SELECT node, min(seen) AS root FROM rc GROUP BY 1), tn AS (SELECT nv.*, coalesce(root, nv.node) AS root FROM nv LEFT JOIN lb ON lb.node = nv.node), sm AS ({vsum("tn", "root")}),
lo AS (SELECT tn.*, sm.w AS n, CASE WHEN sm.w > 1 THEN (list_dot_product(vec, s) - list_dot_product(vec, vec)) / (sm.w - 1) ELSE 1 END AS loo FROM tn JOIN sm USING (root)),
kp AS (SELECT *, n = 1 OR loo >= avg(loo) OVER w - stddev_pop(loo) OVER w - 1e-12 OR row_number() OVER (PARTITION BY root ORDER BY loo DESC, node) = 1 AS keep FROM lo WINDOW w AS (PARTITION BY root)),
su AS (SELECT *, CASE WHEN keep THEN support ELSE 0 END AS own FROM kp), im AS (SELECT *, CASE WHEN sum(own) OVER (PARTITION BY root) > 0 THEN own / sum(own) OVER (PARTITION BY root) ELSE 1.0 / count(*) OVER (PARTITION BY root) END AS imp FROM su),
fx AS ({vsum("im", "root", "imp")}), ft AS (SELECT root, {unit("s")} AS f FROM fx), pv AS (SELECT root, count(*) AS views, sum(v) * sum(v) / greatest(sum(v * v), 1e-12) AS eff FROM (SELECT root, view_id, sum(imp) AS v FROM im WHERE imp > 0 GROUP BY ALL) GROUP BY 1),
tr AS (SELECT root, sum(own) AS support, sum(imp * list_dot_product(vec, f)) / greatest(sum(imp), 1e-12) AS conc, any_value(f) AS f FROM im JOIN ft USING (root) GROUP BY 1),
ok AS (SELECT *, row_number() OVER (ORDER BY root) - 1 AS track FROM tr JOIN pv USING (root) WHERE support >= 1000 AND views >= 2)"""


@query(_TRACKS + " SELECT track, root, round(support, 4) AS support, views, round(eff, 6) AS eff_views, round(conc, 6) AS concentration, round(least(greatest(conc, 0), 1) * eff / (eff + 1), 6) AS reliability, round(f[1], 6) AS first FROM ok")
def track_build(t: Inputs) -> DataFrame:
    """Components, outliers out, importance by support, filters, reliability, compact ids"""
    out = trk.build_tracks(*_links(t), least_support=1000.0, least_views=2)[0]
    return out.select("track", "root", F.round("support", 4).alias("support"), "views", *(F.round(c, 6).alias(c) for c in ("eff_views", "concentration", "reliability")), F.round(F.col("feature")[0], 6).alias("first"))


@query(_TRACKS + " SELECT kp.node, CASE WHEN keep THEN coalesce(track, -1) ELSE -1 END AS track FROM kp LEFT JOIN ok USING (root)")
def segment_tracks(t: Inputs) -> DataFrame:
    """The track of each segment; -1 for outliers and tracks that are filtered out"""
    return trk.build_tracks(*_links(t), least_support=1000.0, least_views=2)[1].select("node", F.coalesce("track", F.lit(-1)).alias("track"))


@query()
def node_importance(t: Inputs) -> DataFrame:
    """Information and agreement within a KL region; held against plain code in the tests"""
    nodes, _ = _links(t)
    return trk.node_importance(nodes.withColumn("track", F.col("node") % 100), "information_kl", 0.5, 0.05, 3.0).select("track", "node", F.round("importance", 7).alias("importance"))


@query(f"WITH c AS ({CONTRIBS}), m AS (SELECT view_id, gid, seg_id, sum(weight) AS m FROM c GROUP BY ALL), d AS (SELECT view_id, gid, seg_id, m FROM m QUALIFY row_number() OVER (PARTITION BY view_id, gid ORDER BY m DESC, seg_id) = 1) SELECT gid, seg_id % 9 AS track, round(m, 4) AS support FROM d WHERE seg_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY gid ORDER BY m DESC, view_id) = 1")
def best_view_tracks(t: Inputs) -> DataFrame:
    """G9"""
    m = t(CONTRIBS).groupBy("view_id", "gid", "seg_id").agg(F.sum("weight").alias("m"))
    d = trk.first_rows(m, ["view_id", "gid"], [F.col("m").desc(), F.col("seg_id")])
    d = d.select(F.col("view_id").alias("view"), "gid", F.when(F.col("seg_id") % 4 != 0, F.col("seg_id") % 9).alias("track"), F.col("m").alias("support"))
    return trk.best_view_tracks(d).select("gid", "track", F.round("support", 4).alias("support"))


@query(f"WITH c AS ({CONTRIBS}), o AS (SELECT gid, seg_id % 9 AS track, sum(weight) AS score FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC, track) - 1 AS slot FROM o QUALIFY slot < 3) SELECT gid, slot::INT AS slot, track, round(score / sum(score) OVER (PARTITION BY gid), 7) AS score FROM k")
def point_tracks(t: Inputs) -> DataFrame:
    """Summed scores, the three best, as shares"""
    rows = t(CONTRIBS).select("gid", (F.col("seg_id") % 9).alias("track"), F.col("weight").alias("score"))
    return trk.aggregate_point_tracks(rows, 3).select("gid", F.col("slot").cast("int").alias("slot"), "track", F.round("score", 7).alias("score"))


_GROUPS = f"c AS ({CONTRIBS}), gm AS (SELECT seg_id AS group_id, gid, sum(weight) / 50 AS w FROM c GROUP BY ALL), gr AS (SELECT vec_id + 1 AS group_id, embedding AS vec, vec_id % 5 + 1 AS n FROM {{embeddings}}), sc AS (SELECT gid, group_id, w * sqrt(n) AS score, vec FROM gm JOIN gr USING (group_id) WHERE n >= 2), rk AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC, group_id) AS r FROM sc), tp AS (SELECT gid, max(group_id) FILTER (r = 1) AS group_id, max(score) FILTER (r = 1) AS best, coalesce(max(score) FILTER (r = 2), 0) AS second FROM rk GROUP BY 1 HAVING best - second >= 0.05)"


def _assigned(t: Inputs, mode: str) -> DataFrame:
    groups = t("SELECT vec_id + 1 AS group_id, embedding AS feature, vec_id % 5 + 1 AS count FROM {embeddings}")
    members = t(CONTRIBS).groupBy(F.col("seg_id").alias("group_id"), "gid").agg((F.sum("weight") / 50).alias("w"))
    a = trk.assign_groups(groups, members, mode, 2, 1.5, 0.0, 0.05)
    return a.select("gid", "group_id", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"), F.round(F.col("feature")[0].cast("double"), 6).alias("first"))


@query(f"WITH {_GROUPS} SELECT gid, group_id, round(best, 6) AS best, round(second, 6) AS second, round(vec[1]::DOUBLE, 6) AS first FROM tp JOIN gr USING (group_id)")
def group_assignment_hard(t: Inputs) -> DataFrame:
    """G11 (hard)"""
    return _assigned(t, "hard")


@query(f"WITH {_GROUPS}, sf AS ({vsum('(SELECT gid, vec, pow(score, 1.5) AS sw FROM sc)', 'gid', 'sw')}) SELECT gid, group_id, round(best, 6) AS best, round(second, 6) AS second, round(s[1] / greatest(sqrt(list_dot_product(s, s)), 1e-9), 6) AS first FROM tp JOIN sf USING (gid)")
def group_assignment_soft(t: Inputs) -> DataFrame:
    """G11 (soft)"""
    return _assigned(t, "soft")


_PC = "SELECT vec_id AS gid, 0 AS level, vec_id % 8 AS code_id FROM {embeddings} UNION ALL SELECT vec_id, 1, 8 + vec_id % 5 FROM {embeddings} WHERE vec_id % 7 <> 0"


@query(f"WITH pc AS ({_PC}), e AS (SELECT vec_id AS code_id, embedding AS vec FROM {{embeddings}} WHERE vec_id < 32), k AS (SELECT DISTINCT l_partkey AS gid, l_suppkey AS seg_id FROM {{lineitem}}), x AS ({vsum('(SELECT gid, vec FROM pc JOIN e USING (code_id))', 'gid')}), h AS (SELECT gid, count(DISTINCT level) = 2 AS good FROM pc GROUP BY 1), v AS (SELECT vec_id + 1 AS seg_id, embedding::DOUBLE[] AS vec FROM {{embeddings}}) SELECT k.gid, k.seg_id, round(CASE WHEN good THEN list_dot_product(s, vec) / greatest(sqrt(list_dot_product(s, s)) * sqrt(list_dot_product(vec, vec)), 1e-8) END, 6) AS score FROM k JOIN v USING (seg_id) LEFT JOIN x ON x.gid = k.gid LEFT JOIN h ON h.gid = k.gid")
def code_scorer(t: Inputs) -> DataFrame:
    """points' codes against segments; null stands for points that lack a level"""
    codes = t("SELECT vec_id AS code_id, embedding AS vec FROM {embeddings} WHERE vec_id < 32").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("level"), "code_id", "vec")
    k = t("SELECT DISTINCT l_partkey AS gid, l_suppkey AS seg_id FROM {lineitem}")
    s = trk.semantic_scores(k, t(_PC), codes, t("SELECT vec_id + 1 AS seg_id, embedding AS vec FROM {embeddings}"), 2)
    return s.select("gid", "seg_id", F.when(F.col("score") != float("-inf"), F.round("score", 6)).alias("score"))


@query()
def box_suppression(t: Inputs) -> DataFrame:
    """K10, P21"""
    b = t("SELECT p_partkey % 20 AS image, p_partkey AS box, CAST(p_partkey * 7 % 50 AS DOUBLE) AS x0, CAST(p_partkey * 11 % 50 AS DOUBLE) AS y0, CAST(p_partkey * 7 % 50 + 10 + p_size % 9 AS DOUBLE) AS x1, CAST(p_partkey * 11 % 50 + 12 AS DOUBLE) AS y1, p_retailprice AS score FROM {part}")
    return trk.box_nms(b, "image", 0.3).select("image", "box")


_MASKS = "SELECT DISTINCT p_partkey % 6 AS image, p_size % 7 AS mask, p_partkey % 13 AS px, p_partkey % 11 AS py FROM {part}"


@query(f"""WITH p AS ({_MASKS}), a AS (SELECT image, mask, count(*) AS area FROM p GROUP BY ALL), s AS (SELECT *, (mask * 3 % 7) / 7.0 AS score FROM a), b AS (SELECT x.image, x.mask AS a, y.mask AS b, count(*) AS n FROM p x JOIN p y ON x.image = y.image AND x.px = y.px AND x.py = y.py AND x.mask <> y.mask GROUP BY ALL),
bad AS (SELECT DISTINCT b.image, b.b AS mask FROM b JOIN s sa ON sa.image = b.image AND sa.mask = b.a JOIN s sb ON sb.image = b.image AND sb.mask = b.b WHERE (sa.score > sb.score OR (sa.score = sb.score AND b.a < b.b)) AND (n / (sa.area + sb.area - n) > 0.25 OR n / sb.area > 0.5))
SELECT s.image, s.mask, round(s.score, 6) AS score FROM s ANTI JOIN bad USING (image, mask) WHERE s.score > 0.1""")
def mask_suppression(t: Inputs) -> DataFrame:
    """K9"""
    p = t(_MASKS)
    s = p.select("image", "mask").distinct().withColumn("score", (F.col("mask") * 3 % 7) / 7.0)
    return trk.mask_nms(p, s, ["image"], 0.25, 0.5, 0.1).select("image", "mask", F.round("score", 6).alias("score"))


@query()
def small_regions(t: Inputs) -> DataFrame:
    """G14"""
    p = t("SELECT DISTINCT p_size % 4 AS image, p_partkey % 37 AS px, p_partkey % 31 AS py FROM {part}")
    return ev.small_regions(p, "image", 4)


@query("""WITH r AS (SELECT l_suppkey AS group_id, l_linenumber AS view_id, sum(l_quantity) AS support, avg(l_discount) AS score FROM {lineitem} GROUP BY ALL), b AS (SELECT *, support / sum(support) OVER w AS base FROM r WINDOW w AS (PARTITION BY group_id)), t AS (SELECT *, base * exp(5 * (0.9 * 0.05 + (1 - 0.9) * score)) AS tilt FROM b), q AS (SELECT *, base * least(greatest(tilt / sum(tilt) OVER (PARTITION BY group_id) / base, 1 / 1.01), 1.01) AS p FROM t)
SELECT group_id, view_id, round(p / sum(p) OVER (PARTITION BY group_id), 7) AS p FROM q""")
def view_importance(t: Inputs) -> DataFrame:
    """K12, P5"""
    r = t("SELECT l_suppkey AS group_id, l_linenumber AS view_id, sum(l_quantity) AS support, avg(l_discount) AS score, 0.05D AS last FROM {lineitem} GROUP BY 1, 2")
    return sample.view_importance(r, 1.01, 5.0, 0.9).select("group_id", "view_id", F.round("p", 7).alias("p"))


@query(f"WITH p AS ({POINTS}), r AS (SELECT a.gid, list_dot_product(a.vec{_D}, b.vec{_D}) AS s, b.gid AS g FROM p a JOIN p b ON b.gid < 10), k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY s DESC, g) AS r FROM r) SELECT gid, max(g) FILTER (r = 1) AS best, max(g) FILTER (r = 2) AS second, round(max(s) FILTER (r = 1) - max(s) FILTER (r = 2), 6) AS margin FROM k GROUP BY 1")
def best_second_margin(t: Inputs) -> DataFrame:
    """W4"""
    p = t(POINTS)
    c = p.where("gid < 10").agg(F.collect_list(F.struct(F.col("gid").alias("g"), F.col("vec").alias("c"))).alias("cs"))
    rows = p.join(F.broadcast(c), F.lit(True)).select("gid", F.col("vec").alias("v"), F.explode("cs").alias("e"))
    rows = rows.select("gid", F.col("e.g").alias("g"), dot("v", "e.c").alias("s"))
    k = trk.first_rows(rows, ["gid"], [F.col("s").desc(), F.col("g")], 2)
    pick = lambda r, x: F.max(F.when(F.col("rank") == r, F.col(x)))
    return k.groupBy("gid").agg(pick(1, "g").alias("best"), pick(2, "g").alias("second"), F.round(pick(1, "s") - pick(2, "s"), 6).alias("margin"))
