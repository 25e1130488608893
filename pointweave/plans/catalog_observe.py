"""Queries over contributions: visibility, weights, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions import geometry as geo
from pointweave.functions.vec import dot, l2_normalize
from pointweave.operators import consensus as con
from pointweave.operators import observe as obs
from pointweave.operators import track as trk
from pointweave.plans.registry import CONTRIBS, POINTS, Inputs, query

_ORDER = ["depth", "gid", "seg_id", "line", "weight", "tax"]
_O = "depth, gid, seg_id, line, weight, tax"
_SEGVEC = "SELECT vec_id + 1 AS seg_id, embedding AS vec FROM {embeddings}"
_SPLATS = "SELECT p_partkey AS gid, CAST(p_partkey % 97 AS DOUBLE) AS x, CAST(p_partkey % 61 AS DOUBLE) AS y, p_size AS r FROM {part}"


@query(f"""WITH s AS ({_SPLATS}), r AS (SELECT gid, least(8, greatest(0, trunc((x - r) / 16)))::INT AS x0, least(6, greatest(0, trunc((y - r) / 16)))::INT AS y0,
  least(8, greatest(0, trunc((x + r + 15) / 16)))::INT AS x1, least(6, greatest(0, trunc((y + r + 15) / 16)))::INT AS y1 FROM s)
SELECT tx AS tile_x, ty AS tile_y, count(*) AS n, min(gid) AS first, sum(gid)::BIGINT AS total FROM (SELECT gid, tx, unnest(range(y0, y1)) AS ty FROM (SELECT gid, y0, y1, unnest(range(x0, x1)) AS tx FROM r) a) b GROUP BY 1, 2""")
def tile_expand(t: Inputs) -> DataFrame:
    """J1"""
    s = t(_SPLATS)
    rect = geo.tile_rect(F.col("x"), F.col("y"), F.col("r"), F.lit(8), F.lit(6))
    tiles = obs.tile_expand(s.select("gid", *(c.alias(n) for c, n in zip(rect, ("x0", "y0", "x1", "y1"), strict=True))), "x0", "y0", "x1", "y1")
    return tiles.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"), F.min("gid").alias("first"), F.sum("gid").alias("total"))


_COMP = f"""WITH c AS ({CONTRIBS}), w AS (SELECT *, product(1 - alpha) OVER (PARTITION BY pixel_id ORDER BY {_O} ROWS UNBOUNDED PRECEDING) AS t_after,
  row_number() OVER (PARTITION BY pixel_id ORDER BY {_O}) - 1 AS slot FROM c), k AS (SELECT *, alpha * t_after / (1 - alpha) AS w FROM w WHERE t_after >= 1e-4)"""


@query(_COMP + " SELECT pixel_id, slot::INT AS slot, gid, round(w, 8) AS weight FROM k WHERE slot < 4")
def ray_contributions(t: Inputs) -> DataFrame:
    """J2, W2"""
    return obs.composite(t(CONTRIBS), ["pixel_id"], _ORDER, most=4).select("pixel_id", F.col("slot").cast("int").alias("slot"), "gid", F.round("weight", 8).alias("weight"))


@query(_COMP + " SELECT pixel_id, round(sum(sqrt(tax + 1) * w) + 0.5 * min(t_after), 7) AS rendered FROM k GROUP BY 1")
def alpha_render(t: Inputs) -> DataFrame:
    """J3"""
    hits = obs.composite(t(CONTRIBS), ["pixel_id"], _ORDER, most=None)
    return obs.render(hits.withColumn("shade", F.sqrt(F.col("tax") + 1)), ["pixel_id"], "shade", 0.5).select("pixel_id", F.round("rendered", 7).alias("rendered"))


@query("""SELECT r.px, r.py, s.s_name AS name, r.w FROM (SELECT l_orderkey AS px, l_linenumber AS py, l_suppkey AS seg_id, sum(l_quantity) AS w FROM {lineitem} GROUP BY 1, 2, 3) r LEFT JOIN (SELECT * FROM {supplier} WHERE s_suppkey % 3 <> 0) s ON s.s_suppkey = r.seg_id WHERE s.s_suppkey IS NOT NULL""")
def pixel_segment_join(t: Inputs) -> DataFrame:
    """J4, S2, S24"""
    rows = t("SELECT l_orderkey AS px, l_linenumber AS py, l_suppkey AS seg_id, sum(l_quantity) AS w FROM {lineitem} GROUP BY 1, 2, 3")
    return rows.join(t("SELECT s_suppkey AS seg_id, s_name AS name FROM {supplier} WHERE s_suppkey % 3 <> 0"), "seg_id").select("px", "py", "name", "w")


@query(f"""WITH c AS ({CONTRIBS}) SELECT pixel_id, gid, rank::INT AS rank, weight FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY weight DESC, {_O.replace(', weight', '')}) AS rank FROM c) WHERE rank <= 2""")
def topk_contributors(t: Inputs) -> DataFrame:
    """K1"""
    order = [F.col("weight").desc(), *(F.col(c) for c in _ORDER if c != "weight")]
    return obs.top_contributors(t(CONTRIBS), ["pixel_id"], 2, order).select("pixel_id", "gid", F.col("rank").cast("int").alias("rank"), "weight")


@query(f"""WITH c AS ({CONTRIBS}), w AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY pixel_id ORDER BY weight DESC, {_O.replace(', weight', '')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (PARTITION BY pixel_id) AS total, max(weight) OVER (PARTITION BY pixel_id) AS top, row_number() OVER (PARTITION BY pixel_id ORDER BY weight DESC, {_O.replace(', weight', '')}) AS r FROM c)
SELECT pixel_id, count(*) AS n, round(sum(weight), 6) AS mass, min(gid) AS first FROM w WHERE r <= 1 OR (before < 0.8 * total AND weight >= 0.3 * top) GROUP BY 1""")
def visibility_truncate(t: Inputs) -> DataFrame:
    """W1"""
    kept = obs.truncate_visibility(t(CONTRIBS), ["pixel_id"], [c for c in _ORDER if c != "weight"], 0.8, 0.3, 1)
    return kept.groupBy("pixel_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("mass"), F.min("gid").alias("first"))


_OWN = f"""WITH c AS ({CONTRIBS}), m AS (SELECT view_id, gid, seg_id, sum(weight) AS m FROM c GROUP BY ALL),
o AS (SELECT view_id, gid, sum(m) AS total, max(m) AS top, arg_max(seg_id, m * 1000000 - seg_id) AS owner FROM m GROUP BY ALL),
k AS (SELECT *, CASE WHEN total > 0 THEN least(greatest((2 * top - total) / total, 0), 1) ELSE 0 END AS conf FROM o)"""


@query(_OWN + " SELECT view_id, gid, owner, round(total, 6) AS total, round(conf, 8) AS confidence FROM k")
def signed_ownership(t: Inputs) -> DataFrame:
    """A13"""
    o = obs.signed_ownership(t(CONTRIBS), ["view_id"])
    return o.select("view_id", "gid", "owner", F.round("total", 6).alias("total"), F.round("confidence", 8).alias("confidence"))


@query(_OWN + " SELECT c.view_id, c.gid, count(*) AS n, round(sum(c.weight * k.conf), 6) AS mass FROM c JOIN k ON k.view_id = c.view_id AND k.gid = c.gid AND k.owner = c.seg_id AND k.conf > 0 GROUP BY ALL")
def ownership_gate(t: Inputs) -> DataFrame:
    """A13 (second half)"""
    c = t(CONTRIBS)
    kept = obs.apply_ownership(c, obs.signed_ownership(c, ["view_id"]), ["view_id"])
    return kept.groupBy("view_id", "gid").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("mass"))


@query()
def surface_responsibility(t: Inputs) -> DataFrame:
    """Held against plain code in the tests."""
    out = obs.surface_responsibility(t(CONTRIBS), ["pixel_id"], ["depth", "gid", "seg_id", "line"], 20000.0, 0.02)
    return out.groupBy("pixel_id").agg(F.round(F.sum("weight"), 6).alias("mass"), F.count("*").alias("n"))


@query("""SELECT l_suppkey AS px, count(*) AS n, round(min(l_extendedprice), 4) AS z FROM (SELECT *, min(l_extendedprice) OVER (PARTITION BY l_suppkey) AS near FROM {lineitem}) WHERE l_extendedprice <= near + 500 GROUP BY 1""")
def zbuffer_visible(t: Inputs) -> DataFrame:
    """J17"""
    seen = obs.nearest_visible(t("SELECT l_suppkey AS px, l_extendedprice AS z FROM {lineitem}"), ["px"], "z", 500.0)
    return seen.groupBy("px").agg(F.count("*").alias("n"), F.round(F.min("z"), 4).alias("z"))


_GRID = "SELECT p_partkey % 40 AS px, p_partkey // 40 AS py, (p_partkey % 40) // 9 + 10 * ((p_partkey // 40) // 11) AS seg_id FROM {part}"


@query(f"""WITH p AS ({_GRID}), e AS (SELECT DISTINCT a.px, a.py FROM p a JOIN p b ON abs(a.px - b.px) + abs(a.py - b.py) = 1 AND a.seg_id <> b.seg_id),
d AS (SELECT p.px, p.py, min(sqrt((p.px - e.px) * (p.px - e.px) + (p.py - e.py) * (p.py - e.py))) AS d FROM p, e GROUP BY ALL)
SELECT px, py, round(0.2 + 0.8 * least(d / 3, 1), 8) AS confidence FROM d""")
def interior_confidence(t: Inputs) -> DataFrame:
    """P14"""
    p = t(_GRID.replace("//", "div")).withColumn("image", F.lit(0))
    return obs.interior_confidence(p, 3, 0.2, ["image"]).select("px", "py", F.round("confidence", 8).alias("confidence"))


@query(f"""WITH c AS ({CONTRIBS}) SELECT gid, round(max(weight), 6) AS top, max(weight) >= 45 AS strong FROM c GROUP BY 1""")
def max_contribution(t: Inputs) -> DataFrame:
    """A14"""
    m = t(CONTRIBS).groupBy("gid").agg(F.max("weight").alias("m"))
    return m.select("gid", F.round("m", 6).alias("top"), (F.col("m") >= 45).alias("strong"))


_MEAN = f"""WITH c AS ({CONTRIBS}), g AS (SELECT gid, seg_id, sum(weight) AS w FROM c GROUP BY ALL), v AS ({_SEGVEC}),
x AS (SELECT gid, pos, sum(w * val) AS s, sum(w) AS tw FROM (SELECT gid, w, generate_subscripts(vec, 1) AS pos, unnest(vec::DOUBLE[]) AS val FROM g JOIN v USING (seg_id)) u GROUP BY ALL),
n AS (SELECT gid, sqrt(sum(s * s)) AS len, max(tw) AS tw FROM x GROUP BY 1)"""


@query(_MEAN + " SELECT n.gid, round(x.s / greatest(n.len, 1e-8), 6) AS first, round(n.tw, 6) AS total_w, round(n.len / n.tw, 6) AS mean_norm FROM n JOIN x ON x.gid = n.gid AND x.pos = 1")
def consensus_weighted_mean(t: Inputs) -> DataFrame:
    """A1, A2, A3, A5"""
    c = con.consensus(t(CONTRIBS), t(_SEGVEC), ["gid"])
    return c.select("gid", F.round(F.col("feature")[0], 6).alias("first"), F.round("total_w", 6).alias("total_w"), F.round("mean_norm", 6).alias("mean_norm"))


_SPLIT = f"""WITH c AS ({CONTRIBS}), g AS (SELECT gid, view_id % 2 AS split, seg_id, sum(weight) AS w FROM c GROUP BY ALL), v AS ({_SEGVEC}),
x AS (SELECT gid, split, pos, sum(w * val) AS s, sum(w) AS tw FROM (SELECT gid, split, w, generate_subscripts(vec, 1) AS pos, unnest(vec::DOUBLE[]) AS val FROM g JOIN v USING (seg_id)) u GROUP BY ALL),
a AS (SELECT * FROM x WHERE split = 0), b AS (SELECT * FROM x WHERE split = 1),
p AS (SELECT a.gid, max(a.tw) AS wa, max(b.tw) AS wb, sum(a.s * b.s) / greatest(sqrt(sum(a.s * a.s)) * sqrt(sum(b.s * b.s)), 1e-8) AS cos FROM a JOIN b ON a.gid = b.gid AND a.pos = b.pos GROUP BY 1)"""


def _splits(t: Inputs) -> DataFrame:
    c = con.consensus(t(CONTRIBS).withColumn("split", F.pmod("view_id", F.lit(2))), t(_SEGVEC), ["gid", "split"])
    side = lambda s, n: c.where(F.col("split") == s).select("gid", F.col("feature").alias(f"v{n}"), F.col("total_w").alias(f"w{n}"))
    return side(0, "a").join(side(1, "b"), "gid")


@query(_SPLIT + " SELECT gid, round(least(greatest((cos - 0.2) / 0.8, 0), 1) * sqrt(2 * least(wa, wb) / greatest(wa + wb, 1e-8)), 6) AS reliability, round(cos, 6) AS cos FROM p")
def split_reliability(t: Inputs) -> DataFrame:
    """A4, A23"""
    r = con.split_reliability(F.col("va"), F.col("vb"), F.col("wa"), F.col("wb"), 0.2)
    return _splits(t).select("gid", F.round(r, 6).alias("reliability"), F.round(dot("va", "vb"), 6).alias("cos"))


@query(_SPLIT + " SELECT gid, round(1 / (1 + exp(-((cos - 0.5) / 0.1))), 6) AS gate FROM p")
def fusion_gate(t: Inputs) -> DataFrame:
    """The gate of A24 alone; ``fuse_consensus`` is the operator"""
    return _splits(t).select("gid", F.round(con.fusion_gate(F.lit(0.5), dot("va", "vb"), 0.1), 6).alias("gate"))


@query(f"""WITH c AS ({CONTRIBS}), o AS (SELECT gid, view_id, sum(weight) AS w, sum(weight * sqrt(tax + 1)) AS s FROM c GROUP BY ALL), t AS (SELECT gid, sum(w) AS w, sum(s) AS s FROM o GROUP BY 1)
SELECT o.gid, o.view_id, round((t.s - o.s) / (t.w - o.w), 8) AS others FROM o JOIN t USING (gid) WHERE t.w - o.w > 1e-6""")
def leave_one_view_out(t: Inputs) -> DataFrame:
    """A34"""
    o = t(CONTRIBS).groupBy("gid", "view_id").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.sqrt(F.col("tax") + 1)).alias("s"))
    total = o.groupBy("gid").agg(F.sum("w").alias("tw"), F.sum("s").alias("ts"))
    rows = o.join(total, "gid").withColumn("others", con.leave_one_out(F.col("ts"), F.col("tw"), F.col("s"), F.col("w")))
    return rows.where("others is not null").select("gid", "view_id", F.round("others", 8).alias("others"))


@query(f"""WITH c AS ({CONTRIBS}) SELECT gid, round(avg(tax), 8) AS mean, count(*) AS votes FROM c GROUP BY 1 HAVING count(*) >= 25""")
def centre_votes(t: Inputs) -> DataFrame:
    """A6"""
    return t(CONTRIBS).groupBy("gid").agg(F.avg("tax").alias("m"), F.count("*").alias("votes")).where("votes >= 25").select("gid", F.round("m", 8).alias("mean"), "votes")


@query(f"""WITH c AS ({CONTRIBS}), m AS (SELECT gid, count(*) AS votes, sum(weight) AS mass FROM c GROUP BY 1), d AS (SELECT quantile_disc(votes, 0.5) AS md, quantile_cont(mass, 0.9) AS q FROM m)
SELECT gid, votes > md AS above, mass >= q AS heavy FROM m, d""")
def median_and_quantile(t: Inputs) -> DataFrame:
    """Lower median, linear quantile"""
    m = t(CONTRIBS).groupBy("gid").agg(F.count("*").alias("votes"), F.sum("weight").alias("mass"))
    d = m.agg(F.expr("percentile_disc(0.5) within group (order by votes)").alias("md"), F.percentile("mass", 0.9).alias("q"))
    return m.join(F.broadcast(d), F.lit(True)).select("gid", (F.col("votes") > F.col("md")).alias("above"), (F.col("mass") >= F.col("q")).alias("heavy"))


@query(f"""WITH c AS ({CONTRIBS}), m AS (SELECT gid, sum(weight) AS mass, max(tax) AS tax FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM m)
SELECT gid FROM (SELECT gid, row_number() OVER (ORDER BY mass DESC, gid) AS r FROM m WHERE tax > 0.05) , n WHERE r <= greatest(1, round_even(0.1 * n, 0))""")
def fine_selection(t: Inputs) -> DataFrame:
    """K4"""
    m = t(CONTRIBS).groupBy("gid").agg(F.sum("weight").alias("mass"), F.max("tax").alias("tax"))
    return con.top_fraction(m, 0.1, m.count(), "mass", "gid", F.col("tax") > 0.05).select("gid")


@query()
def geometric_median(t: Inputs) -> DataFrame:
    """Held against plain code in the tests."""
    rows = t(POINTS).select(F.pmod("gid", F.lit(50)).alias("k"), "vec", (F.col("label") + 1).cast("double").alias("w"))
    m = con.geometric_median(rows, ["k"], "vec", "w")
    return m.select("k", F.round(F.col("median")[0], 6).alias("first"), F.round(dot("median", "median"), 6).alias("length"))


@query(f"""WITH p AS ({POINTS}) SELECT a.label, round(avg(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[])), 6) AS agreement, count(*) AS n FROM p a JOIN p b ON b.gid = a.label GROUP BY 1""")
def group_agreement(t: Inputs) -> DataFrame:
    """Agreement of points with a centre, averaged"""
    p = t(POINTS)
    c = p.select(F.col("gid").alias("label"), F.col("vec").alias("centre"))
    return p.join(F.broadcast(c.where("label < 10")), "label").groupBy("label").agg(F.round(F.avg(dot("vec", "centre")), 6).alias("agreement"), F.count("*").alias("n"))


@query(f"""WITH p AS ({POINTS}), x AS (SELECT label, pos, sum(val * w) AS s FROM (SELECT label, (gid % 7 + 1) / 8.0 * ((gid % 7 + 1) / 8.0) AS w, generate_subscripts(vec, 1) AS pos, unnest(vec::DOUBLE[]) AS val FROM p) u GROUP BY ALL),
n AS (SELECT label, sqrt(sum(s * s)) AS len FROM x GROUP BY 1) SELECT label, round(s / len, 6) AS second FROM x JOIN n USING (label) WHERE pos = 2""")
def teacher_groups(t: Inputs) -> DataFrame:
    """A1: weighted by a power of a score"""
    rows = t(POINTS).withColumn("w", F.pow((F.pmod("gid", F.lit(7)) + 1) / 8.0, F.lit(2)))
    return con.vector_sum(rows, ["label"], "vec", "w").select("label", F.round(l2_normalize("s")[1], 6).alias("second"))


@query(f"""WITH c AS ({CONTRIBS}) SELECT view_id, gid, seg_id AS segment FROM (SELECT *, row_number() OVER (PARTITION BY view_id, gid ORDER BY m DESC, seg_id) AS r FROM (SELECT view_id, gid, seg_id, sum(weight) AS m FROM c WHERE line = 1 GROUP BY ALL)) WHERE r = 1""")
def dominant_segment(t: Inputs) -> DataFrame:
    """A33"""
    m = t(CONTRIBS).where("line = 1").groupBy("view_id", "gid", "seg_id").agg(F.sum("weight").alias("m"))
    return trk.first_rows(m, ["view_id", "gid"], [F.col("m").desc(), F.col("seg_id")]).select("view_id", "gid", F.col("seg_id").alias("segment"))


@query("""WITH v AS (SELECT c_custkey AS v, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM {customer}), m AS (SELECT avg(x) AS mx, avg(y) AS my FROM v)
SELECT round(mx, 6) AS cx, round(my, 6) AS cy, round(1.1 * max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))), 6) AS radius FROM v, m GROUP BY ALL""")
def scene_normalisation(t: Inputs) -> DataFrame:
    """A36"""
    v = t("SELECT c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM {customer}")
    m = v.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")))
    return v.join(F.broadcast(m), F.lit(True)).groupBy("mx", "my").agg((1.1 * F.max(d)).alias("r")).select(F.round("mx", 6).alias("cx"), F.round("my", 6).alias("cy"), F.round("r", 6).alias("radius"))


@query(f"""WITH c AS ({CONTRIBS}), m AS (SELECT gid, seg_id, sum(weight) AS m FROM c GROUP BY ALL), e AS (SELECT *, exp((m - max(m) OVER (PARTITION BY gid)) / 10) AS e FROM m)
SELECT gid, seg_id, round(e / sum(e) OVER (PARTITION BY gid), 8) AS p FROM e QUALIFY row_number() OVER (PARTITION BY gid ORDER BY m DESC, seg_id) = 1""")
def row_softmax(t: Inputs) -> DataFrame:
    """A30"""
    m = t(CONTRIBS).groupBy("gid", "seg_id").agg(F.sum("weight").alias("m"))
    w = Window.partitionBy("gid")
    e = m.withColumn("e", F.exp((F.col("m") - F.max("m").over(w)) / 10)).withColumn("p", F.col("e") / F.sum("e").over(w))
    return trk.first_rows(e, ["gid"], [F.col("m").desc(), F.col("seg_id")]).select("gid", "seg_id", F.round("p", 8).alias("p"))
