"""Queries over views and their banks: association, sampling, consistency, colours, blends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions import geometry as geo
from pointweave.functions.vec import as_double, cosine, l2_normalize, sigmoid
from pointweave.operators import codebook as cb
from pointweave.operators import consensus as con
from pointweave.operators import evaluate as ev
from pointweave.operators import query as qry
from pointweave.operators import sample
from pointweave.operators import spatial as sp
from pointweave.operators import track as trk
from pointweave.plans import sqltext as q
from pointweave.plans.catalog_query import _SCORES, _scores
from pointweave.plans.catalog_track import _MEM, _PC, _SCENE, _pos
from pointweave.plans.registry import CONTRIBS, POINTS, Inputs, query
from pointweave.plans.storage import fresh_path

#: Product codes of two checkpoints over nine centroids in each of four parts.
_PQ = "SELECT vec_id AS gid, s.sub, CASE WHEN vec_id % {bad} = 0 THEN 255 ELSE (vec_id * {k} + s.sub * 3) % 9 END AS code FROM {{embeddings}}, (SELECT unnest(range(0, 4)) AS sub) s"
_PQA, _PQB = _PQ.format(bad=11, k=7), _PQ.format(bad=6, k=5)
_CEN = "SELECT vec_id % 9 AS code, vec_id // 9 AS sub, embedding[1:4]::DOUBLE[] AS v FROM {embeddings} WHERE vec_id < 36"


def _dec(name: str, codes: str) -> str:
    return f"{name}j AS (SELECT gid, sub, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM ({codes}) JOIN ce USING (sub, code) WHERE code <> 255), {name}r AS (SELECT gid, array_agg(x ORDER BY sub, pos) AS w FROM {name}j GROUP BY 1), {name} AS (SELECT gid, {q.unit('w')} AS v FROM {name}r)"


@query(f"WITH ce AS ({_CEN}), {_dec('da', _PQA)}, {_dec('db', _PQB)}, mx AS (SELECT da.gid, CASE WHEN db.v IS NULL THEN da.v ELSE list_transform(list_zip(da.v, db.v), lambda z_: 0.6 * z_[1] + 0.4 * z_[2]) END AS m, db.v IS NOT NULL AS both_ FROM da LEFT JOIN db USING (gid)), nx AS (SELECT gid, {q.unit('m')} AS m FROM mx), pt AS (SELECT gid, s.sub, list_slice(m, s.sub * 4 + 1, s.sub * 4 + 4) AS part FROM nx, (SELECT unnest(range(0, 4)) AS sub) s), ds AS (SELECT gid, pt.sub, code, list_sum(list_transform(list_zip(part, v), lambda z_: (z_[1] - z_[2]) * (z_[1] - z_[2]))) AS d FROM pt JOIN ce ON ce.sub = pt.sub) SELECT gid, sub, code FROM ds QUALIFY row_number() OVER (PARTITION BY gid, sub ORDER BY d, code) = 1")
def pq_blend(t: Inputs) -> DataFrame:
    """Two checkpoints blended where both are valid, and encoded again"""
    pq = lambda bad, k: t(f"SELECT vec_id AS gid, s.sub, CASE WHEN vec_id % {bad} = 0 THEN 255 ELSE (vec_id * {k} + s.sub * 3) % 9 END AS code FROM {{embeddings}} LATERAL VIEW explode(sequence(0L, 3L)) s AS sub")
    c = t("SELECT vec_id % 9 AS code, vec_id div 9 AS sub, slice(embedding, 1, 4) AS vec FROM {embeddings} WHERE vec_id < 36").withColumn("vec", as_double("vec"))
    return cb.pq_blend(pq(11, 7), pq(6, 5), c, 4, 0.6).select("gid", F.col("sub").cast("long").alias("sub"), "code")


@query(f"WITH f AS ({POINTS}), o AS (SELECT gid, vec FROM f WHERE gid % 3 <> 0), j AS (SELECT f.gid, f.vec::DOUBLE[] AS a, (SELECT vec::DOUBLE[] FROM o WHERE o.gid = f.gid) AS b FROM f), m AS (SELECT gid, CASE WHEN b IS NULL THEN a ELSE {q.mix('a', 'list_reverse(b)', '0.3')} END AS x FROM j) SELECT gid, round(x[1] / greatest(sqrt(list_dot_product(x, x)), 1e-8), 6) AS first FROM m")
def composed_codes(t: Inputs) -> DataFrame:
    """Fine codes plus a share of object codes"""
    p = t(POINTS)
    whole = p.where("gid % 3 <> 0").select("gid", F.reverse("vec").alias("vec"))
    return cb.compose(p.select("gid", "vec"), whole, 0.3, ["gid"]).select("gid", F.round(F.col("vec")[0], 6).alias("first"))


_SEM = f"pc AS ({_PC}), e AS (SELECT vec_id AS code_id, embedding AS vec FROM {{embeddings}} WHERE vec_id < 32), x AS ({q.vsum('(SELECT gid, vec FROM pc JOIN e USING (code_id))', 'gid')}), h AS (SELECT gid FROM pc GROUP BY 1 HAVING count(DISTINCT level) = 2), v AS (SELECT vec_id + 1 AS seg_id, embedding::DOUBLE[] AS vec FROM {{embeddings}})"


@query(f"WITH c AS ({CONTRIBS}), {_SEM}, m AS (SELECT view_id, seg_id, gid, sum(weight) AS w FROM c GROUP BY ALL), k AS (SELECT m.*, CASE WHEN h.gid IS NOT NULL THEN list_dot_product(s, vec) / greatest(sqrt(list_dot_product(s, s)) * sqrt(list_dot_product(vec, vec)), 1e-8) END AS sc FROM m LEFT JOIN h USING (gid) LEFT JOIN x ON x.gid = m.gid LEFT JOIN v USING (seg_id)), p AS (SELECT *, row_number() OVER (PARTITION BY view_id, seg_id ORDER BY w DESC, gid) AS rw FROM k QUALIFY rw <= 30), z AS (SELECT *, greatest(1, ceil(0.25 * count(*) OVER (PARTITION BY view_id, seg_id))) AS keep, row_number() OVER (PARTITION BY view_id, seg_id ORDER BY sc DESC NULLS LAST, gid) AS rs FROM p) SELECT view_id, seg_id, gid, round(w, 4) AS weight, rw > keep AS rescued FROM z WHERE rw <= keep OR (rs <= keep AND sc IS NOT NULL)")
def association_cache(t: Inputs) -> DataFrame:
    """Associations by mass and meaning, kept by view and read back"""
    codes = t("SELECT vec_id AS code_id, embedding AS vec FROM {embeddings} WHERE vec_id < 32").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("level"), "code_id", "vec")
    c = t(CONTRIBS)
    scores = trk.semantic_scores(c.select("gid", "seg_id").distinct(), t(_PC), codes, t("SELECT vec_id + 1 AS seg_id, embedding AS vec FROM {embeddings}"), 2)
    path = fresh_path(t.spark, "associations")
    kept = trk.cached_associations(t.spark, path, lambda: trk.associations(c, scores, 30, 0.25))
    return kept.select(F.col("view_id").cast("bigint").alias("view_id"), "seg_id", "gid", F.round("weight", 4).alias("weight"), "rescued")


_THREE = f"{_SCORES}, k AS (SELECT a.gid, a.query_id, a.score AS a, b.score AS b, c.score AS c FROM s a JOIN s b ON b.gid = a.gid + 1 AND b.query_id = a.query_id JOIN s c ON c.gid = a.gid + 2 AND c.query_id = a.query_id)"
_SOFT = "e AS (SELECT gid, query_id, exp(4 * (a - max(a) OVER w)) AS a, exp(4 * (b - max(b) OVER w)) AS b, exp(4 * (c - max(c) OVER w)) AS c FROM k WINDOW w AS (PARTITION BY gid)), d AS (SELECT gid, query_id, greatest(a / sum(a) OVER w, 1e-8) AS a, greatest(b / sum(b) OVER w, 1e-8) AS b, greatest(c / sum(c) OVER w, 1e-8) AS c FROM e WINDOW w AS (PARTITION BY gid))"


def _three(t: Inputs) -> DataFrame:
    s = _scores(t)
    at = lambda n, c: s.select((F.col("gid") - n).alias("gid"), "query_id", F.col("score").alias(c))
    return at(0, "a").join(at(1, "b"), ["gid", "query_id"]).join(at(2, "c"), ["gid", "query_id"])


@query(f"WITH {_THREE}, {_SOFT}, g AS (SELECT gid, sum((a - b) * (ln(a) - ln(b))) / 2 AS ab, sum((b - c) * (ln(b) - ln(c))) / 2 AS bc, arg_max(query_id, a) AS ia, arg_max(query_id, b) AS ib, arg_max(query_id, c) AS ic FROM d GROUP BY 1) SELECT round(avg(ab), 7) AS kl_a_b, round(avg(bc), 7) AS kl_b_c, round(avg((ia <> ib)::INT), 7) AS flips_a_b, round(avg((ib <> ic)::INT), 7) AS flips_b_c, count(*) AS n FROM g")
def query_consistency(t: Inputs) -> DataFrame:
    """Symmetric KL and label flips between sources"""
    c = qry.consistency(_three(t), [("a", "b"), ("b", "c")], 4.0)
    return c.select(*(F.round(x, 7).alias(x) for x in ("kl_a_b", "kl_b_c", "flips_a_b", "flips_b_c")), "n")


@query(f"WITH {_THREE}, {_SOFT}, o AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY b DESC, query_id) AS rt, row_number() OVER (PARTITION BY gid ORDER BY a DESC, query_id) AS rp FROM k), m AS (SELECT gid, abs(4 * (max(a) FILTER (rt = 1) - max(a) FILTER (rt = 2)) - 4 * (max(b) FILTER (rt = 1) - max(b) FILTER (rt = 2))) AS mae, max((rt = 1 AND rp = 1)::INT) AS t1 FROM o GROUP BY 1), g AS (SELECT gid, sum(b * (ln(b) - ln(a))) AS kl FROM d GROUP BY 1), cs AS (SELECT x.gid, list_dot_product(x.vec::DOUBLE[], y.vec::DOUBLE[]) / (sqrt(list_dot_product(x.vec::DOUBLE[], x.vec::DOUBLE[])) * sqrt(list_dot_product(y.vec::DOUBLE[], y.vec::DOUBLE[]))) AS cos FROM p x JOIN p y ON y.gid = x.gid + 1) SELECT round(avg(cos), 6) AS cosine, round(avg(kl), 6) AS query_kl, round(avg(mae), 6) AS margin_mae, round(avg(t1), 6) AS top1, count(*) AS n, round(1 - avg(cos) + 0.5 * avg(kl) + 0.2 * avg(mae), 6) AS score FROM m JOIN g USING (gid) JOIN cs USING (gid)")
def rank_metrics(t: Inputs) -> DataFrame:
    """KL, top-2 margin error, top-1 agreement, cosine and the validation score"""
    rows = _three(t).select("gid", "query_id", F.col("a").alias("p"), F.col("b").alias("t"))
    p = t(POINTS)
    cos = p.join(p.select((F.col("gid") - 1).alias("gid"), F.col("vec").alias("w")), "gid").select("gid", cosine("vec", "w").alias("cos"))
    m = qry.rank_metrics(rows, cos, 4.0, 0.5, 0.2)
    return m.select(*(F.round(x, 6).alias(x) for x in ("cosine", "query_kl", "margin_mae", "top1", "score")), "n")


@query(f"WITH {_SCORES}, o AS (SELECT gid, 1 / (1 + exp(-10 * vec[1]::DOUBLE)) AS opacity FROM p WHERE label <> 3) SELECT gid, query_id, round(CASE WHEN opacity IS NULL THEN 0 ELSE score * opacity END, 6) AS score FROM s LEFT JOIN o USING (gid)")
def masked_relevancy(t: Inputs) -> DataFrame:
    """Relevancy times opacity, nothing for points outside the keep mask"""
    keep = t(POINTS).where("label <> 3").select("gid", sigmoid(10 * F.col("vec")[0].cast("double")).alias("opacity"))
    return _scores(t).join(keep, "gid", "left").select("gid", "query_id", F.round(F.coalesce(F.col("score") * F.col("opacity"), F.lit(0.0)), 6).alias("score"))


@query(f"WITH {_SCORES}, k AS (SELECT query_id, gid AS code_id, score FROM s WHERE gid < 32), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code_id) AS r FROM k) SELECT query_id, p.gid AS group_id FROM r JOIN p ON p.gid % 32 = code_id WHERE r <= 5")
def top_code_groups(t: Inputs) -> DataFrame:
    """K6"""
    codes = _scores(t).where("gid < 32").withColumnRenamed("gid", "code_id")
    groups = t(POINTS).select(F.col("gid").alias("group_id"), (F.col("gid") % 32).alias("code_id"))
    return qry.top_code_groups(codes, groups, 5)


@query(_MEM.replace("o AS (SELECT gid, track, sum(fg)", "o AS (SELECT gid, track, sum(fg) AS fg, sum(fg)") + ", k AS (SELECT gid, track, row_number() OVER (PARTITION BY gid ORDER BY round(score, 9) DESC, track) - 1 AS slot FROM o WHERE fg >= 30 AND track <> 4 AND score > 0.1) SELECT gid, slot::INT AS slot, track FROM k WHERE slot < 3")
def pack_foreground(t: Inputs) -> DataFrame:
    """K2: top memberships with enough foreground, without excluded tracks"""
    c = t(CONTRIBS)
    st = c.where("seg_id % 4 <> 0").select("view_id", "seg_id", (F.col("seg_id") % 9).alias("track")).distinct()
    fg = trk.foreground(c, st)
    rows = trk.membership(c, st).join(fg, ["gid", "track"]).withColumn("score", F.round("score", 9))
    return trk.pack_foreground(rows, 3, 0.1, 30.0, st.where("track = 4")).select("gid", F.col("slot").cast("int").alias("slot"), "track")


@query(f"WITH c AS ({CONTRIBS}), f AS (SELECT gid, seg_id % 9 AS track, weight FROM c WHERE seg_id % 4 <> 0 AND pixel_id % 2 = 0) SELECT gid, track, round(sum(weight), 4) AS fg FROM f GROUP BY ALL")
def foreground_mass(t: Inputs) -> DataFrame:
    """Pair mass of selected pixels of foreground segments"""
    c = t(CONTRIBS)
    st = c.where("seg_id % 4 <> 0").select("view_id", "seg_id", (F.col("seg_id") % 9).alias("track")).distinct()
    return trk.foreground(c.where("pixel_id % 2 = 0"), st).select("gid", "track", F.round("fg", 4).alias("fg"))


@query(f"WITH c AS ({CONTRIBS}), v AS (SELECT vec_id + 1 AS seg_id, embedding AS vec FROM {{embeddings}}), o AS (SELECT gid, seg_id FROM c WHERE line = 1), j AS (SELECT gid, vec FROM o JOIN v USING (seg_id)), x AS ({q.vsum('j', 'gid')}) SELECT gid, round(s[1] / greatest(sqrt(list_dot_product(s, s)), 1e-8), 6) AS first, w::BIGINT AS votes FROM x WHERE w >= 2")
def centre_feature_votes(t: Inputs) -> DataFrame:
    """The mean of unit features at a point's centre pixels, with enough votes"""
    v = t("SELECT vec_id + 1 AS seg_id, embedding AS vec FROM {embeddings}").withColumn("vec", as_double("vec"))
    votes = t(CONTRIBS).where("line = 1").select("gid", "seg_id", F.lit(1.0).alias("weight"))
    s = con.weighted_sums(votes, v, ["gid"]).where("total_w >= 2")
    return s.select("gid", F.round(l2_normalize("s")[0], 6).alias("first"), F.col("total_w").cast("bigint").alias("votes"))


@query()
def view_distributions(t: Inputs) -> DataFrame:
    """Tilted, mixed and KL-limited view shares; held against plain code in the tests"""
    r = t("SELECT l_suppkey AS group_id, l_linenumber AS view_id, count(*) / 10.0D AS share, avg(l_discount) AS score, CAST(NULL AS DOUBLE) AS last FROM {lineitem} GROUP BY 1, 2")
    return sample.view_distributions(r, 2.0, 0.25, 0.05, 0.02).select("group_id", "view_id", F.round("p", 7).alias("p"))


@query()
def superpoints(t: Inputs) -> DataFrame:
    """Components of bounded size over like neighbours; held against plain code in the tests"""
    p = _pos(t).join(t(POINTS), "gid").select("gid", "pos", "vec", F.array(F.col("p_size") / 50.0, F.lit(0.5), F.lit(0.5)).alias("rgb"), (F.col("p_size") / 25.0).alias("log_scale"))
    edges = sp.superpoint_edges(sp.knn(p, p, 6, 3, 1.5), p, 2.0, 0.5, 1.0, -0.2)
    return sp.bounded_components(edges.withColumn("scene", F.col("a") % _SCENE), "scene", ["a", "d2", "b"], 12).select("scene", "node", "component", "size")


@query()
def pca_colours(t: Inputs) -> DataFrame:
    """P27 (principal directions): held against plain code in the tests"""
    return ev.pca_colours(t(POINTS)).select("gid", *(F.round(F.col("rgb")[i], 5).alias(c) for i, c in enumerate(("red", "green", "blue"))))


@query("SELECT p_partkey AS k, floor(least(greatest((p_retailprice - (SELECT min(p_retailprice) FROM {part})) / ((SELECT max(p_retailprice) - min(p_retailprice) FROM {part}) + 1e-10), 0), 1) * 255)::INT AS index, floor(least(greatest((p_retailprice - 910) / (980 - 910 + 1e-10), 0), 1) * 255)::INT AS planes, CASE WHEN p_size > 25 THEN 255 ELSE 0 END AS flag FROM {part}")
def depth_colours(t: Inputs) -> DataFrame:
    """P27 (depth between planes, flags)"""
    p = t("SELECT p_partkey AS k, p_retailprice AS z, p_size FROM {part}")
    own = ev.depth_colours(p, "z")
    planes = ev.depth_colours(p, "z", 910.0, 980.0).select("k", F.col("index").alias("planes"))
    return own.join(planes, "k").select("k", "index", "planes", F.when(F.col("p_size") > 25, 255).otherwise(0).alias("flag"))


@query("""WITH n AS (SELECT l AS layer, (2 ** l)::INT AS n FROM range(1, 3) r(l)), z AS (SELECT *, trunc(0.25 * 480 * (2.0 / n))::INT AS shared FROM n), d AS (SELECT *, ceil((shared * (n - 1) + 640) / n)::INT AS w, ceil((shared * (n - 1) + 480) / n)::INT AS h FROM z),
b AS (SELECT layer, w, h, (w - shared) * i AS x0, (h - shared) * j AS y0 FROM d, range(0, 4) a(i), range(0, 4) c(j) WHERE i < n AND j < n) SELECT 0 AS layer, 0 AS x0, 0 AS y0, 640 AS x1, 480 AS y1 UNION ALL SELECT layer::INT, x0::INT, y0::INT, least(x0 + w, 640)::INT, least(y0 + h, 480)::INT FROM b""")
def crop_boxes(t: Inputs) -> DataFrame:
    """Overlapping crops, layer by layer"""
    return geo.crop_boxes(t.spark, 640, 480, 2, 0.25)


@query("SELECT p_partkey AS k, p_size + 100 AS x, p_size % 7 + 50 AS y, 30 - p_size % 5 AS w, 12 AS h FROM {part}")
def box_places(t: Inputs) -> DataFrame:
    """A crop's boxes in the image, as place and size"""
    p = t("SELECT p_partkey AS k, p_size AS a, p_size % 7 AS b, p_size + 30 - p_size % 5 AS c, p_size % 7 + 12 AS d FROM {part}")
    box = geo.to_width_height(geo.uncrop([F.col(x) for x in "abcd"], [F.lit(x) for x in (100, 50, 400, 300)]))
    return p.select("k", *(c.alias(n) for n, c in zip("xywh", box, strict=True)))


_TILES = "SELECT p_size % 5 AS mask, p_partkey // 40 AS px, p_partkey % 40 AS py, max(p_size) AS value FROM {part} WHERE p_partkey % 7 <> 0 GROUP BY 1, 2, 3"


@query(f"WITH m AS ({_TILES}), b AS (SELECT mask, min(px) AS x0, max(px) - min(px) + 1 AS w, min(py) AS y0, max(py) - min(py) + 1 AS h FROM m GROUP BY 1) SELECT mask, greatest(w, h) AS side, px - x0 + (greatest(w, h) - w) // 2 AS tx, py - y0 + (greatest(w, h) - h) // 2 AS ty, value FROM m JOIN b USING (mask)")
def mask_tiles(t: Inputs) -> DataFrame:
    """Masks cut out and padded to squares"""
    p = t(_TILES.replace("//", "div")).withColumn("image", F.lit(0))
    return ev.mask_tiles(p, ["image"], "value").select("mask", "side", "tx", "ty", "value")


@query("SELECT p_partkey AS k, floor((600 + p_size * 40) / greatest((400 + p_size * 30) / 1080.0::DOUBLE, 1))::INT AS w, floor((400 + p_size * 30) / greatest((400 + p_size * 30) / 1080.0::DOUBLE, 1))::INT AS h FROM {part}")
def working_sizes(t: Inputs) -> DataFrame:
    """The size at which images are read"""
    w, h = ev.working_size((600 + F.col("p_size") * 40).cast("double"), (400 + F.col("p_size") * 30).cast("double"))
    return t("SELECT p_partkey AS k, p_size FROM {part}").select("k", w.alias("w"), h.alias("h"))


@query(f"WITH c AS (SELECT l_linenumber AS view_id, l_suppkey % 4 AS k, avg(l_discount) AS c FROM {{lineitem}} GROUP BY ALL), b AS (SELECT vec_id AS k, embedding AS vec FROM {{embeddings}} WHERE vec_id < 4), x AS ({q.vsum('(SELECT view_id, c, vec FROM c JOIN b USING (k))', 'view_id', 'c')}) SELECT view_id, round(s[1], 7) AS first, round(s[64], 7) AS last FROM x")
def view_offsets(t: Inputs) -> DataFrame:
    """Low-rank vectors of views"""
    codes = t("SELECT l_linenumber AS view_id, l_suppkey % 4 AS k, avg(l_discount) AS c FROM {lineitem} GROUP BY 1, 2")
    basis = t("SELECT vec_id AS k, embedding AS vec FROM {embeddings} WHERE vec_id < 4")
    return con.view_offsets(codes, basis).select("view_id", F.round(F.col("s")[0], 7).alias("first"), F.round(F.col("s")[63], 7).alias("last"))
