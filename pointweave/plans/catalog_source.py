"""Queries over checkpoints, artifacts and point sets, and the rendered selection protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.vec import as_double, norm
from pointweave.operators import evaluate as ev
from pointweave.operators import fit
from pointweave.operators import observe as obs
from pointweave.plans.catalog_codebook import _CODES
from pointweave.plans.catalog_observe import _ORDER, _O
from pointweave.plans.catalog_query import _GRID, _SCORES, _scores
from pointweave.plans.catalog_track import _DIST2, _POS
from pointweave.plans.registry import CONTRIBS, POINTS, Inputs, query
from pointweave.plans.storage import fresh_path
from pointweave.sources import checkpoints as ck

#: Stand-in: parts of the embeddings as geometry; every fifth point has no language.
_GEO = "SELECT vec_id AS gid, embedding AS e, label FROM {embeddings}"


def _geometry(t: Inputs) -> DataFrame:
    e = t(_GEO)
    part = lambda a, n: as_double(F.slice("e", a, n))
    rest = (F.lit(0.0).alias("max_radius"), F.lit(0.0).alias("gradient"), F.lit(0).alias("seen"))
    return e.select("gid", part(1, 3).alias("xyz"), part(4, 3).alias("features_dc"), part(7, 9).alias("features_rest"), part(16, 3).alias("scaling"), part(19, 4).alias("rotation"), F.col("e")[22].cast("double").alias("opacity"), *rest)


@query(f"WITH e AS (SELECT gid, e::DOUBLE[] AS e FROM ({_GEO}) q) SELECT gid, round(1 / (1 + exp(-e[23])), 6) AS opacity, round(least(greatest(0.5 + 0.28209479177387814 * e[4], 0), 1), 6) AS red, round((e[16] + e[17] + e[18]) / 3, 6) AS log_scale, round(e[1], 6) AS x, gid % 5 <> 0 AS valid, round(CASE WHEN gid % 5 <> 0 THEN e[1] ELSE 0 END, 6) AS first FROM e")
def geometry_checkpoint(t: Inputs) -> DataFrame:
    """Geometry written with language and read back, activated"""
    path = fresh_path(t.spark, "checkpoint")
    ck.save_language(_geometry(t), t(POINTS).where("gid % 5 <> 0").select("gid", F.col("vec").alias("feature")), path, {"level": 1})
    look, words = ck.appearance(ck.geometry(t.spark, path)), ck.language(t.spark, path)
    return look.join(words, "gid").select("gid", F.round("opacity", 6).alias("opacity"), F.round(F.col("rgb")[0], 6).alias("red"), F.round("log_scale", 6).alias("log_scale"), F.round(F.col("xyz")[0], 6).alias("x"), "valid", F.round(F.col("feature")[0], 6).alias("first"))


@query("SELECT l_linenumber AS view_index, count(*) AS pixels, sum(l_suppkey)::BIGINT AS segments FROM {lineitem} WHERE l_linenumber IN (1, 3, 5) GROUP BY 1")
def view_cache_scan(t: Inputs) -> DataFrame:
    """A slim scan of some views"""
    path = fresh_path(t.spark, "views")
    ck.save_views(t("SELECT l_linenumber AS view_index, 'view' AS image_name, array(l_partkey) AS point_ids, array(l_quantity) AS point_weights, l_suppkey AS segment_ids, l_tax AS wide FROM {lineitem}"), path)
    v = ck.view_caches(t.spark, path, views=[1, 3, 5])
    return v.groupBy(F.col("view_index").cast("bigint").alias("view_index")).agg(F.count("*").alias("pixels"), F.sum("segment_ids").alias("segments"))


_OVER = "SELECT vec_id AS gid, 1 + vec_id % 2 AS slot, (vec_id * 3) % 32 AS code_id, 100 + vec_id % 50 AS weight FROM {embeddings} WHERE vec_id % 3 = 0"


@query(f"SELECT gid, slot, code_id, weight FROM (SELECT vec_id AS gid, 0 AS slot, vec_id % 32 AS code_id, 255 AS weight FROM {{embeddings}} UNION ALL {_OVER})")
def artifact_slots(t: Inputs) -> DataFrame:
    """Base and sparse overflow of an artifact, checked against its dictionary"""
    return ck.artifact_slots(t("SELECT vec_id AS gid, vec_id % 32 AS code_id FROM {embeddings}"), t(_OVER), t(_CODES), 4)


@query("SELECT p_partkey AS gid, p_size % 4 AS capacity FROM {part} WHERE p_retailprice > 950")
def consensus_source(t: Inputs) -> DataFrame:
    """Rows with weight and their whole capacity, out of a checked payload"""
    path = fresh_path(t.spark, "consensus")
    t("SELECT p_partkey AS gid, array(1.0D, 2.0D) AS feature, CASE WHEN p_retailprice > 950 THEN p_retailprice ELSE 0 END AS total_w, CAST(p_size % 4 AS DOUBLE) AS capacity FROM {part}").write.parquet(path)
    return ck.consensus_source(ck.payload(t.spark, path, "consensus")).select("gid", "capacity")


@query("SELECT vec_id AS gid, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM {embeddings} WHERE vec_id % 9 <> 0")
def feature_source(t: Inputs) -> DataFrame:
    """S3: vectors with a norm, of unit length"""
    rows = t(POINTS).select("gid", F.transform("vec", lambda x: F.when(F.col("gid") % 9 == 0, F.lit(0.0)).otherwise(x.cast("double") * 3)).alias("vec"))
    return ck.feature_source(rows).select("gid", F.round(F.col("vec")[0], 6).alias("first"))


@query()
def ply_round_trip(t: Inputs) -> DataFrame:
    """Points as PLY files; read back in the tests"""
    files = ck.ply_files(_geometry(t), F.array(F.lit(1), F.lit(2), F.lit(3)))
    return files.select("part", F.length("content").alias("bytes"))


_HITS = f"SELECT view_id, pixel_id, gid % 400 AS gid, seg_id, line, depth, weight, tax, alpha * 8 AS alpha FROM ({CONTRIBS}) q0"
_T = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]"
_SEL = f"""WITH {_SCORES}, hh AS ({_HITS}), w0 AS (SELECT *, product(1 - alpha) OVER (PARTITION BY pixel_id ORDER BY {_O} ROWS UNBOUNDED PRECEDING) AS t_after FROM hh), w1 AS (SELECT view_id, pixel_id, gid, alpha * t_after / (1 - alpha) AS w FROM w0 WHERE t_after >= 1e-4),
th AS (SELECT unnest({_T}) AS threshold), tr AS (SELECT DISTINCT view_id, pixel_id, (pixel_id % 3) AS query_id FROM hh WHERE pixel_id % 5 < 2), oc AS (SELECT view_id, query_id, threshold, pixel_id, sum(CASE WHEN score > threshold THEN w ELSE 0 END) > 0.5 AS lit FROM w1 JOIN s USING (gid), th GROUP BY ALL),
nt AS (SELECT view_id, query_id, count(*) AS t FROM tr GROUP BY ALL), jn AS (SELECT oc.view_id, oc.query_id, threshold, count(*) FILTER (lit) AS p, count(*) FILTER (lit AND tr.pixel_id IS NOT NULL) AS i FROM oc LEFT JOIN tr ON tr.view_id = oc.view_id AND tr.query_id = oc.query_id AND tr.pixel_id = oc.pixel_id GROUP BY ALL),
io AS (SELECT view_id, query_id, threshold, i / (t + p - i) AS iou FROM nt JOIN jn USING (view_id, query_id))"""


def _selection(t: Inputs) -> DataFrame:
    h = t(_HITS)
    weights = obs.composite(h, ["pixel_id"], _ORDER, most=None)
    truth = h.where("pixel_id % 5 < 2").select("view_id", "pixel_id", (F.col("pixel_id") % 3).alias("query_id")).distinct()
    return ev.rendered_selection(weights.select("view_id", "pixel_id", "gid", "weight"), _scores(t), truth, _GRID, 0.5)


@query(_SEL + " SELECT view_id, query_id, threshold, round(iou, 6) AS iou FROM io")
def rendered_selection(t: Inputs) -> DataFrame:
    """Points over a threshold, rendered, and held against labelled pixels by occupancy"""
    return _selection(t).select("view_id", "query_id", "threshold", F.round("iou", 6).alias("iou"))


@query(_SEL + ", sm AS (SELECT threshold, avg(iou) AS miou, avg((iou > 0.25)::INT) AS a25, avg((iou > 0.5)::INT) AS a50, count(*) AS n FROM io GROUP BY 1) SELECT threshold, round(miou, 6) AS miou, round(a25, 6) AS acc25, round(a50, 6) AS acc50, n FROM sm ORDER BY sm.miou DESC, threshold LIMIT 1")
def selection_protocol(t: Inputs) -> DataFrame:
    """E3 to E5, the flagship: phrases, rendered selections, and the best threshold"""
    s = ev.best_threshold(ev.summarise(_selection(t), ["threshold"]), [])
    return s.select("threshold", *(F.round(c, 6).alias(c) for c in ("miou", "acc25", "acc50")), "n")


@query(f"WITH p AS ({_POS}), d AS (SELECT a.gid, {_DIST2} AS d2 FROM p a JOIN p b ON a.gid <> b.gid QUALIFY row_number() OVER (PARTITION BY a.gid ORDER BY round(d2, 9), b.gid) <= 3), m AS (SELECT gid, avg(d2) AS m FROM d GROUP BY 1) SELECT gid, round(ln(sqrt(greatest(m, 1e-7))), 6) AS scale, round((p_size / 50.0 - 0.5) / 0.28209479177387814, 6) AS red, round(ln(0.1 / 0.9), 6) AS opacity FROM m JOIN p USING (gid)")
def initial_points(t: Inputs) -> DataFrame:
    """N1"""
    p = t(_POS).select("gid", F.array("x", "y", "z").alias("xyz"), F.array(*[F.col("p_size").cast("double") / 50.0] * 3).alias("rgb"))
    i = fit.initialise(p, 1.5)
    return i.select("gid", F.round(F.col("scaling")[0], 6).alias("scale"), F.round(F.col("features_dc")[0], 6).alias("red"), F.round("opacity", 6).alias("opacity"))


_DENSE = "SELECT p_partkey AS gid, CAST(p_size % 7 AS DOUBLE) AS gradient, p_size % 3 AS seen, ln((p_partkey % 10 + 1) / 100.0) AS s, (p_partkey % 11 - 5) / 1.0 AS opacity FROM {part}"


@query(f"WITH p AS ({_DENSE}), m AS (SELECT *, CASE WHEN seen > 0 THEN gradient / seen ELSE 0 END >= 2 AS grow, s > ln(0.055) AS large FROM p), o AS (SELECT gid, 0 AS copy, s, opacity FROM m WHERE NOT (grow AND large) UNION ALL SELECT gid, 1, s, opacity FROM m WHERE grow AND NOT large UNION ALL SELECT gid, c, s - ln(1.6), opacity FROM m, (SELECT unnest([1, 2]) AS c) WHERE grow AND large) SELECT gid, copy::INT AS copy, round(s, 6) AS scale FROM o WHERE 1 / (1 + exp(-opacity)) >= 0.05")
def densify_prune(t: Inputs) -> DataFrame:
    """Clones, splits and what is pruned after them"""
    p = t(_DENSE).select("gid", "gradient", "seen", F.array_repeat(F.col("s"), 3).alias("scaling"), F.col("opacity").cast("double").alias("opacity"), F.array(*map(F.lit, (0.0, 0.0, 0.0))).alias("xyz"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))).alias("rotation"))
    out = fit.prune(fit.densify(p, 2.0, 0.055, 1.0), 0.05, 1.0)
    return out.select("gid", "copy", F.round(F.col("scaling")[0], 6).alias("scale"))


@query("WITH e AS (SELECT vec_id AS gid, embedding::DOUBLE[] AS e FROM {embeddings}) SELECT gid, round(sqrt(list_dot_product(e, e)), 5) AS length, round(1 / list_sum(list_transform(e, lambda x: pow(x * x / list_dot_product(e, e), 2))), 4) AS ess FROM e")
def effective_size(t: Inputs) -> DataFrame:
    """P5 (effective sample size) of squared components as a distribution"""
    p = t(POINTS).select("gid", as_double("vec").alias("e"))
    square = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x * x * x)
    return p.select("gid", F.round(norm("e"), 5).alias("length"), F.round(F.pow(norm("e"), F.lit(4)) / square, 4).alias("ess"))


@query("WITH c AS (SELECT DISTINCT p_brand AS k FROM {part}), w AS (SELECT DISTINCT p_brand AS k FROM {part} WHERE p_size = 50 AND p_partkey % 3 = 0 UNION SELECT 'unknown') SELECT k, 'missing' AS state FROM (SELECT k FROM c EXCEPT SELECT k FROM w) a UNION ALL SELECT k, 'unknown' FROM (SELECT k FROM w EXCEPT SELECT k FROM c) b")
def completeness(t: Inputs) -> DataFrame:
    """Scenes that a report lacks, and scenes that it should not have"""
    want = t("SELECT DISTINCT p_brand AS k FROM {part}")
    have = t("SELECT DISTINCT p_brand AS k FROM {part} WHERE p_size = 50 AND p_partkey % 3 = 0 UNION SELECT 'unknown'")
    return ev.completeness(want, have)
