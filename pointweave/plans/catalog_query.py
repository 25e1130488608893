"""Queries that score, route and evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.vec import dot, half_even_u8
from pointweave.operators import evaluate as ev
from pointweave.operators import query as qry
from pointweave.plans.registry import POINTS, Inputs, query

_D = "::DOUBLE[]"
#: Phrases: positives are vectors 0 to 2, negatives 10 to 13.
_PHRASES = "SELECT vec_id AS query_id, CASE WHEN vec_id < 3 THEN 1 ELSE -1 END AS polarity, embedding AS vec FROM {embeddings} WHERE vec_id < 3 OR (vec_id >= 10 AND vec_id < 14)"
_SCORES = f"""p AS ({POINTS}), h AS ({_PHRASES}), n AS (SELECT gid, max(list_dot_product(p.vec{_D}, h.vec{_D})) AS n FROM p, h WHERE polarity < 0 GROUP BY 1),
s AS (SELECT gid, query_id, 1 / (1 + exp(-10 * (list_dot_product(p.vec{_D}, h.vec{_D}) - n))) AS score FROM p JOIN n USING (gid), h WHERE polarity > 0)"""


def _scores(t: Inputs) -> DataFrame:
    return qry.phrase_scores(t(POINTS), t(_PHRASES))


@query(f"WITH {_SCORES} SELECT gid, query_id, round(score, 6) AS score FROM s")
def relevancy_query(t: Inputs) -> DataFrame:
    """R1, R3, R4, X8"""
    return _scores(t).select("gid", "query_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES}, b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY gid ORDER BY score DESC, query_id) = 1) SELECT gid, CASE WHEN score > 0.5 THEN query_id ELSE -1 END AS query_id, round(score, 6) AS score FROM b")
def semantic_map(t: Inputs) -> DataFrame:
    """R2"""
    return qry.semantic_argmax(_scores(t)).select("gid", F.coalesce("query_id", F.lit(-1).cast("long")).alias("query_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES} SELECT a.gid, a.query_id, round(a.score - max(b.score), 6) AS margin FROM s a JOIN s b ON a.gid = b.gid AND a.query_id <> b.query_id GROUP BY a.gid, a.query_id, a.score")
def query_margin(t: Inputs) -> DataFrame:
    """W8"""
    return qry.margins(_scores(t)).select("gid", "query_id", F.round("margin", 6).alias("margin"))


#: Two score sources of a point: relevancy to phrase 0 and 1.
_TWO = f"WITH {_SCORES}, w AS (SELECT gid, max(CASE WHEN query_id = 0 THEN score END) AS base, max(CASE WHEN query_id = 1 THEN score END) AS cand, max(CASE WHEN query_id = 2 THEN score END) AS other FROM s GROUP BY 1), r AS (SELECT gid, base, cand, base - other AS bm, cand - other * 0.9 AS cm, gid % 3 <> 0 AS valid, (gid % 4) / 4.0 AS rel FROM w)"


def _two(t: Inputs) -> DataFrame:
    s = _scores(t)
    pick = lambda i: F.max(F.when(F.col("query_id") == i, F.col("score")))
    w = s.groupBy("gid").agg(pick(0).alias("base"), pick(1).alias("cand"), pick(2).alias("other"))
    return w.select("gid", "base", "cand", (F.col("base") - F.col("other")).alias("bm"), (F.col("cand") - F.col("other") * 0.9).alias("cm"), (F.col("gid") % 3 != 0).alias("valid"), (F.col("gid") % 4 / 4.0).alias("rel"))


def _routed(t: Inputs, mode: str) -> DataFrame:
    c = F.col
    return _two(t).select("gid", F.round(qry.route(c("base"), c("cand"), c("bm"), c("cm"), c("valid"), mode, c("rel")), 6).alias("score"))


@query(_TWO + " SELECT gid, round(CASE WHEN valid AND cm > bm THEN cand ELSE base END, 6) AS score FROM r")
def route_margin_switch(t: Inputs) -> DataFrame:
    """R5"""
    return _routed(t, "margin_switch")


@query(_TWO + " SELECT gid, round(CASE WHEN valid AND cm > bm AND cand > base THEN cand ELSE base END, 6) AS score FROM r")
def route_margin_positive(t: Inputs) -> DataFrame:
    """R5"""
    return _routed(t, "margin_positive")


@query(_TWO + " SELECT gid, round(CASE WHEN valid AND cand > base THEN cand ELSE base END, 6) AS score FROM r")
def route_query_positive(t: Inputs) -> DataFrame:
    """R5"""
    return _routed(t, "query_positive")


@query(_TWO + " SELECT gid, round(CASE WHEN valid THEN base + rel * greatest(cand - base, 0) ELSE base END, 6) AS score FROM r")
def sparse_blend(t: Inputs) -> DataFrame:
    """R5 (blend), R7, R9, R15"""
    return _routed(t, "query_positive_blend")


_CAND = "c AS (SELECT gid, 0 AS slot, cand, rel AS member FROM r UNION ALL SELECT gid, 1, (cand + base) / 2 + 0.05, 1 - rel FROM r WHERE gid % 2 = 0)"


@query(_TWO + f""", {_CAND},
y AS (SELECT c.gid, c.slot, c.cand, b.base, c.cand - b.base AS p FROM c JOIN r b USING (gid)), z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY gid ORDER BY p DESC, slot) = 1),
e AS (SELECT gid, cand, row_number() OVER (ORDER BY p DESC, gid) AS k FROM z WHERE cand > base AND p > 0) SELECT r.gid, round(coalesce(e.cand, r.base), 6) AS score, e.cand IS NOT NULL AS routed FROM r LEFT JOIN e ON e.gid = r.gid AND e.k <= (SELECT ceil(0.2 * count(DISTINCT gid)) FROM c)""")
def route_budget(t: Inputs) -> DataFrame:
    """R6"""
    r = _two(t)
    c = r.select("gid", F.lit(0).alias("slot"), "cand", F.col("rel").alias("member")).unionByName(r.where("gid % 2 = 0").select("gid", F.lit(1).alias("slot"), ((F.col("cand") + F.col("base")) / 2 + 0.05).alias("cand"), (1 - F.col("rel")).alias("member")))
    return qry.route_budget(r.select("gid", "base"), c, 0.2).select("gid", F.round("score", 6).alias("score"), "routed")


@query(_TWO + " SELECT gid, 1 - cand > 1.5 * greatest(base, 0.2) AS novel, least(cand - base, cm - bm) > 0.01 AS gains FROM r")
def novelty_masks(t: Inputs) -> DataFrame:
    """R16, R17"""
    c = F.col
    return _two(t).select("gid", qry.novelty(c("cand"), F.greatest(c("base"), F.lit(0.2)), 1.5).alias("novel"), qry.counterfactual([c("cand") - c("base"), c("cm") - c("bm")], 0.01).alias("gains"))


#: Bridge rows: each point in two of twelve groups; a group's scores are its own vector's.
_BRIDGE = f"{_SCORES}, m AS (SELECT gid, gid % 12 AS group_id, (gid % 5 + 1) / 6.0 AS member FROM p UNION ALL SELECT gid, 12 + gid % 4, (gid % 3 + 1) / 5.0 FROM p), g AS (SELECT gid AS group_id, query_id, score FROM s WHERE gid < 16), j AS (SELECT m.gid, query_id, member AS w, score AS s FROM m JOIN g USING (group_id))"


def _bridge(t: Inputs) -> tuple[DataFrame, DataFrame]:
    p = t(POINTS)
    a = p.select("gid", F.col("gid").alias("k"))
    m = a.select("gid", (F.col("k") % 12).alias("group_id"), ((F.col("k") % 5 + 1) / 6.0).alias("member")).unionByName(a.select("gid", (12 + F.col("k") % 4).alias("group_id"), ((F.col("k") % 3 + 1) / 5.0).alias("member")))
    return m, _scores(t).where("gid < 16").withColumnRenamed("gid", "group_id")


_FORMS = {
    "max": "max(s)",
    "score_max": "max(w * s)",
    "weighted": "sum(w * s) / greatest(sum(w), 1e-8)",
    "weighted_maxblend": "0.5 * max(s) + 0.5 * sum(w * s) / greatest(sum(w), 1e-8)",
    "noisy_or": "1 - product(1 - least(greatest(w * s, 0), 1))",
    "query_softmax": "sum(w * exp(10 * s) * s) / sum(w * exp(10 * s))",
    "query_softmax_maxblend": "0.5 * max(s) + 0.5 * sum(w * exp(10 * s) * s) / sum(w * exp(10 * s))",
}


def _group_query(how: str, sql: str) -> None:
    def run(t: Inputs) -> DataFrame:
        m, g = _bridge(t)
        return qry.group_activation(m, g, how).select("gid", "query_id", F.round("score", 6).alias("score"))

    run.__name__ = f"group_aggregate_{how}"
    query(f"WITH {_BRIDGE} SELECT gid, query_id, round({sql}, 6) AS score FROM j GROUP BY ALL")(run)


for _how, _sql in _FORMS.items():  # R8, R10, J8
    _group_query(_how, _sql)


_MOUNTS = "t AS (SELECT f.gid % 4 AS group_id, f.query_id, f.gid AS fine_id, (f.gid % 3 + 1) / 3.0 AS prior, f.score AS fine, c.score AS coarse FROM s f JOIN s c ON c.gid = 100 + f.gid % 4 AND c.query_id = f.query_id WHERE f.gid < 16)"


@query(f"""WITH {_SCORES}, {_MOUNTS}, z AS (SELECT *, 5 * fine + ln(greatest(prior, 1e-8)) AS z FROM t), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY group_id, query_id)) AS e FROM z), q AS (SELECT *, e / sum(e) OVER (PARTITION BY group_id, query_id) AS pr FROM e)
SELECT group_id, query_id, round(max(coarse) + 0.7 * (1 - (-sum(pr * ln(greatest(pr, 1e-12)))) / ln(count(*))) * (sum(pr * fine) - max(coarse)), 6) AS score FROM q GROUP BY ALL""")
def dynamic_groups(t: Inputs) -> DataFrame:
    """R11, R12, K6"""
    s = _scores(t)
    f = s.where("gid < 16").select((F.col("gid") % 4).alias("group_id"), "query_id", F.col("gid").alias("fine_id"), ((F.col("gid") % 3 + 1) / 3.0).alias("prior"), F.col("score").alias("fine"))
    c = s.where("gid >= 100 and gid < 104").select((F.col("gid") - 100).alias("group_id"), "query_id", F.col("score").alias("coarse"))
    return qry.dynamic_groups(f.join(c, ["group_id", "query_id"]), 5.0, 0.7).select("group_id", "query_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES} SELECT gid, query_id, round(1 / (1 + exp(-((score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 1e-8)))), 6) AS normal FROM s WINDOW w AS (PARTITION BY query_id)")
def token_zscore(t: Inputs) -> DataFrame:
    """W9"""
    return qry.normalise_tokens(_scores(t), "zscore", ["query_id"]).select("gid", "query_id", F.round("normal", 6).alias("normal"))


@query(f"WITH {_SCORES}, q AS (SELECT query_id, quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi FROM s GROUP BY 1) SELECT gid, query_id, round(least(greatest((score - lo) / greatest(hi - lo, 1e-8), 0), 1), 6) AS normal FROM s JOIN q USING (query_id)")
def category_percentile(t: Inputs) -> DataFrame:
    """W9, W10"""
    return qry.normalise_tokens(_scores(t), "percentile", ["query_id"]).select("gid", "query_id", F.round("normal", 6).alias("normal"))


@query(f"WITH {_SCORES} SELECT gid, query_id, round(least(greatest((score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-8), 0), 1), 6) AS normal FROM s WINDOW w AS (PARTITION BY query_id)")
def token_minmax(t: Inputs) -> DataFrame:
    """W9"""
    return qry.normalise_tokens(_scores(t), "minmax", ["query_id"]).select("gid", "query_id", F.round("normal", 6).alias("normal"))


@query(_TWO + ", l AS (SELECT gid % 10 AS k, base AS a, cand AS b FROM r), q AS (SELECT k, quantile_cont(b, 0.9) - avg(b) AS sp, corr(a, b) AS ag FROM l GROUP BY 1) SELECT k, round(sp, 6) AS specific, round(ag, 6) AS agree, round(1 / (1 + exp(-(8 * (sp * least(greatest(ag, 0), 1) - 0.1)))), 6) AS alpha FROM q")
def hybrid_gate(t: Inputs) -> DataFrame:
    """R13, R14"""
    rows = _two(t).select((F.col("gid") % 10).alias("k"), F.col("base").alias("a"), F.col("cand").alias("b"))
    g = qry.hybrid_gate(rows, ["k"], 0.9, 8.0, 0.1)
    return g.select("k", *(F.round(c, 6).alias(c) for c in ("specific", "agree", "alpha")))


@query(f"""WITH {_SCORES}, k AS (SELECT a.gid, a.query_id, a.score AS p, b.score AS q FROM s a JOIN s b ON b.gid = a.gid + 1 AND b.query_id = a.query_id), e AS (SELECT gid, query_id, exp(4 * (p - max(p) OVER w)) AS p, exp(4 * (q - max(q) OVER w)) AS q FROM k WINDOW w AS (PARTITION BY gid)),
d AS (SELECT gid, query_id, p / sum(p) OVER (PARTITION BY gid) AS p, q / sum(q) OVER (PARTITION BY gid) AS q FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY p DESC, query_id) AS r FROM k),
m AS (SELECT gid, abs(4 * (max(p) FILTER (r = 1) - max(p) FILTER (r = 2)) - 4 * (max(q) FILTER (r = 1) - max(q) FILTER (r = 2))) AS e FROM r GROUP BY 1)
SELECT d.gid, round(sum(p * ln(p / greatest(q, 1e-12))), 7) AS kl, arg_max(query_id, p) = arg_max(query_id, q) AS top1, round(max(m.e), 7) AS margin_error FROM d JOIN m ON m.gid = d.gid GROUP BY 1""")
def query_distribution_kl(t: Inputs) -> DataFrame:
    """R19, R20"""
    s = _scores(t)
    a = s.select("gid", "query_id", F.col("score").alias("p"))
    b = s.select((F.col("gid") - 1).alias("gid"), "query_id", F.col("score").alias("q"))
    return qry.query_kl(F.col("p"), F.col("q"), "gid", a.join(b, ["gid", "query_id"]), 4.0).select("gid", F.round("kl", 7).alias("kl"), "top1", F.round("margin_error", 7).alias("margin_error"))


_GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_IOU = f"{_SCORES}, f AS (SELECT s.query_id, s.score, p.label % 3 = s.query_id AS hit FROM s JOIN p USING (gid)), t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold), g AS (SELECT query_id, threshold, coalesce(count(*) FILTER (score > threshold AND hit) / nullif(count(*) FILTER (score > threshold OR hit), 0), 0) AS iou FROM f, t GROUP BY ALL)"


def _grid(t: Inputs) -> DataFrame:
    rows = _scores(t).join(t(POINTS).select("gid", "label"), "gid").withColumn("hit", F.col("label") % 3 == F.col("query_id"))
    return ev.threshold_grid(rows, _GRID, ["query_id"], "score", "hit")


@query(f"WITH {_IOU} SELECT query_id, threshold, round(iou, 6) AS iou FROM g")
def iou_threshold_grid(t: Inputs) -> DataFrame:
    """E2, E3, E5, E7"""
    return _grid(t).select("query_id", "threshold", F.round("iou", 6).alias("iou"))


@query(f"WITH {_IOU}, m AS (SELECT threshold, avg(iou) AS miou, avg((iou > 0.25)::INT) AS a25, avg((iou > 0.5)::INT) AS a50, count(*) AS n FROM g GROUP BY 1) SELECT threshold, round(miou, 6) AS miou, round(a25, 6) AS acc25, round(a50, 6) AS acc50, n FROM m ORDER BY m.miou DESC, threshold LIMIT 1")
def best_threshold(t: Inputs) -> DataFrame:
    """The flagship slice from phrase to best threshold"""
    s = ev.best_threshold(ev.summarise(_grid(t), ["threshold"]), [])
    return s.select("threshold", *(F.round(c, 6).alias(c) for c in ("miou", "acc25", "acc50")), "n")


@query(f"WITH {_IOU}, x AS (SELECT query_id AS scene, threshold, iou FROM g WHERE NOT (query_id = 1 AND threshold < 0.15)), y AS (SELECT scene, threshold, avg(iou) AS m FROM x GROUP BY ALL), q AS (SELECT threshold, avg(m) AS miou, count(*) AS scenes FROM y GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT scene) FROM x)) SELECT threshold, round(miou, 6) AS miou, scenes FROM q ORDER BY q.miou DESC, threshold LIMIT 1")
def shared_threshold(t: Inputs) -> DataFrame:
    """E6, J23"""
    rows = _grid(t).withColumnRenamed("query_id", "scene").where("not (scene = 1 and threshold < 0.15)")
    return ev.shared_threshold(rows).select("threshold", F.round("miou", 6).alias("miou"), "scenes")


_MET = "SELECT l_suppkey % 4 AS scene, l_returnflag AS method, l_linenumber / 10.0 AS threshold, avg(l_discount) AS miou FROM {lineitem} GROUP BY 1, 2, 3"


@query(f"WITH m AS ({_MET}), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY scene, method ORDER BY miou DESC, threshold) = 1) SELECT b.scene, b.method, round(b.miou, 6) AS miou, round(b.miou - a.miou, 6) AS delta FROM b LEFT JOIN b a ON a.scene = b.scene AND a.method = 'N'")
def report_deltas(t: Inputs) -> DataFrame:
    """E11, K15, J24, S19"""
    r = ev.report(t(_MET), "N")
    return r.select("scene", "method", F.round("miou", 6).alias("miou"), F.round("delta", 6).alias("delta"))


@query(f"WITH m AS ({_MET}), p AS (SELECT scene, max(miou) FILTER (method = 'N') AS b, max(miou) FILTER (method = 'R') AS r, avg(miou) FILTER (method = 'N') AS ab, avg(miou) FILTER (method = 'R') AS ar FROM m GROUP BY 1) SELECT scene, r - b >= 0.003 AND ar >= ab AND r >= b AS go FROM p")
def accept_gate(t: Inputs) -> DataFrame:
    """E15"""
    m = t(_MET)
    side = lambda f, n: m.where(F.col("method") == f).groupBy("scene").agg(F.max("miou").alias(f"{n}miou"), F.avg("miou").alias(f"{n}acc25"), F.max("miou").alias(f"{n}acc50"))
    return ev.gate(side("R", "").join(side("N", "base_"), "scene"))


@query("SELECT l_suppkey AS image, round(avg(abs(l_discount - l_tax)), 8) AS l1, round(avg((l_discount - l_tax) * (l_discount - l_tax)), 10) AS mse, round(-10 * log10(greatest(avg((l_discount - l_tax) * (l_discount - l_tax)), 1e-12)), 6) AS psnr FROM {lineitem} GROUP BY 1")
def image_metrics(t: Inputs) -> DataFrame:
    """E8"""
    m = ev.image_metrics(t("SELECT l_suppkey AS image, l_discount AS a, l_tax AS b FROM {lineitem}"), ["image"], "a", "b")
    return m.select("image", F.round("l1", 8).alias("l1"), F.round("mse", 10).alias("mse"), F.round("psnr", 6).alias("psnr"))


@query()
def image_ssim(t: Inputs) -> DataFrame:
    """Held against a direct convolution in the tests."""
    p = t("SELECT p_partkey % 3 AS image, (p_partkey div 3) % 25 AS px, p_partkey div 75 AS py, p_size / 50.0 AS a, (p_size + p_partkey % 5) / 55.0 AS b FROM {part}")
    return ev.ssim(p, ["image"], "a", "b").select("image", F.round("ssim", 6).alias("ssim"))


_MASK = "SELECT p_size % 5 AS mask, p_partkey // 40 AS px, p_partkey % 40 AS py FROM {part}"


@query(f"WITH m AS ({_MASK}), p AS (SELECT DISTINCT mask, px * 40 + py AS place FROM m), i AS (SELECT mask, place, place - row_number() OVER (PARTITION BY mask ORDER BY place) AS island FROM p) SELECT mask, min(place) AS start, count(*) AS length FROM i GROUP BY mask, island")
def mask_run_lengths(t: Inputs) -> DataFrame:
    """P22"""
    return ev.run_lengths(t(_MASK.replace("//", "div")), ["mask"], 40).select("mask", "start", "length")


@query(f"WITH m AS ({_MASK}) SELECT DISTINCT mask, px, py FROM m")
def mask_round_trip(t: Inputs) -> DataFrame:
    """Decoded again"""
    p = t(_MASK.replace("//", "div"))
    return ev.run_pixels(ev.run_lengths(p, ["mask"], 40), ["mask"], 40).select("mask", "px", "py")


@query("SELECT l_returnflag AS category, round(coalesce(sum(l_linenumber) * 1.0 / nullif(sum(l_linenumber + l_suppkey), 0), 0), 8) AS iou FROM {lineitem} GROUP BY 1")
def dataset_iou(t: Inputs) -> DataFrame:
    """E7"""
    return ev.dataset_iou(t("SELECT l_returnflag AS category, l_linenumber AS inter, l_linenumber + l_suppkey AS uni FROM {lineitem}"), ["category"]).select("category", F.round("iou", 8).alias("iou"))


@query(f"WITH p AS ({POINTS}) SELECT a.label, round(avg(list_dot_product(a.vec{_D}, b.vec{_D})), 6) AS cos, count(*) FILTER (list_dot_product(a.vec{_D}, b.vec{_D}) > 0) AS agree, max(round_even(255 * abs(a.vec[1]::DOUBLE), 0))::INT AS u8 FROM p a JOIN p b ON b.gid = a.gid + 1 GROUP BY 1")
def consistency_metrics(t: Inputs) -> DataFrame:
    """E10, A35, E14"""
    p = t(POINTS)
    rows = p.join(p.select((F.col("gid") - 1).alias("gid"), F.col("vec").alias("w")), "gid")
    c = dot("vec", "w")
    return rows.groupBy("label").agg(F.round(F.avg(c), 6).alias("cos"), F.count(F.when(c > 0, 1)).alias("agree"), F.max(half_even_u8(F.abs(F.col("vec")[0].cast("double")))).alias("u8"))
