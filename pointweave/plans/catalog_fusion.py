"""Queries that put consensus tables, groups and readouts together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.vec import dot, norm
from pointweave.operators import consensus as con
from pointweave.operators import fusion as fus
from pointweave.operators import query as qry
from pointweave.operators.codebook import nearest_code
from pointweave.plans import sqltext as q
from pointweave.plans.catalog_codebook import _CODES, _SLOTS
from pointweave.plans.catalog_observe import _SEGVEC
from pointweave.plans.catalog_query import _BRIDGE, _SCORES, _bridge, _scores
from pointweave.plans.registry import CONTRIBS, POINTS, Inputs, query

#: Stand-ins: base, auxiliary and fine sources are contributions of certain lines.
_BASE, _AUX, _FINE, _FLOOR = "line % 2 = 1", "line <= 3", "line % 3 <> 0", -0.5


def _cons(name: str, where: str) -> str:
    return f"""{name}_x AS ({q.vsum(f"(SELECT gid, split, w AS m, vec FROM (SELECT gid, view_id % 2 AS split, seg_id, sum(weight) AS w FROM c WHERE {where} GROUP BY ALL) JOIN v USING (seg_id))", "gid, split", "m")}),
{name}_p AS (SELECT gid, coalesce(max(w) FILTER (split = 0), 0) AS wa, coalesce(max(w) FILTER (split = 1), 0) AS wb, any_value(s) FILTER (split = 0) AS xa, any_value(s) FILTER (split = 1) AS xb FROM {name}_x GROUP BY 1),
{name}_q AS (SELECT *, {q.mix(f"coalesce(xa, {q.ZERO})", f"coalesce(xb, {q.ZERO})")} AS x FROM {name}_p),
{name} AS (SELECT gid, wa + wb AS total_w, wa, wb, {q.unit("x")} AS feature, wa > 0 AND wb > 0 AS has,
 CASE WHEN wa > 0 AND wb > 0 THEN {q.clip(f"({q.dot('xa', 'xb')} / greatest(sqrt({q.dot('xa', 'xa')}) * sqrt({q.dot('xb', 'xb')}), 1e-8) - ({_FLOOR})) / (1 - ({_FLOOR}))")} * sqrt(2 * least(wa, wb) / greatest(wa + wb, 1e-8)) ELSE 0 END AS rel FROM {name}_q)"""


_START = f"WITH c AS ({CONTRIBS}), v AS ({_SEGVEC})"


def _consensus(t: Inputs, where: str) -> DataFrame:
    return fus.split_consensus(t(CONTRIBS).where(where), t(_SEGVEC), F.pmod("view_id", F.lit(2)))


_SHARDS = f"""{_START}, x AS ({q.vsum("(SELECT gid, shard, w AS m, vec FROM (SELECT gid, view_id % 3 AS shard, seg_id, sum(weight) AS w FROM c GROUP BY ALL) JOIN v USING (seg_id))", "gid, shard", "m")}),
h AS (SELECT gid, shard, w, {q.unit("s")} AS vec, sqrt({q.dot("s", "s")}) / w AS mean_norm FROM x), e AS (SELECT *, w * greatest(mean_norm, 0) AS e FROM h),
m AS ({q.vsum("e", "gid", "e")}), n AS (SELECT gid, {q.unit("s")} AS feature FROM m)"""


def _shards(t: Inputs) -> DataFrame:
    rows = t(CONTRIBS).withColumn("shard", F.pmod("view_id", F.lit(3)))
    return con.consensus(rows, t(_SEGVEC), ["gid", "shard"])


@query(_SHARDS + f""", a AS ({q.vsum("(SELECT * FROM e WHERE shard <> 1)", "gid", "e")}), d AS (SELECT gid, sum(w) AS total_w, sum(CASE WHEN shard = 1 THEN w ELSE 0 END) AS wb, count(*) FILTER (e > 0) AS supported,
 sum(CASE WHEN e > 0 THEN 1 - {q.clip(q.dot("vec", "feature"), "-1")} ELSE 0 END) AS dispersion FROM e JOIN n USING (gid) GROUP BY 1)
SELECT gid, round(feature[1], 6) AS first, round(total_w, 4) AS total_w, round(wb, 4) AS odd_w, supported, round(dispersion, 6) AS dispersion, round(a.s[1] / greatest(sqrt({q.dot("a.s", "a.s")}), 1e-8), 6) AS even_first FROM n JOIN d USING (gid) LEFT JOIN a USING (gid)""")
def shard_consensus(t: Inputs) -> DataFrame:
    """A22 (exact mean): shards' evidence, even and odd centres, dispersion"""
    m = fus.shard_merge(_shards(t))
    return m.select("gid", F.round(F.col("feature")[0], 6).alias("first"), F.round("total_w", 4).alias("total_w"), F.round("wb", 4).alias("odd_w"), "supported", F.round("dispersion", 6).alias("dispersion"), F.round(F.col("sa")[0], 6).alias("even_first"))


@query()
def robust_shard_consensus(t: Inputs) -> DataFrame:
    """A22 (geometric median), A21: held against plain code in the tests"""
    m = fus.robust_shard_merge(_shards(t))
    return m.select("gid", F.round(norm("feature"), 6).alias("length"), F.round("dispersion", 6).alias("dispersion"), "supported")


_GATE = f"CASE WHEN NOT coalesce(a.has, false) THEN 0 WHEN NOT coalesce(b.has, false) THEN 1 ELSE {q.sigmoid('(a.rel - b.rel) / 0.05')} END"
_FUSED = f"""{_START}, {_cons("b", _BASE)}, {_cons("a", _AUX)}, j AS (SELECT coalesce(b.gid, a.gid) AS gid, b.feature AS fb, a.feature AS fa, coalesce(b.rel, 0) AS rb, coalesce(a.rel, 0) AS ra, coalesce(a.has, false) AS ha, b.gid IS NOT NULL AS vb, a.gid IS NOT NULL AS va, {_GATE} AS gate FROM b FULL JOIN a ON a.gid = b.gid)"""


@query(_FUSED + f""", k AS (SELECT gid, gate, CASE WHEN NOT vb THEN fa WHEN NOT va THEN fb ELSE {q.mix("fb", "fa", "0.8 * gate")} END AS x FROM j), n AS (SELECT gid, gate, {q.unit("x")} AS f FROM k)
SELECT gid, round(gate, 5) AS gate, round(f[1], 5) AS first, round(f[64], 5) AS last FROM n""")
def fuse_consensus(t: Inputs) -> DataFrame:
    """Split-consistency fusion with its fallbacks"""
    f = fus.fuse(_consensus(t, _BASE), _consensus(t, _AUX), 0.8, 0.05, _FLOOR)
    return f.select("gid", F.round("gate", 5).alias("gate"), F.round(F.col("feature")[0], 5).alias("first"), F.round(F.col("feature")[63], 5).alias("last"))


_DIS = q.clip(f"1 - {q.dot('f.feature', 'j.fa')}", "0", "2")
_CAP = _FUSED + f""", {_cons("f", _FINE)}, g AS (SELECT j.*, f.feature AS ff, coalesce(f.rel, 0) AS rf, f.total_w AS wf, vb AND (NOT ha OR greatest(rb, ra) < 0.3 OR (abs(ra - rb) < 0.03 AND greatest(rb, ra) < 0.4)) AS falls,
 coalesce(f.gid IS NOT NULL AND f.has AND va AND f.rel >= 0.25 AND {_DIS} >= 0.05, false) AS eligible, coalesce({_DIS}, 0) AS dis, ln(1 + coalesce(f.total_w, 0)) AS lg FROM j LEFT JOIN f ON f.gid = j.gid),
med AS (SELECT coalesce(quantile_disc(lg, 0.5), 0) AS m FROM g WHERE eligible), sc AS (SELECT gid, row_number() OVER (ORDER BY rf * dis * {q.sigmoid("(rf - ra) / 0.05")} * {q.sigmoid("m - lg")} DESC, gid) AS r FROM g, med WHERE eligible),
z AS (SELECT g.*, CASE WHEN falls THEN 0 ELSE gate END AS gt, sc.r IS NOT NULL AND sc.r <= greatest(1, round_even(0.15 * (SELECT count(*) FROM g), 0)) AS fine FROM g LEFT JOIN sc USING (gid)),
y AS (SELECT *, CASE WHEN NOT vb THEN fa WHEN NOT va THEN fb ELSE {q.mix("fb", "fa", "1.5 * gt")} END AS x FROM z), w AS (SELECT gid, gt, fine, CASE WHEN fine THEN {q.mix("x", "ff", "0.5")} ELSE x END AS x FROM y), u AS (SELECT gid, gt, fine, {q.unit("x")} AS f FROM w)"""


@query(_CAP + " SELECT gid, round(gt, 5) AS gate, fine, CASE WHEN fine THEN 3 ELSE 2 END AS capacity, round(f[1], 5) AS first FROM u")
def capacity_fusion(t: Inputs) -> DataFrame:
    """A26 (a7.3, margin and rarity): fallback, rare reliable fine points, capacity 2 or 3"""
    parts = [_consensus(t, w) for w in (_BASE, _AUX, _FINE)]
    f = fus.capacity_fusion(*parts, "a7.3", "margin_rarity", floor=_FLOOR, peak=0.3, ambiguous=0.4, least_rel=0.25, least_dis=0.05)
    return f.select("gid", F.round("gate", 5).alias("gate"), "fine", "capacity", F.round(F.col("feature")[0], 5).alias("first"))


_OBS = f"""{_START}, {_cons("b", "true")}, o AS ({q.vsum("(SELECT gid, view_id, w AS m, vec FROM (SELECT gid, view_id, seg_id, sum(weight) AS w FROM c GROUP BY ALL) JOIN v USING (seg_id))", "gid, view_id", "m")}),
o2 AS (SELECT o.gid, view_id % 2 AS split, sqrt(o.w) AS e, {q.unit("o.s")} AS vec, b.feature FROM o JOIN b ON b.gid = o.gid), o3 AS (SELECT * FROM o2 WHERE {q.clip(q.dot("vec", "feature"), "-1")} <= 0.75),
s AS ({q.vsum("o3", "gid, split", "e")}), n AS (SELECT gid, split, count(*) AS n FROM o3 GROUP BY ALL),
p AS (SELECT gid, any_value(s) FILTER (split = 0) AS sa, any_value(s) FILTER (split = 1) AS sb, max(w) FILTER (split = 0) AS wa, max(w) FILTER (split = 1) AS wb, max(n) FILTER (split = 0) AS na, max(n) FILTER (split = 1) AS nb FROM s JOIN n USING (gid, split) GROUP BY 1),
r AS (SELECT *, {q.unit("sa")} AS ca, {q.unit("sb")} AS cb, {q.clip(f"sqrt({q.dot('sa', 'sa')}) / wa")} AS ka, {q.clip(f"sqrt({q.dot('sb', 'sb')}) / wb")} AS kb, {q.clip("2 * least(wa, wb) / (wa + wb)")} AS balance FROM p WHERE sa IS NOT NULL AND sb IS NOT NULL),
y AS (SELECT *, {q.clip(q.dot("ca", "cb"), "-1")} AS cross_, {q.mix("ca", "cb")} AS x FROM r), z AS (SELECT y.*, {q.clip(f"{q.dot('x', 'b.feature')} / greatest(sqrt({q.dot('x', 'x')}), 1e-8)", "-1")} AS base_cos FROM y JOIN b USING (gid)),
k AS (SELECT *, least(na, nb) >= 2 AND least(ka, kb) >= 0.3 AND cross_ >= -0.1 AND base_cos <= 0.98 AS selected FROM z)"""


@query(_OBS + f" SELECT gid, selected, round(CASE WHEN selected THEN {q.clip('(cross_ + 0.1) / 1.1')} * sqrt(ka * kb) * sqrt(balance) * sqrt({q.clip('least(na, nb) / 3.0')}) ELSE 0 END, 6) AS reliability, round(cross_, 6) AS agreement, round(base_cos, 6) AS base_cos, round(ka, 6) AS compact_a FROM k")
def second_modes(t: Inputs) -> DataFrame:
    """Second modes that both halves of the views recover"""
    o = con.weighted_sums(t(CONTRIBS), t(_SEGVEC), ["gid", "view_id"]).select("gid", F.col("view_id").alias("view_index"), "s", F.col("total_w").alias("w"))
    m = fus.second_modes(o, _consensus(t, "true"), views=2, saturation=3, compact=0.3, across=-0.1, most_base=0.98)
    return m.select("gid", "selected", F.round("reliability", 6).alias("reliability"), F.round("cross", 6).alias("agreement"), F.round("base_cos", 6).alias("base_cos"), F.round("compact_a", 6).alias("compact_a"))


_HYP = f"""{_START}, {_cons("f", _FINE)}, {_cons("a", _AUX)}, h AS (SELECT f.gid, f.feature, round_even(255 * {q.clip(f"f.rel * ({q.sigmoid('(f.rel - coalesce(a.rel, 0)) / 0.05')})")}, 0)::INT AS u8 FROM f LEFT JOIN a ON a.gid = f.gid WHERE f.has AND f.gid % 3 = 0)"""


@query(_HYP + f", {_cons('b', _BASE)} SELECT h.gid, h.u8 AS reliability, round_even(255 * (u8 / 255.0 * {q.clip(q.dot('h.feature', 'b.feature'))}), 0)::INT AS directed, round(h.feature[1], 6) AS first FROM h JOIN b ON b.gid = h.gid")
def sparse_hypotheses(t: Inputs) -> DataFrame:
    """Sparse hypotheses of chosen fine points, and their directional weights"""
    fine = _consensus(t, _FINE)
    h = fus.sparse_hypotheses(fine, _consensus(t, _AUX), fine.where("gid % 3 = 0"), 0.05, _FLOOR)
    d = fus.reweight_hypotheses(h, _consensus(t, _BASE)).select("gid", F.col("reliability").alias("directed"))
    return h.join(d, "gid").select("gid", "reliability", "directed", F.round(F.col("feature")[0], 6).alias("first"))


#: Each point in two of sixteen groups; slot 0 is the larger score's.
_MEMBER = f"SELECT gid, gid % 12 AS group_id, 0 AS slot, (gid % 5 + 2) / 8.0 AS score FROM ({POINTS}) p0 UNION ALL SELECT gid, 12 + gid % 4, 1, (gid % 3 + 1) / 8.0 FROM ({POINTS}) p1"


def _member(t: Inputs) -> DataFrame:
    return t(_MEMBER).withColumn("score", F.col("score").cast("double"))


def _features(t: Inputs) -> DataFrame:
    return t(POINTS).select("gid", F.col("vec").alias("feature"))


_TAUGHT = f"WITH p AS ({POINTS}), m AS ({_MEMBER}), j AS (SELECT group_id, score, score * score AS w2, vec FROM m JOIN p USING (gid)), x AS ({q.vsum('j', 'group_id', 'w2')}), g AS (SELECT group_id, w, {q.unit('s')} AS f FROM x)"


@query(_TAUGHT + " SELECT group_id, round(f[1], 6) AS first, round(w, 6) AS total_w FROM g")
def taught_groups(t: Inputs) -> DataFrame:
    """A18"""
    return fus.teach_groups(_features(t), _member(t), 2.0).select("group_id", F.round(F.col("feature")[0], 6).alias("first"), F.round("total_w", 6).alias("total_w"))


@query(f"WITH p AS ({POINTS}), m AS ({_MEMBER}), j AS (SELECT group_id, score, vec FROM m JOIN p USING (gid)), x AS ({q.vsum('j', 'group_id', 'score')}), g AS (SELECT group_id, {q.unit('s')} AS f FROM x) SELECT group_id, round(sum({q.dot('vec::DOUBLE[]', 'f')} * score) / sum(score), 6) AS agreement, count(*) AS n FROM j JOIN g USING (group_id) GROUP BY 1")
def group_centres(t: Inputs) -> DataFrame:
    """A20"""
    return fus.group_statistics(_features(t), _member(t)).select("group_id", F.round("agreement", 6).alias("agreement"), "n")


@query()
def robust_groups(t: Inputs) -> DataFrame:
    """Reweighted rounds; held against plain code in the tests"""
    sure = t(POINTS).select("gid", ((F.col("gid") % 5 + 2) / 8.0).alias("best"), ((F.col("gid") % 3 + 1) / 8.0).alias("second"), (F.col("gid") % 9 + 1).cast("double").alias("weight"))
    g = fus.teach_groups_robustly(_features(t), _member(t), sure)
    return g.select("group_id", F.round(F.col("feature")[0], 6).alias("first"), F.round("agreement", 6).alias("agreement"))


@query(f"""WITH k AS ({_SLOTS}), e AS ({_CODES}), j AS (SELECT gid, vec FROM k JOIN e USING (code_id)), x AS ({q.vsum('j', 'gid')}), p AS (SELECT gid, {q.unit('s')} AS vec FROM x), m AS ({_MEMBER}),
r AS (SELECT group_id, score, vec FROM m JOIN p USING (gid)), y AS ({q.vsum('r', 'group_id', 'score')}) SELECT group_id, round(s[1] / greatest(sqrt({q.dot('s', 's')}), 1e-8), 6) AS first, round(w, 6) AS total_w FROM y""")
def reestimated_groups(t: Inputs) -> DataFrame:
    """A17"""
    codes = t(_CODES).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("level"), "code_id", "vec")
    g = fus.reestimate_groups(t(_SLOTS).withColumnRenamed("slot", "level"), codes, _member(t))
    return g.select("group_id", F.round(F.col("feature")[0], 6).alias("first"), F.round("total_w", 6).alias("total_w"))


_REV = _TAUGHT + f""", e AS ({_CODES}), d AS (SELECT group_id, code_id, f, e.vec::DOUBLE[] AS c, {q.dot('f', 'e.vec::DOUBLE[]')} AS s FROM g, e), n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY s DESC, code_id) = 1),
u AS (SELECT group_id, sum(score) AS usage FROM m GROUP BY 1), l AS (SELECT n.*, u.usage, {q.mix('f', 'c', '-1')} AS r FROM n JOIN u USING (group_id)),
t AS (SELECT *, sqrt({q.dot('r', 'r')}) AS rn, s / greatest(sqrt({q.dot('f', 'f')}) * sqrt({q.dot('c', 'c')}), 1e-8) AS cs, {q.mix('c', 'r', '0.4')} AS rf FROM l)"""


@query(_REV + f" SELECT group_id, code_id, round(rn, 6) AS residual_norm, round(cs, 6) AS cosine, round(greatest(pow(greatest(usage / max(usage) OVER (), 1e-6) * greatest(exp(-rn / 0.5), 1e-6) * greatest({q.clip('(cs + 1) / 2')}, 1e-6), 0.5), 1e-6), 6) AS prior, round(rf[1] / greatest(sqrt({q.dot('rf', 'rf')}), 1e-9), 6) AS first FROM t")
def reverse_index(t: Inputs) -> DataFrame:
    """What codes leave of groups, features with residuals, and the prior"""
    groups = fus.teach_groups(_features(t), _member(t), 2.0)
    codes = t(_CODES)
    assigned = nearest_code(groups, codes, gid="group_id", vec="feature")
    stats = fus.reverse_statistics(groups, codes, assigned, _member(t).groupBy("group_id").agg(F.sum("score").alias("usage")))
    prior = fus.reverse_prior(stats, "usage_residual_cosine", 0.5)
    feature = fus.reverse_features(stats, 0.4)
    return stats.join(prior, "group_id").join(feature, "group_id").select("group_id", "code_id", F.round("residual_norm", 6).alias("residual_norm"), F.round("cosine", 6).alias("cosine"), F.round("prior", 6).alias("prior"), F.round(F.col("feature")[0], 6).alias("first"))


@query(_TAUGHT + ", o AS (SELECT gid, max(score) FILTER (slot = 0) AS a, max(score) FILTER (slot = 1) AS b, max(group_id) FILTER (slot = 0) AS k FROM m GROUP BY 1) SELECT o.gid, round((0.2 + 0.8 * sqrt(greatest(a - b, 0) / greatest(a, 1e-8))) * a * least(greatest((list_dot_product(p.vec::DOUBLE[], g.f) / greatest(sqrt(list_dot_product(p.vec::DOUBLE[], p.vec::DOUBLE[])), 1e-8) - 0.05) / 0.95, 0), 1), 6) AS confidence FROM o JOIN p ON p.gid = o.gid JOIN g ON g.group_id = o.k")
def group_confidence(t: Inputs) -> DataFrame:
    """Confidence from the lead, the first membership and the agreement of features"""
    m = _member(t)
    agree = fus.feature_agreement(_features(t), fus.teach_groups(_features(t), m, 2.0), m, 0.05, 1.0)
    return fus.membership_confidence(m, 0.2, 0.5, True, agree).select("gid", F.round("confidence", 6).alias("confidence"))


_READ = f"WITH {_BRIDGE}, y AS (SELECT gid, query_id, sum(w * s) / greatest(sum(w), 1e-8) AS grp FROM j GROUP BY ALL), b AS (SELECT y.gid, y.query_id, s.score AS base, grp FROM y JOIN s ON s.gid = y.gid AND s.query_id = y.query_id)"


def _read(t: Inputs) -> DataFrame:
    m, g = _bridge(t)
    group = qry.group_activation(m, g, "weighted").withColumnRenamed("score", "group")
    return _scores(t).withColumnRenamed("score", "base").join(group, ["gid", "query_id"])


@query(_READ + """, qn AS (SELECT query_id, quantile_cont(base, 0.5) AS bl, quantile_cont(base, 0.9) AS bm, quantile_cont(base, 0.99) AS bh, quantile_cont(grp, 0.5) AS gl, quantile_cont(grp, 0.9) AS gm, quantile_cont(grp, 0.99) AS gh, coalesce(corr(base, grp), 0) AS ag FROM b GROUP BY 1),
a AS (SELECT query_id, 0.1 + 0.5 / (1 + exp(-((least(greatest((gh - gm) / greatest(gh - gl, 1e-6), 0), 1) - least(greatest((bh - bm) / greatest(bh - bl, 1e-6), 0), 1) + 0.5 * (ag - 0.2) - 0.05) / 0.2))) AS al FROM qn)
SELECT gid, query_id, round(al * grp + (1 - al) * base, 6) AS convex, round(base + al * grp, 6) AS additive, round(base + al * greatest(grp - base, 0), 6) AS positive FROM b JOIN a USING (query_id)""")
def hybrid_readout(t: Inputs) -> DataFrame:
    """The gate from specificity and agreement, and its three blends"""
    rows = _read(t)
    rows = rows.join(fus.hybrid_alpha(rows, ["query_id"], 0.1, 0.6, 0.5, 0.2, 0.05, 0.2), "query_id")
    out = {n: fus.hybrid_blend(F.col("base"), F.col("group"), F.col("alpha"), m) for n, m in (("convex", "convex"), ("additive", "additive"), ("positive", "positive_residual"))}
    return rows.select("gid", "query_id", *(F.round(c, 6).alias(n) for n, c in out.items()))


@query(f"WITH {_SCORES}, x AS (SELECT query_id, (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-9) AS x, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM s WINDOW w AS (PARTITION BY query_id)) SELECT query_id, round(least(greatest(0.1 + 0.5 * (1 - least(greatest(max(x) - min(x), 0), 1)), 0), 0.6), 6) AS share FROM x WHERE r <= 5 GROUP BY 1")
def adaptive_coarse_share(t: Inputs) -> DataFrame:
    """R13"""
    return fus.adaptive_coarse_share(_scores(t), ["query_id"], "score", 0.1, 0.6, 5).select("query_id", F.round("share", 6).alias("share"))


@query(f"WITH c AS ({CONTRIBS}), m AS (SELECT gid, max(weight) AS m FROM c GROUP BY 1), z AS (SELECT quantile_cont(m, 0.5) AS q50, quantile_cont(m, 0.9) AS q90, quantile_cont(m, 0.99) AS q99 FROM m), t AS (SELECT unnest([10.0, 30.0, 45.0]::DOUBLE[]) AS threshold) SELECT threshold, count(*) FILTER (m.m >= threshold) AS kept, count(*) AS points, round(max(q50), 6) AS q50, round(max(q90), 6) AS q90, round(max(q99), 6) AS q99 FROM m, z, t GROUP BY 1")
def contribution_quantiles(t: Inputs) -> DataFrame:
    """Masks for several thresholds, and quantiles of the largest contribution"""
    from pointweave.operators.observe import contribution_masks

    return contribution_masks(t(CONTRIBS), [10.0, 30.0, 45.0], [0.5, 0.9, 0.99]).select("threshold", "kept", "points", *(F.round(f"q{n}", 6).alias(f"q{n}") for n in (50, 90, 99)))


@query(_START + f""", o AS ({q.vsum("(SELECT gid, view_id, w AS m, vec FROM (SELECT gid, view_id, seg_id, sum(weight) AS w FROM c GROUP BY ALL) JOIN v USING (seg_id))", "gid, view_id", "m")}), a AS ({q.vsum("(SELECT gid, s AS vec, w FROM o)", "gid")}), w AS (SELECT gid, sum(w) AS w FROM o GROUP BY 1),
r AS (SELECT o.gid, o.view_id, {q.mix("a.s", "o.s", "-1")} AS x, w.w - o.w AS left_w FROM o JOIN a ON a.gid = o.gid JOIN w ON w.gid = o.gid) SELECT gid, view_id, round(x[1] / greatest(sqrt({q.dot("x", "x")}), 1e-8), 5) AS first FROM r WHERE left_w > 1e-6""")
def leave_one_view_out_vectors(t: Inputs) -> DataFrame:
    """The direction of all other views' evidence"""
    own = con.weighted_sums(t(CONTRIBS), t(_SEGVEC), ["gid", "view_id"])
    rest = con.others(own, "gid")
    return rest.select("gid", "view_id", F.round(F.col("feature")[0], 5).alias("first"))


@query(f"WITH p AS ({POINTS}), x AS ({q.vsum('p', 'label')}) SELECT p.label, round(sum((p.gid % 3 + 1) * (1 - {q.dot('p.vec::DOUBLE[]', 's')} / greatest(sqrt({q.dot('s', 's')}) * sqrt({q.dot('p.vec::DOUBLE[]', 'p.vec::DOUBLE[]')}), 1e-8))) / sum(p.gid % 3 + 1), 6) AS loss FROM p JOIN x USING (label) GROUP BY 1")
def cosine_loss(t: Inputs) -> DataFrame:
    """X5 (weighted cosine): as a metric of points against their label's direction"""
    p = t(POINTS)
    centre = con.vector_sum(p, ["label"], "vec")
    rows = p.join(centre, "label").withColumn("w", (F.col("gid") % 3 + 1).cast("double"))
    return con.weighted_cosine_loss(rows, ["label"], "vec", "s", "w").select("label", F.round("loss", 6).alias("loss"))


@query(f"WITH p AS ({POINTS}), e AS ({_CODES}), z AS (SELECT gid, code_id, {q.dot('p.vec::DOUBLE[]', 'e.vec::DOUBLE[]')} / 0.1 AS z FROM p, e), l AS (SELECT gid, max(z) AS m FROM z GROUP BY 1), k AS (SELECT z.gid, ln(sum(exp(z - m))) + max(m) - max(z) FILTER (code_id = z.gid % 32) AS ce FROM z JOIN l USING (gid) GROUP BY 1) SELECT gid, round(ce, 6) AS loss FROM k")
def contrastive_loss(t: Inputs) -> DataFrame:
    """X5 (contrastive cross-entropy): of each point's own code among all"""
    rows = t(POINTS).join(F.broadcast(t(_CODES).withColumnRenamed("vec", "c")), F.lit(True))
    scored = rows.select("gid", dot("vec", "c").alias("s"), (F.col("code_id") == F.col("gid") % 32).alias("own"))
    return con.contrastive_loss(scored, ["gid"], "s", "own", 0.1).select("gid", F.round("loss", 6).alias("loss"))
