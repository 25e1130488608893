"""Consensus tables put together: shards, base and auxiliary sources, second modes, teachers.

A consensus row is (gid, feature, total_w, sa, sb, wa, wb): a unit direction, its weight, and
the directions and weights of two splits of the views; a split without weight has null and 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.vec import add, clip, cosine, directional_weight, disagreement, dot, half_even_u8, l2_normalize, norm, scale, sigmoid
from pointweave.operators.codebook import reconstruct
from pointweave.operators.consensus import fusion_gate, geometric_median, split_reliability, top_fraction, vector_sum, weighted_sums
from pointweave.plans.storage import stored

SIDES = ("feature", "total_w", "sa", "sb", "wa", "wb")


def _pick(split: int, column: str) -> Column:
    return F.max(F.when(F.col("split") == split, F.struct(column)))[column]


def _together(a: Column, b: Column) -> Column:
    """a + b of vectors, either of which may be null."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(add(a, b))


def split_consensus(contribs: DataFrame, segments: DataFrame, split: Column, gid: str = "gid") -> DataFrame:
    """Consensus rows of contributions whose view falls into split 0 or 1."""
    sums = weighted_sums(contribs.withColumn("split", split.cast("int")), segments, [gid, "split"])
    both = sums.groupBy(gid).agg(*(_pick(i, "s").alias(f"s{n}") for i, n in enumerate("ab")), *(F.coalesce(_pick(i, "total_w"), F.lit(0.0)).alias(f"w{n}") for i, n in enumerate("ab")))
    whole = _together(F.col("sa"), F.col("sb"))
    return both.select(gid, l2_normalize(whole).alias("feature"), (F.col("wa") + F.col("wb")).alias("total_w"), l2_normalize("sa").alias("sa"), l2_normalize("sb").alias("sb"), "wa", "wb")


def shard_merge(shards: DataFrame, gid: str = "gid") -> DataFrame:
    """(consensus row, dispersion, supported) from (gid, shard, feature, total_w, mean_norm).

    Evidence is weight times mean norm. The feature is the direction of the evidence-weighted
    sum; even and odd shards make the splits; dispersion sums 1 - cosine with the feature
    over the ``supported`` shards that have evidence. A point has few shards, so its rows
    meet in one array."""
    rows = shards.withColumn("e", F.col("total_w") * F.greatest("mean_norm", F.lit(0.0)))
    sums = vector_sum(rows.withColumn("split", F.pmod("shard", F.lit(2)).cast("int")), [gid, "split"], "feature", "e")
    both = sums.groupBy(gid).agg(*(F.when(_pick(i, "total_w") > 0, _pick(i, "s")).alias(f"s{n}") for i, n in enumerate("ab")))
    centre = both.select(gid, l2_normalize(_together(F.col("sa"), F.col("sb"))).alias("centre"), l2_normalize("sa").alias("sa"), l2_normalize("sb").alias("sb"))
    apart = F.when(F.col("e") > 0, 1 - clip(dot("feature", "centre"), -1.0, 1.0)).otherwise(0.0)
    half = lambda i: F.sum(F.when(F.pmod("shard", F.lit(2)) == i, F.col("total_w")).otherwise(0.0))
    stats = rows.join(centre.select(gid, "centre"), gid).groupBy(gid).agg(F.sum("total_w").alias("total_w"), half(0).alias("wa"), half(1).alias("wb"), F.sum(apart).alias("dispersion"), F.count(F.when(F.col("e") > 0, 1)).alias("supported"))
    return stats.join(centre, gid).select(gid, F.col("centre").alias("feature"), "total_w", "sa", "sb", "wa", "wb", "dispersion", "supported")


def robust_shard_merge(shards: DataFrame, power: float = 0.5, rounds: int = 8, gid: str = "gid") -> DataFrame:
    """:func:`shard_merge` with the feature at the geometric median of the shards' features,
    weighing evidence to the ``power``; dispersion is about that."""
    rows = shards.withColumn("e", F.col("total_w") * F.greatest("mean_norm", F.lit(0.0)))
    median = geometric_median(rows.withColumn("__w", F.pow("e", F.lit(power))), [gid], "feature", "__w", rounds).withColumnRenamed("median", "__m")
    apart = F.when(F.col("e") > 0, 1 - clip(dot("feature", "__m"), -1.0, 1.0)).otherwise(0.0)
    spread = rows.join(median, gid).groupBy(gid).agg(F.sum(apart).alias("__d"))
    return shard_merge(shards, gid).join(median, gid).join(spread, gid).withColumn("feature", F.col("__m")).withColumn("dispersion", F.col("__d")).drop("__m", "__d")


def _reliable(p: str, floor: float) -> tuple[Column, Column]:
    """(reliability, whether both splits have weight) of a consensus with prefixed columns."""
    has = (F.coalesce(f"{p}wa", F.lit(0.0)) > 0) & (F.coalesce(f"{p}wb", F.lit(0.0)) > 0)
    return F.when(has, split_reliability(F.col(f"{p}sa"), F.col(f"{p}sb"), F.col(f"{p}wa"), F.col(f"{p}wb"), floor)).otherwise(0.0), has


def _side(df: DataFrame, p: str, gid: str) -> DataFrame:
    return df.select(gid, *(F.col(c).alias(f"{p}{c}") for c in SIDES))


def _scored(rows: DataFrame, p: str, floor: float) -> DataFrame:
    r, has = _reliable(p, floor)
    return rows.withColumn(f"{p}rel", r).withColumn(f"{p}has", has).withColumn(f"{p}valid", F.coalesce(f"{p}total_w", F.lit(0.0)) > 0)


def _gate(heat: float) -> Column:
    """The auxiliary's share: by the gap of reliabilities; 0 without its splits, 1 where only
    it has both."""
    return F.when(~F.col("a_has"), F.lit(0.0)).when(~F.col("b_has"), F.lit(1.0)).otherwise(fusion_gate(F.col("b_rel"), F.col("a_rel"), heat))


def _mixed(share: Column) -> Column:
    return F.when(~F.col("b_valid"), F.col("a_feature")).when(F.col("a_feature").isNull(), F.col("b_feature")).otherwise(add("b_feature", scale("a_feature", share)))


def fuse(base: DataFrame, aux: DataFrame, most: float = 1.0, heat: float = 0.05, floor: float = 0.0, gid: str = "gid") -> DataFrame:
    """(gid, feature, gate): base plus gate times ``most`` times aux, of unit length; points
    that only one of them has keep it; points without weight in either are left out."""
    rows = _side(base, "b_", gid).join(_side(aux, "a_", gid), gid, "full")
    rows = _scored(_scored(rows, "b_", floor), "a_", floor).where("b_valid or a_valid").withColumn("gate", _gate(heat))
    return rows.select(gid, l2_normalize(_mixed(most * F.col("gate"))).alias("feature"), "gate")


#: Which variants fall back on the base, and which add fine points; the factors
#: of a fine point's score by mode.
FALLS_BACK, ADDS_FINE = ("a7.1", "a7.3"), ("a7.2", "a7.3")
FINE_SCORES = {"stability": (), "margin": ("margin",), "support_rarity": ("rarity",), "margin_rarity": ("margin", "rarity")}


def capacity_fusion(base: DataFrame, aux: DataFrame, fine: DataFrame, variant: str, mode: str = "stability", most: float = 1.5, heat: float = 0.05, floor: float = 0.0, peak: float = 0.5, margin: float = 0.03, ambiguous: float = 0.75, least_rel: float = 0.6, least_dis: float = 0.1, fraction: float = 0.15, weight: float = 0.5, gid: str = "gid") -> DataFrame:
    """(gid, feature, gate, fine, capacity) of points with base or auxiliary weight.

    Where the variant falls back, the gate is 0 for points of the base whose auxiliary lacks
    a split, whose better reliability is under ``peak``, or whose reliabilities are within
    ``margin`` while the better is under ``ambiguous``. Where it adds fine points, the best
    ``fraction`` of the population among reliable ones that disagree with the auxiliary take
    ``weight`` times the fine feature, and capacity 3 in place of 2. Rarity is about the
    lower median of the eligible points' log support."""
    if variant not in ("a7.0", *FALLS_BACK, *ADDS_FINE) or mode not in FINE_SCORES:
        raise ValueError(f"no such variant or score: {variant}, {mode}")
    rows = _side(base, "b_", gid).join(_side(aux, "a_", gid), gid, "full").join(_side(fine, "f_", gid), gid, "left")
    for p in ("b_", "a_", "f_"):
        rows = _scored(rows, p, floor)
    rows = rows.where("b_valid or a_valid")
    top, gap = F.greatest("b_rel", "a_rel"), F.abs(F.col("a_rel") - F.col("b_rel"))
    falls = F.col("b_valid") & (~F.col("a_has") | (top < peak) | ((gap < margin) & (top < ambiguous)))
    gate = _gate(heat)
    rows = rows.withColumn("gate", F.when(falls, F.lit(0.0)).otherwise(gate) if variant in FALLS_BACK else gate)
    rows = rows.withColumn("mix", _mixed(most * F.col("gate")))
    if variant not in ADDS_FINE:
        return rows.select(gid, l2_normalize("mix").alias("feature"), "gate", F.lit(False).alias("fine"), F.lit(2).alias("capacity"))
    rows = rows.withColumn("dis", F.coalesce(disagreement("f_feature", "a_feature"), F.lit(0.0))).withColumn("log", F.log1p(F.coalesce("f_total_w", F.lit(0.0))))
    rows = rows.withColumn("eligible", F.col("f_valid") & F.col("f_has") & F.col("a_valid") & (F.col("f_rel") >= least_rel) & (F.col("dis") >= least_dis))
    rows = stored(rows.select(gid, "mix", "gate", "f_feature", "f_rel", "a_rel", "dis", "log", "eligible"), "capacity")
    centre = rows.where("eligible").agg(F.expr("percentile_disc(0.5) within group (order by log)").alias("m")).first()["m"] or 0.0
    factors = {"margin": sigmoid((F.col("f_rel") - F.col("a_rel")) / heat), "rarity": sigmoid(F.lit(centre) - F.col("log"))}
    score = F.col("f_rel") * F.col("dis")
    for name in FINE_SCORES[mode]:
        score = score * factors[name]
    scored = rows.where("eligible").select(gid, score.alias("score"))
    best = top_fraction(scored, fraction, rows.count(), "score", gid, F.lit(True)).select(gid, F.lit(True).alias("fine")) if fraction > 0 else scored.limit(0).select(gid, F.lit(True).alias("fine"))
    out = rows.join(best, gid, "left").withColumn("fine", F.coalesce("fine", F.lit(False)))
    mix = F.when(F.col("fine"), add("mix", scale("f_feature", F.lit(weight)))).otherwise(F.col("mix"))
    return out.select(gid, l2_normalize(mix).alias("feature"), "gate", "fine", F.when(F.col("fine"), 3).otherwise(2).alias("capacity"))


def second_modes(observed: DataFrame, base: DataFrame, apart: float = 0.75, power: float = 0.5, least_w: float = 0.0, views: int = 3, saturation: int = 6, compact: float = 0.88, across: float = 0.9, most_base: float = 0.9, gid: str = "gid") -> DataFrame:
    """(gid, candidate, selected, reliability, compact_a, compact_b, cross, base_cos, balance).

    observed: (gid, view_index, s, w), one sum of vectors a view and point; base: (gid,
    feature). Observations whose direction has at most cosine ``apart`` with the base are
    summed in even and odd views, weighing w to the ``power``. A second mode is selected
    where both halves have enough views, are compact, agree with each other and not with
    the base; its reliability is agreement x compactness x balance x support."""
    rows = observed.join(base.where(norm("feature") > 0).select(gid, l2_normalize("feature").alias("b")), gid).withColumn("v", l2_normalize("s"))
    rows = rows.where((F.col("w") >= least_w) & (clip(dot("v", "b"), -1.0, 1.0) <= apart)).withColumn("e", F.pow("w", F.lit(power)))
    keyed = rows.select(gid, F.pmod("view_index", F.lit(2)).cast("int").alias("split"), "v", "e")
    sums = vector_sum(keyed, [gid, "split"], "v", "e").join(keyed.groupBy(gid, "split").agg(F.count("*").alias("n")), [gid, "split"]).where("total_w > 0")
    both = sums.groupBy(gid).agg(*(_pick(i, c).alias(f"{c}{k}") for i, k in enumerate("ab") for c in ("s", "total_w", "n"))).where("sa is not null and sb is not null")
    both = both.join(base.select(gid, l2_normalize("feature").alias("b")), gid)
    tight = lambda k: clip(norm(f"s{k}") / F.greatest(f"total_w{k}", F.lit(1e-8)), 0.0, 1.0)
    both = both.withColumn("compact_a", tight("a")).withColumn("compact_b", tight("b")).withColumn("ca", l2_normalize("sa")).withColumn("cb", l2_normalize("sb"))
    both = both.withColumn("cross", clip(dot("ca", "cb"), -1.0, 1.0)).withColumn("candidate", l2_normalize(add("ca", "cb"))).withColumn("base_cos", clip(dot("candidate", "b"), -1.0, 1.0))
    both = both.withColumn("balance", clip(2 * F.least("total_wa", "total_wb") / F.greatest(F.col("total_wa") + F.col("total_wb"), F.lit(1e-8)), 0.0, 1.0))
    fewest = F.least("na", "nb")
    selected = (fewest >= views) & (F.least("compact_a", "compact_b") >= compact) & (F.col("cross") >= across) & (F.col("base_cos") <= most_base)
    agree = clip((F.col("cross") - across) / max(1e-8, 1 - across), 0.0, 1.0)
    value = clip(agree * F.sqrt(F.col("compact_a") * F.col("compact_b")) * F.sqrt("balance") * F.sqrt(clip(fewest / saturation, 0.0, 1.0)), 0.0, 1.0)
    return both.select(gid, "candidate", selected.alias("selected"), F.when(selected, value).otherwise(0.0).alias("reliability"), "compact_a", "compact_b", "cross", "base_cos", "balance")


def sparse_hypotheses(fine: DataFrame, aux: DataFrame, chosen: DataFrame, heat: float = 0.05, floor: float = 0.0, gid: str = "gid") -> DataFrame:
    """(gid, feature, reliability u8): fine features of chosen points whose two splits have
    weight; reliability is the fine one times a sigmoid of its lead over the auxiliary."""
    rows = _side(fine, "f_", gid).join(chosen.select(gid).distinct(), gid).join(_side(aux, "a_", gid), gid, "left")
    rows = _scored(_scored(rows, "f_", floor), "a_", floor).where("f_has")
    value = clip(F.col("f_rel") * sigmoid((F.col("f_rel") - F.col("a_rel")) / heat), 0.0, 1.0)
    return rows.select(gid, l2_normalize("f_feature").alias("feature"), half_even_u8(value).alias("reliability"))


def reweight_hypotheses(hypotheses: DataFrame, base: DataFrame, gid: str = "gid") -> DataFrame:
    """Reliability times the cosine with the base's feature, held in [0, 1]; in 255ths."""
    rows = hypotheses.join(base.select(gid, F.col("feature").alias("__b")), gid)
    return rows.withColumn("reliability", half_even_u8(directional_weight(F.col("reliability") / 255.0, "feature", "__b"))).drop("__b")


# --- groups taught by points ------------------------------------------------


def teach_groups(points: DataFrame, memberships: DataFrame, power: float = 1.0, gid: str = "gid") -> DataFrame:
    """(group_id, feature, total_w): direction of the points' features, each weighing its
    membership score (at least 0) to the ``power``. points: (gid, feature), memberships:
    (gid, group_id, score)."""
    rows = memberships.join(points.select(gid, "feature"), gid).withColumn("__w", F.pow(F.greatest("score", F.lit(0.0)), F.lit(power)))
    out = vector_sum(rows, ["group_id"], "feature", "__w").where("total_w > 1e-9")
    return out.select("group_id", l2_normalize("s").alias("feature"), "total_w")


def group_statistics(points: DataFrame, memberships: DataFrame, gid: str = "gid") -> DataFrame:
    """(group_id, feature, agreement, n): the weighted centre, the weighted mean cosine with
    it, and the members."""
    centre = teach_groups(points, memberships, 1.0, gid)
    w = F.greatest("score", F.lit(0.0))
    rows = memberships.join(points.select(gid, F.col("feature").alias("__v")), gid).join(centre.select("group_id", "feature"), "group_id")
    stats = rows.groupBy("group_id").agg((F.sum(dot("__v", "feature") * w) / F.greatest(F.sum(w), F.lit(1e-9))).alias("agreement"), F.count("*").alias("n"))
    return centre.select("group_id", "feature").join(stats, "group_id")


def teach_groups_robustly(points: DataFrame, memberships: DataFrame, confidence: DataFrame, rounds: int = 3, power: float = 1.0, agree_power: float = 1.0, floor: float = 0.2, gid: str = "gid") -> DataFrame:
    """(group_id, feature, total_w, agreement): :func:`teach_groups`, then reweighted rounds.

    confidence: (gid, best, second, weight). A point's reliability is its lead margin over
    ``floor`` times the root of its weight over the 90th percentile; in each round a
    membership weighs score^power x reliability x cosine^agree_power with the group's
    current feature; a group without weight keeps its feature."""
    # the quantile is over the taught points
    taught = confidence.join(points.select(gid), gid, "left_semi")
    scale_ = taught.agg(F.percentile("weight", 0.9).alias("q")).first()["q"] or 1.0
    margin = clip((F.col("best") - F.col("second")) / F.greatest("best", F.lit(1e-6)), 0.0, 1.0)
    sure = confidence.select(gid, ((floor + (1 - floor) * margin) * F.sqrt(clip(F.col("weight") / max(scale_, 1e-6), 0.0, 1.0))).alias("__c"))
    rows = memberships.join(points.select(gid, F.col("feature").alias("__v")), gid).join(sure, gid)
    rows = stored(rows.select("group_id", "__v", (F.pow(F.greatest("score", F.lit(0.0)), F.lit(power)) * F.col("__c")).alias("__r")), "teach-rows")
    now = stored(teach_groups(points, memberships, power, gid).select("group_id", "feature"), "teach-groups")
    for _ in range(rounds):
        near = rows.join(now, "group_id").withColumn("__a", clip(dot("__v", "feature"), 0.0, 1.0))
        near = near.withColumn("__w", F.col("__r") * F.pow("__a", F.lit(agree_power)))
        sums = vector_sum(near, ["group_id"], "__v", "__w")
        agree = near.groupBy("group_id").agg((F.sum(F.col("__w") * F.col("__a")) / F.greatest(F.sum("__w"), F.lit(1e-12))).alias("agreement"))
        new = now.join(sums, "group_id", "left").join(agree, "group_id", "left")
        good = F.coalesce("total_w", F.lit(0.0)) > 1e-9
        now = stored(new.select("group_id", F.when(good, l2_normalize("s")).otherwise(F.col("feature")).alias("feature"), F.coalesce("total_w", F.lit(0.0)).alias("total_w"), F.when(good, F.col("agreement")).otherwise(0.0).alias("agreement")), "teach-groups")
        result, now = now, now.select("group_id", "feature")
    return result


def reestimate_groups(point_codes: DataFrame, codes: DataFrame, memberships: DataFrame, gid: str = "gid") -> DataFrame:
    """(group_id, feature, total_w): groups from the vectors that points' codes stand for.
    point_codes: (gid, level, code_id); only scores above 0 count."""
    points = reconstruct(point_codes, codes, [gid], ["level", "code_id"])
    return teach_groups(points, memberships.where("score > 0"), 1.0, gid)


# --- readouts ---------------------------------------------------------------


def membership_confidence(memberships: DataFrame, floor: float, power: float, use_first: bool = False, agreement: DataFrame | None = None, gid: str = "gid") -> DataFrame:
    """(gid, confidence): floor + (1 - floor) x lead of the first membership over the second,
    to the ``power``; times the first one, and the agreement (gid, agreement), if asked.
    Memberships are (gid, slot, score), scores held in [0, 1]."""
    s = clip("score", 0.0, 1.0)
    at = lambda i: F.coalesce(F.max(F.when(F.col("slot") == i, s)), F.lit(0.0))
    rows = memberships.groupBy(gid).agg(at(0).alias("first"), at(1).alias("second"))
    lead = F.pow(F.greatest(F.col("first") - F.col("second"), F.lit(0.0)) / F.greatest("first", F.lit(1e-8)), F.lit(power))
    value = floor + (1 - floor) * lead
    if use_first:
        value = value * F.col("first")
    if agreement is not None:
        rows = rows.join(agreement, gid, "left")
        value = value * F.coalesce("agreement", F.lit(0.0))
    return rows.select(gid, value.alias("confidence"))


def feature_agreement(points: DataFrame, groups: DataFrame, memberships: DataFrame, floor: float, power: float, gid: str = "gid") -> DataFrame:
    """(gid, agreement): how far a point's feature agrees with its first group's."""
    rows = memberships.where("slot = 0").join(points.select(gid, F.col("feature").alias("p")), gid).join(groups.select("group_id", F.col("feature").alias("g")), "group_id")
    return rows.select(gid, F.pow(clip((cosine("p", "g") - floor) / max(1e-8, 1 - floor), 0.0, 1.0), F.lit(power)).alias("agreement"))


def hybrid_blend(base: Column, group: Column, alpha: Column, mode: str) -> Column:
    """convex, additive, or the group's gain alone (positive_residual)."""
    if mode == "convex":
        return alpha * group + (1 - alpha) * base
    if mode == "additive":
        return base + alpha * group
    if mode == "positive_residual":
        return base + alpha * F.greatest(group - base, F.lit(0.0))
    raise ValueError(f"no such blend: {mode}")


def specificity(scores: DataFrame, by: list[str], value: str, low: float = 0.5, mid: float = 0.9, high: float = 0.99) -> DataFrame:
    """(by, specific): how much of the spread of a score lies above its middle quantile."""
    q = scores.groupBy(*by).agg(*(F.percentile(value, x).alias(n) for n, x in (("lo", low), ("mi", mid), ("hi", high))))
    return q.select(*by, clip((F.col("hi") - F.col("mi")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)), 0.0, 1.0).alias("specific"))


def hybrid_alpha(rows: DataFrame, by: list[str], least: float, most: float, agree_weight: float, agree_centre: float, bias: float, heat: float, inverse: bool = False, quantiles: tuple[float, float, float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(by, alpha): the group's share, from how much more specific it is than the base and
    how they correlate. rows: (by, base, group)."""
    s = specificity(rows, by, "base", *quantiles).withColumnRenamed("specific", "sb").join(specificity(rows, by, "group", *quantiles).withColumnRenamed("specific", "sg"), by)
    s = s.join(rows.groupBy(*by).agg(F.coalesce(F.nanvl(F.corr("base", "group"), F.lit(0.0)), F.lit(0.0)).alias("agree")), by)
    gap = (F.col("sb") - F.col("sg")) if inverse else (F.col("sg") - F.col("sb"))
    gate = sigmoid((gap + agree_weight * (F.col("agree") - agree_centre) - bias) / heat)
    return s.select(*by, (least + (most - least) * gate).alias("alpha"))


def adaptive_coarse_share(fine: DataFrame, by: list[str], value: str, least: float, most: float, k: int) -> DataFrame:
    """(by, share): the coarse share, lower where the k best fine scores are spread."""
    # of a query's scores each task hands on k at most
    best = fine.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc()))).where(F.col("__r") <= max(2, k))
    ends = fine.groupBy(*by).agg((F.max(value) - F.min(value)).alias("__span"))
    top = best.groupBy(*by).agg((F.max(value) - F.min(value)).alias("__gap")).join(ends, by)
    top = top.withColumn("s", clip(F.col("__gap") / F.greatest("__span", F.lit(1e-9)), 0.0, 1.0))
    return top.select(*by, clip(least + (most - least) * (1 - F.col("s")), 0.0, most).alias("share"))


def reverse_statistics(groups: DataFrame, codes: DataFrame, assigned: DataFrame, usage: DataFrame) -> DataFrame:
    """(group_id, code_id, residual, residual_norm, cosine, usage): what its code leaves of
    each group. groups: (group_id, feature), codes: (code_id, vec), usage: (group_id, usage)."""
    rows = groups.join(assigned.select("group_id", "code_id"), "group_id").join(codes.select("code_id", "vec"), "code_id").join(usage, "group_id", "left")
    left = F.zip_with("feature", "vec", lambda x, y: x - y)
    return rows.select("group_id", "code_id", "vec", left.alias("residual"), norm(left).alias("residual_norm"), cosine("feature", "vec").alias("cosine"), F.coalesce("usage", F.lit(0.0)).alias("usage"))


def reverse_features(stats: DataFrame, share: float) -> DataFrame:
    """(group_id, feature): code plus ``share`` of the residual, of unit length."""
    return stats.select("group_id", l2_normalize(add("vec", scale("residual", F.lit(share))), 1e-9).alias("feature"))


def reverse_prior(stats: DataFrame, mode: str, power: float = 1.0, heat: float = 0.5) -> DataFrame:
    """(group_id, prior): usage over the largest, exp(-residual norm / heat) and (cosine + 1)
    / 2, as far as the mode names them, multiplied and raised to ``power``."""
    parts = {"usage": F.greatest("usage", F.lit(0.0)) / F.greatest("__most", F.lit(1e-9)), "residual": F.exp(-F.col("residual_norm") / max(heat, 1e-6)), "cosine": clip((F.col("cosine") + 1) / 2, 0.0, 1.0)}
    chosen = [v for k, v in parts.items() if k in mode]
    if not chosen:
        raise ValueError(f"no such prior: {mode}")
    prior = F.lit(1.0)
    for v in chosen:
        prior = prior * F.greatest(v, F.lit(1e-6))
    rows = stats.join(F.broadcast(stats.agg(F.max("usage").alias("__most"))), F.lit(True))
    return rows.select("group_id", F.greatest(F.pow(prior, F.lit(power)), F.lit(1e-6)).alias("prior"))

