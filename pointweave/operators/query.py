"""Scoring points for phrases, routing between hypotheses, blending."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.vec import clip, sigmoid
from pointweave.operators.order import first_n

#: Bytes of phrases that a worker holds; scores that it makes at once.
PHRASE_BYTES, SCORES = 64 << 20, 1 << 20


def phrase_scores(points: DataFrame, phrases: DataFrame, gid: str = "gid", vec: str = "vec", temperature: float = 10.0) -> DataFrame:
    """(gid, query_id, score): relevancy of every point to every positive phrase against
    all negatives. ``phrases``: (query_id, polarity, vec), which go to every worker, in
    blocks of PHRASE_BYTES; Arrow batches of points meet them as matrix products."""
    own = phrases.where("polarity > 0").select("query_id", "vec")
    against = phrases.where("polarity < 0").select("vec").toArrow().column("vec")
    negative = np.array(against.to_pylist(), float)
    width = negative.shape[1]
    blocks = max(1, -(-own.count() * width * 8 // PHRASE_BYTES))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (points.schema[gid], phrases.schema["query_id"]))
    out = None
    for b in range(blocks):
        got = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        held = points.sparkSession.sparkContext.broadcast((got.column("query_id").combine_chunks(), np.array(got.column("vec").to_pylist(), float).reshape(-1, width), negative))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, positive, negative = held.value
            step = max(1, SCORES // max(len(ids), 1))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                    s = temperature * (v @ positive.T - (v @ negative.T).max(1)[:, None])
                    score = 1 / (1 + np.exp(-np.clip(s, -700, 700)))
                    at = np.repeat(np.arange(part.num_rows), len(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), ids.take(pa.array(np.tile(np.arange(len(ids)), part.num_rows))), pa.array(score.ravel())], names=[gid, "query_id", "score"])

        part = points.where(F.col(vec).isNotNull()).select(gid, vec).mapInArrow(run, f"{kinds}, score double")
        out = part if out is None else out.unionByName(part)
    return out


def semantic_argmax(scores: DataFrame, gid: str = "gid", least: float = 0.5) -> DataFrame:
    """(gid, query_id): the best phrase, the lowest of equals; null where a negative wins."""
    best = scores.groupBy(gid).agg(F.max(F.struct("score", (-F.col("query_id")).alias("q"))).alias("b"))
    return best.select(gid, F.when(F.col("b.score") > least, -F.col("b.q")).alias("query_id"), F.col("b.score").alias("score"))


def margins(scores: DataFrame, gid: str = "gid", value: str = "score", out: str = "margin") -> DataFrame:
    """Adds each score less the best of the point's other phrases, by the two largest."""
    w = Window.partitionBy(gid)
    top = F.max(value).over(w)
    ranked = scores.withColumn("__r", F.row_number().over(w.orderBy(F.col(value).desc(), "query_id"))).withColumn("__top", top)
    second = F.max(F.when(F.col("__r") == 2, F.col(value))).over(w)
    other = F.when(F.col("__r") == 1, second).otherwise(F.col("__top"))
    return ranked.withColumn(out, F.col(value) - F.coalesce(other, F.lit(0.0))).drop("__r", "__top")


def route(base: Column, cand: Column, base_margin: Column, cand_margin: Column, valid: Column, mode: str, reliability: Column | None = None) -> Column:
    """One of four rules between two scores of a point: by margin, by positive margin, by
    the query's score, or blending its gain by reliability."""
    if mode == "margin_switch":
        pick = cand_margin > base_margin
    elif mode == "margin_positive":
        pick = (cand_margin > base_margin) & (cand > base)
    elif mode == "query_positive":
        pick = cand > base
    elif mode == "query_positive_blend":
        return F.when(valid, base + reliability * F.greatest(cand - base, F.lit(0.0))).otherwise(base)
    else:
        raise ValueError(f"no such routing mode: {mode}")
    return F.when(valid & pick, cand).otherwise(base)


#: Which factors join a candidate's gain, by priority mode.
PRIORITIES = {
    "query_gain": (),
    "membership_gain": ("member",),
    "query_margin_gain": ("margin",),
    "membership_margin_gain": ("member", "margin"),
    "reliability_gain": ("reliability",),
    "reliability_margin_gain": ("reliability", "margin"),
}


def route_budget(base: DataFrame, candidates: DataFrame, fraction: float, mode: str = "query_gain", gid: str = "gid") -> DataFrame:
    """(gid, score, routed): each point's best slot by priority, the first of equals; then
    the best points overall, at most ceil(fraction x covered), take their candidate.

    base: (gid, base); candidates: (gid, slot, cand, member[, margin, reliability]), only
    valid ones. A priority is the gain over the base, if positive, times the mode's
    factors: membership and reliability within [0, 1], the margin if positive."""
    if mode not in PRIORITIES or not 0 <= fraction <= 1:
        raise ValueError(f"no such priority or share: {mode}, {fraction}")
    p = F.greatest(F.col("cand") - F.col("base"), F.lit(0.0))
    for factor in PRIORITIES[mode]:
        p = p * F.greatest(F.col(factor), F.lit(0.0)) if factor == "margin" else p * clip(factor, 0.0, 1.0)
    w = Window.partitionBy(gid).orderBy(F.col("p").desc(), "slot")
    best = candidates.join(base, gid).withColumn("p", p).withColumn("r", F.row_number().over(w)).where("r = 1 and p > 0")
    covered = candidates.select(gid).distinct().count()
    chosen = first_n(best, math.ceil(fraction * covered - 1e-9), [F.col("p").desc(), F.col(gid)]).select(gid, "cand")
    return base.join(chosen, gid, "left").select(gid, F.coalesce("cand", "base").alias("score"), F.col("cand").isNotNull().alias("routed"))


def positive_blend(base: Column, cand: Column, gate: Column, valid: Column) -> Column:
    return F.when(valid, base + gate * F.greatest(cand - base, F.lit(0.0))).otherwise(base)


def group_activation(memberships: DataFrame, group_scores: DataFrame, how: str, gid: str = "gid", share: float = 0.5, heat: float = 10.0) -> DataFrame:
    """(gid, query_id, score): a point's groups put together. memberships: (gid, group_id,
    member); group_scores: (group_id, query_id, score)."""
    rows = memberships.join(group_scores, "group_id").select(gid, "query_id", "member", F.col("score").alias("s"))
    m, s = F.col("member"), F.col("s")
    top = F.max("s")
    mean = F.sum(m * s) / F.greatest(F.sum("member"), F.lit(1e-8))
    # less the row's largest score, so that no heat overflows
    tilt = F.exp(heat * (s - F.col("top")))
    soft = F.sum(m * tilt * s) / F.greatest(F.sum(m * tilt), F.lit(1e-300))
    if how.startswith("query_softmax"):
        rows = rows.withColumn("top", F.max("s").over(Window.partitionBy(gid, "query_id")))
    forms = {
        "max": top,
        "score_max": F.max(m * s),
        "weighted": mean,
        "weighted_maxblend": share * top + (1 - share) * mean,
        "noisy_or": 1 - F.product(1 - clip(m * s, 0.0, 1.0)),
        "query_softmax": soft,
        "query_softmax_maxblend": share * top + (1 - share) * soft,
    }
    return rows.groupBy(gid, "query_id").agg(forms[how].alias("score"))


def dynamic_groups(mounts: DataFrame, heat: float, share: float) -> DataFrame:
    """(group_id, query_id, score): a coarse group's score blended with its mounts', which
    weigh by softmax of score with a log prior; the blend grows with how specific
    (1 - entropy over its bound) the weights are. mounts: (group_id, query_id, fine_id,
    prior, fine, coarse)."""
    w = Window.partitionBy("group_id", "query_id")
    z = heat * F.col("fine") + F.log(F.greatest("prior", F.lit(1e-8)))
    e = F.exp(z - F.max(z).over(w))
    p = e / F.sum(e).over(w)
    rows = mounts.withColumn("p", p)
    out = rows.groupBy("group_id", "query_id").agg(F.sum(F.col("p") * F.col("fine")).alias("soft"), (-F.sum(F.col("p") * F.log(F.greatest("p", F.lit(1e-12))))).alias("h"), F.count("*").alias("n"), F.max("coarse").alias("coarse"))
    specific = F.when(F.col("n") > 1, 1 - F.col("h") / F.log(F.col("n").cast("double"))).otherwise(1.0)
    return out.select("group_id", "query_id", (F.col("coarse") + share * specific * (F.col("soft") - F.col("coarse"))).alias("score"))


def normalise_tokens(scores: DataFrame, how: str, by: list[str], value: str = "score") -> DataFrame:
    """Scores of a query made comparable: minmax, percentile (5 to 95) or zscore through a
    sigmoid, population deviation."""
    if how == "minmax":
        stats = scores.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    elif how == "percentile":
        stats = scores.groupBy(*by).agg(F.percentile(value, 0.05).alias("lo"), F.percentile(value, 0.95).alias("hi"))
    else:
        stats = scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev"))
    rows = scores.join(stats, by)
    if how == "zscore":
        return rows.withColumn("normal", sigmoid((F.col(value) - F.col("mean")) / F.greatest("dev", F.lit(1e-8)))).drop("mean", "dev")
    return rows.withColumn("normal", clip((F.col(value) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)), 0.0, 1.0)).drop("lo", "hi")


def hybrid_gate(rows: DataFrame, by: list[str], quantile: float, slope: float, middle: float) -> DataFrame:
    """(by, specific, agree, alpha): how far the upper quantile of a score stands above its
    mean, its correlation with the other score, and the gate from both."""
    out = rows.groupBy(*by).agg((F.percentile("b", quantile) - F.avg("b")).alias("specific"), F.corr("a", "b").alias("agree"))
    agree = clip(F.coalesce("agree", F.lit(0.0)), 0.0, 1.0)
    return out.withColumn("alpha", sigmoid(slope * (F.col("specific") * agree - middle)))


def query_kl(p: Column, q: Column, gid: str, rows: DataFrame, heat: float) -> DataFrame:
    """(gid, kl, top1, margin_error): softmax distributions over a bank of two score sets,
    and how far the gap between the two phrases that lead ``p`` differs in ``q``."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(gid).orderBy(p.desc(), "query_id")))
    gap = lambda c: heat * (F.max(F.when(F.col("__r") == 1, c)) - F.max(F.when(F.col("__r") == 2, c)))
    margin = ranked.groupBy(gid).agg(F.abs(gap(p) - gap(q)).alias("margin_error"))
    w = Window.partitionBy(gid)
    r = rows.withColumn("p", F.exp(heat * (p - F.max(p).over(w)))).withColumn("q", F.exp(heat * (q - F.max(q).over(w))))
    r = r.withColumn("p", F.col("p") / F.sum("p").over(w)).withColumn("q", F.col("q") / F.sum("q").over(w))
    best = lambda c: F.max(F.struct(c, (-F.col("query_id")).alias("i")))
    return r.groupBy(gid).agg(F.sum(F.col("p") * F.log(F.col("p") / F.greatest("q", F.lit(1e-12)))).alias("kl"), (best("p")["i"] == best("q")["i"]).alias("top1")).join(margin, gid)


def novelty(recon_cos: Column, noise: Column, ratio: float) -> Column:
    """Whether 1 - similarity outgrows the quantisation noise."""
    return (1 - recon_cos) > ratio * noise


def counterfactual(gains: list[Column], least: float) -> Column:
    """Whether the least gain over the splits passes ``least``."""
    return (F.least(*gains) if len(gains) > 1 else gains[0]) > least


def softmax_over(rows: DataFrame, by: list[str], columns: list[str], heat: float) -> DataFrame:
    """Scores of a bank as distributions: softmax of heat x score over each ``by``."""
    w = Window.partitionBy(*by)
    out = rows
    for c in columns:
        out = out.withColumn(c, F.exp(heat * (F.col(c) - F.max(c).over(w))))
    for c in columns:
        out = out.withColumn(c, F.col(c) / F.sum(c).over(w))
    return out


def consistency(rows: DataFrame, pairs: list[tuple[str, str]], heat: float, gid: str = "gid") -> DataFrame:
    """One row: for each pair of score columns of (gid, query_id, ..) the mean symmetric KL of
    their distributions over the bank, and the share of points whose best phrase flips."""
    names = sorted({c for p in pairs for c in p})
    d = softmax_over(rows, [gid], names, heat)
    best = {c: F.max(F.struct(c, (-F.col("query_id")).alias("i")))["i"].alias(f"best_{c}") for c in names}
    apart = lambda a, b: F.sum((F.greatest(a, F.lit(1e-8)) - F.greatest(b, F.lit(1e-8))) * (F.log(F.greatest(a, F.lit(1e-8))) - F.log(F.greatest(b, F.lit(1e-8))))) / 2
    per = d.groupBy(gid).agg(*best.values(), *(apart(a, b).alias(f"kl_{a}_{b}") for a, b in pairs))
    return per.agg(*(F.avg(f"kl_{a}_{b}").alias(f"kl_{a}_{b}") for a, b in pairs), *(F.avg((F.col(f"best_{a}") != F.col(f"best_{b}")).cast("double")).alias(f"flips_{a}_{b}") for a, b in pairs), F.count("*").alias("n"))


def rank_metrics(rows: DataFrame, cosines: DataFrame, heat: float, kl_weight: float, margin_weight: float, gid: str = "gid") -> DataFrame:
    """One row (cosine, query_kl, margin_mae, top1, score, n): how well predictions (gid,
    query_id, p) keep the ranking of targets t over a bank, beside (gid, cos)."""
    z = rows.select(gid, "query_id", (F.col("p") * heat).alias("zp"), (F.col("t") * heat).alias("zt"), F.col("p").alias("p"), F.col("t").alias("t"))
    d = softmax_over(z, [gid], ["p", "t"], heat)
    order = lambda c: F.row_number().over(Window.partitionBy(gid).orderBy(F.col(c).desc(), "query_id"))
    d = d.withColumn("rt", order("zt")).withColumn("rp", order("zp"))
    gap = lambda c: F.max(F.when(F.col("rt") == 1, F.col(c))) - F.max(F.when(F.col("rt") == 2, F.col(c)))
    per = d.groupBy(gid).agg(F.sum(F.col("t") * (F.log(F.greatest("t", F.lit(1e-300))) - F.log(F.greatest("p", F.lit(1e-300))))).alias("kl"), F.abs(gap("zp") - gap("zt")).alias("mae"), F.max(((F.col("rt") == 1) & (F.col("rp") == 1)).cast("double")).alias("top1"))
    out = per.join(cosines, gid).agg(F.avg("cos").alias("cosine"), F.avg("kl").alias("query_kl"), F.avg("mae").alias("margin_mae"), F.avg("top1").alias("top1"), F.count("*").alias("n"))
    return out.withColumn("score", (1 - F.col("cosine")) + kl_weight * F.col("query_kl") + margin_weight * F.col("margin_mae"))


def top_code_groups(code_scores: DataFrame, group_codes: DataFrame, most: int) -> DataFrame:
    """(query_id, group_id): groups whose code is among a query's ``most`` best; the lower code
    of equals. code_scores: (query_id, code_id, score); group_codes: (group_id, code_id)."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "code_id"))
    return code_scores.withColumn("r", r).where(F.col("r") <= most).join(group_codes, "code_id").select("query_id", "group_id")
