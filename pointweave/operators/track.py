"""Segments linked across views, and soft membership of points in tracks."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.vec import binary_entropy, clip, cosine, dot, l2_normalize, once
from pointweave.operators.codebook import reconstruct
from pointweave.operators.consensus import vector_sum
from pointweave.operators.graph import components
from pointweave.operators.order import numbered
from pointweave.plans.storage import stored

#: Groups of a block of vector sums, and rows of a batch that a scene yields.
ROWS = 2048


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The k first rows of each key in a total order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def signatures(contribs: DataFrame, keys: list[str], gid: str = "gid", weight: str = "weight") -> DataFrame:
    """(keys, gid, w): mass of each point in each segment, rows of unit length."""
    mass = contribs.groupBy(*keys, gid).agg(F.sum(weight).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(*keys)))
    return mass.select(*keys, gid, "m", (F.col("m") / F.greatest(length, F.lit(1e-8))).alias("w"))


def spatial_statistics(contribs: DataFrame, points: DataFrame, keys: list[str], gid: str = "gid", weight: str = "weight", pos: str = "pos") -> DataFrame:
    """(keys, cx, cy, cz, radius): weighted centre and root mean square distance from it."""
    mass = contribs.groupBy(*keys, gid).agg(F.sum(weight).alias("w")).join(points.select(gid, pos), gid)
    axes = "xyz"
    means = [(F.sum(F.col("w") * F.col(pos)[i]) / F.sum("w")).alias(f"c{a}") for i, a in enumerate(axes)]
    second = (F.sum(F.col("w") * sum((F.col(pos)[i] * F.col(pos)[i] for i in range(3)), F.lit(0.0))) / F.sum("w")).alias("m2")
    out = mass.groupBy(*keys).agg(*means, second)
    spread = F.col("m2") - sum((F.col(f"c{a}") * F.col(f"c{a}") for a in axes), F.lit(0.0))
    return out.select(*keys, "cx", "cy", "cz", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("radius"))


def pair_reduce(pairs: DataFrame, value: str = "w") -> DataFrame:
    return pairs.groupBy("gid", "track").agg(F.sum(value).alias(value))


def membership(contribs: DataFrame, segment_track: DataFrame, majority: float = 0.5, view: str = "view_id", gid: str = "gid", seg: str = "seg_id", weight: str = "weight") -> DataFrame:
    """(gid, track, score, votes, seen, entropy): foreground mass of a track over all mass
    of the point in the views where the track is visible; a view votes for it when the
    foreground there is over ``majority`` of the point's mass. Mass is summed per view and
    point before anything is joined."""
    by_seg = contribs.groupBy(view, gid, seg).agg(F.sum(weight).alias("m"))
    total = by_seg.groupBy(view, gid).agg(F.sum("m").alias("total"))
    fg = by_seg.join(segment_track, [view, seg]).groupBy(view, gid, "track").agg(F.sum("m").alias("fg"))
    candidate = fg.select(gid, "track").distinct()
    visible = segment_track.select(view, "track").distinct()
    rows = candidate.join(visible, "track").join(total, [view, gid]).join(fg, [view, gid, "track"], "left").withColumn("fg", F.coalesce("fg", F.lit(0.0)))
    out = rows.groupBy(gid, "track").agg((F.sum("fg") / F.greatest(F.sum("total"), F.lit(1e-8))).alias("score"), F.sum((F.col("fg") > majority * F.col("total")).cast("long")).alias("votes"), F.count("*").alias("seen"))
    return out.withColumn("entropy", binary_entropy("votes", "seen"))


def pack_memberships(rows: DataFrame, most: int, threshold: float, score: str = "score") -> DataFrame:
    """The ``most`` best tracks of each point above ``threshold``, with their slot."""
    w = Window.partitionBy("gid").orderBy(F.col(score).desc(), "track")
    return rows.where(F.col(score) > threshold).withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < most)


def exact_sum(p: Column) -> Column:
    """Sum of doubles as multiples of 2^-60, the same in any order of the rows (while it is
    under 2^23 and of as few terms): equal sums compare equal."""
    wide = p.cast("double") * float(1 << 30)
    fine = F.rint((wide - F.rint(wide)) * float(1 << 30))
    return (F.sum(F.rint(wide)) + F.sum(fine) / float(1 << 30)) / float(1 << 30)


def reciprocal(scored: DataFrame, side: list[str]) -> DataFrame:
    """(a, b, score): of (side, a, b, score) the pairs that are the best of a and the best of b
    within its side, ties to the lower node. A pair given more than once counts by its best
    score and comes once."""
    scored = stored(scored.select(*side, "a", "b", "score"), "scored")
    other = [(-F.col(c)).alias(c) for c in ("b", *side)]
    of_a = scored.groupBy("a").agg(F.max(F.struct("score", *other)).alias("m")).select("a", *((-F.col("m")[c]).alias(c) for c in ("b", *side)), F.col("m.score").alias("score"))
    of_b = scored.groupBy(*side, "b").agg(F.max(F.struct("score", (-F.col("a")).alias("a"))).alias("m")).select(*side, "b", (-F.col("m.a")).alias("a"))
    return of_a.join(of_b, [*side, "a", "b"]).select("a", "b", "score")


def mutual_best(sig_a: DataFrame, sig_b: DataFrame, vec_a: DataFrame, vec_b: DataFrame, least_overlap: float, least_cos: float, spatial: tuple[DataFrame, DataFrame, float, float] | None = None) -> DataFrame:
    """(a, b, score): reciprocal best pairs by shared mass times similarity above
    ``least_cos``. Signatures are (node, gid, w); vectors (node, vec); only nodes that
    share a point meet. ``spatial``: centres (node, pos, radius) of both sides, the largest
    distance in summed radii and a power of the Gaussian factor."""
    x, y = sig_a.select(F.col("node").alias("a"), "gid", F.col("w").alias("wa")), sig_b.select(F.col("node").alias("b"), "gid", F.col("w").alias("wb"))
    over = x.join(y, "gid").groupBy("a", "b").agg(exact_sum(F.col("wa") * F.col("wb")).alias("overlap")).where(F.col("overlap") >= least_overlap)
    pairs = over.join(vec_a.select(F.col("node").alias("a"), F.col("vec").alias("va")), "a").join(vec_b.select(F.col("node").alias("b"), F.col("vec").alias("vb")), "b")
    score = F.col("overlap") * clip((dot("va", "vb") - least_cos) / (1 - least_cos), 0.0, 1.0)
    if spatial:
        ca, cb, most, power = spatial
        pairs = pairs.join(ca.select(F.col("node").alias("a"), F.col("pos").alias("pa"), F.col("radius").alias("ra")), "a").join(cb.select(F.col("node").alias("b"), F.col("pos").alias("pb"), F.col("radius").alias("rb")), "b")
        gap = F.aggregate(F.zip_with("pa", "pb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
        r = F.sqrt(gap) / F.greatest(F.col("ra") + F.col("rb"), F.lit(1e-8))
        score = F.when(r <= most, score * F.pow(F.exp(-0.5 * r * r), F.lit(power))).otherwise(0.0)
    return reciprocal(pairs.select("a", "b", score.alias("score")).where("score > 0"), [])


def weighted_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, jaccard) of every two sparse sets (node, gid, w) that share an id."""
    ta, tb = (d.groupBy("node").agg(F.sum("w").alias("t")) for d in (a, b))
    x, y = a.select(F.col("node").alias("a"), "gid", F.col("w").alias("wa")), b.select(F.col("node").alias("b"), "gid", F.col("w").alias("wb"))
    low = x.join(y, "gid").groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("low"))
    rows = low.join(ta.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(tb.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    return rows.select("a", "b", (F.col("low") / F.greatest(F.col("ta") + F.col("tb") - F.col("low"), F.lit(1e-8))).alias("jaccard"))


def rofa_filter(rows: DataFrame, track: str, node: str, vec: str, tau: float) -> DataFrame:
    """Rows of a track whose mean similarity with the others is at least the track's mean
    less ``tau`` population deviations; lone rows stay, and the best of a track always
    does. The mean of the others comes from the track's vector sum."""
    total = vector_sum(rows, [track], vec).select(track, F.col("s").alias("__s"), F.col("total_w").alias("__n"))
    loo = F.when(F.col("__n") > 1, (dot(vec, "__s") - dot(vec, vec)) / (F.col("__n") - 1)).otherwise(1.0)
    scored = stored(rows.join(total, track).withColumn("loo", loo).drop("__s"), "rofa")
    best = F.min(F.struct((-F.col("loo")).alias("l"), F.col(node).alias("n")))
    scored = with_totals(scored, track, __mean=F.avg("loo"), __dev=F.stddev_pop("loo"), __best=best)
    keep = (F.col("__n") == 1) | (F.col("loo") >= F.col("__mean") - tau * F.col("__dev") - 1e-12) | ((F.col(node) == F.col("__best.n")) & (-F.col("loo") == F.col("__best.l")))
    return scored.withColumn("keep", keep).drop("__n", "__mean", "__dev", "__best")


def track_statistics(nodes: DataFrame, track: str = "track", view: str = "view_id", weight: str = "w") -> DataFrame:
    """(track, support, views, eff_views, reliability) with (sum w)^2 / sum w^2 views."""
    per = nodes.groupBy(track, view).agg(F.sum(weight).alias("v"))
    out = per.groupBy(track).agg(F.sum("v").alias("support"), F.count("*").alias("views"), (F.pow(F.sum("v"), F.lit(2)) / F.greatest(F.sum(F.col("v") * F.col("v")), F.lit(1e-8))).alias("eff_views"))
    return out.withColumn("view_share", F.col("eff_views") / (F.col("eff_views") + 1))


def last_node_links(dominant: DataFrame, gid: str = "gid", view: str = "view_id", node: str = "node") -> DataFrame:
    """(a, b, n): each point's segment node with the one it had in the view before, and
    how many points say so."""
    before = F.lag(node).over(Window.partitionBy(gid).orderBy(view))
    return dominant.withColumn("a", before).where(F.col("a").isNotNull()).groupBy("a", F.col(node).alias("b")).agg(F.count("*").alias("n"))


def geometry_semantic_union(rows: DataFrame, key: list[str], most: int, fraction: float, weight: str, semantic: str, gid: str = "gid") -> DataFrame:
    """Of a row's ``most`` heaviest candidates the best share by weight or by meaning; an
    unknown meaning (null) never wins; ``rescued`` marks what meaning alone kept."""
    w = Window.partitionBy(*key)
    pool = rows.withColumn("rw", F.row_number().over(w.orderBy(F.col(weight).desc(), gid))).where(F.col("rw") <= most)
    n = F.count("*").over(w)
    keep = F.greatest(F.lit(1), F.ceil(fraction * n))
    rs = F.row_number().over(w.orderBy(F.col(semantic).desc_nulls_last(), gid))
    out = pool.withColumn("keep", keep).withColumn("rs", rs)
    by_meaning = (F.col("rs") <= F.col("keep")) & F.col(semantic).isNotNull()
    return out.where((F.col("rw") <= F.col("keep")) | by_meaning).withColumn("rescued", F.col("rw") > F.col("keep")).drop("keep", "rs", "rw")


def windowed_links(signatures: DataFrame, vectors: DataFrame, window: int, least_overlap: float, least_cos: float) -> DataFrame:
    """(a, b, score): nodes of a view matched with those of the ``window`` views before it, all
    together: reciprocal best pairs of one view's nodes and the pooled earlier ones, by
    overlap times similarity. signatures: (view, node, gid, w); vectors: (node, vec). Only
    nodes that share a point meet; ties go to the lower node."""
    x = signatures.select(F.col("view").alias("va"), F.col("node").alias("a"), "gid", F.col("w").alias("wa"))
    y = signatures.select(F.col("view").alias("vb"), F.col("node").alias("b"), "gid", F.col("w").alias("wb"))
    near = (F.col("vb") < F.col("va")) & (F.col("vb") >= F.col("va") - window)
    over = x.join(y, "gid").where(near).groupBy("va", "a", "b").agg(exact_sum(F.col("wa") * F.col("wb")).alias("overlap")).where(F.col("overlap") >= least_overlap)
    pairs = over.join(vectors.select(F.col("node").alias("a"), F.col("vec").alias("xa")), "a").join(vectors.select(F.col("node").alias("b"), F.col("vec").alias("xb")), "b")
    cos = dot("xa", "xb")
    scored = pairs.select("va", "a", "b", cos.alias("cos"), "overlap").where(F.col("cos") >= least_cos)
    scored = scored.withColumn("score", F.col("overlap") * clip((F.col("cos") - least_cos) / max(1e-8, 1 - least_cos), 0.0, 1.0)).where("score > 0")
    return reciprocal(scored, ["va"])


def with_totals(rows: DataFrame, key: str, **sums: Column) -> DataFrame:
    """Adds aggregates over each key by a join, which, unlike a window, brings no key's rows
    together in one task. ``rows`` is read twice."""
    return rows.join(rows.groupBy(key).agg(*(c.alias(n) for n, c in sums.items())), key)


def with_share(rows: DataFrame, key: str, column: Column, name: str) -> DataFrame:
    """Adds a column as a share of its sum over the key; even shares if that is 0."""
    out = with_totals(rows.withColumn("__x", column), key, __t=F.sum("__x"), __n=F.count("*"))
    return out.withColumn(name, F.when(F.col("__t") > 0, F.col("__x") / F.col("__t")).otherwise(1.0 / F.col("__n"))).drop("__x", "__t", "__n")


def node_importance(nodes: DataFrame, mode: str = "information_kl", heat: float = 1.0, most_kl: float = 0.1, ratio: float = 5.0, agree_power: float = 1.0, information: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(track, node, importance) and the columns of ``carry``: shares of a track's nodes that
    sum to 1. Rows are never joined by node, whose ids may repeat.

    nodes: (track, node, vec of unit length, support). ``uniform``, ``support``, or
    ``information_kl``: support shares tilted by how much information a node adds (the mean
    log ratio over positions of the track's summed support x vec^2 with and without it, over
    the track's largest) and by agreement with the track's direction; the tilt stays within
    ``most_kl`` of the support shares, and no share grows by more than ``ratio``. All sums
    are aggregates over the nodes, so a large track is no single task."""
    if mode not in ("uniform", "support", "information_kl"):
        raise ValueError(f"no such weighting: {mode}")
    own = F.lit(1.0) if mode == "uniform" else F.greatest("support", F.lit(0.0))
    rows = with_share(nodes, "track", own, "base")
    if mode != "information_kl":
        return rows.select("track", "node", *carry, F.col("base").alias("importance"))
    rows = stored(rows, "importance-base")
    square = F.transform("vec", lambda x: x.cast("double") * x.cast("double"))
    centre = vector_sum(rows, ["track"], "vec", "base").select("track", l2_normalize("s").alias("centre"))
    known = vector_sum(rows.withColumn("square", square), ["track"], "square", "support").select("track", F.transform("s", lambda x: x + 1e-4).alias("known"))
    rows = rows.join(centre, "track").join(known, "track")
    terms = F.zip_with("known", square, lambda k, s: F.struct(k.alias("k"), s.alias("s")))
    logs = once(F.struct(terms.alias("t"), F.col("support").alias("u")), lambda p: F.transform(p["t"], lambda e: F.log(e["k"] / F.greatest(e["k"] - p["u"] * e["s"], F.lit(1e-4)))))
    agree = F.pow(clip(dot("vec", "centre"), 0.0, 1.0), F.lit(agree_power))
    gain = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size("vec")
    rows = stored(rows.select("track", "node", *carry, "base", gain.alias("gain"), F.log(F.greatest(agree, F.lit(1e-4))).alias("agree")), "importance-gain")
    rows = with_totals(rows, "track", most=F.max("gain"))
    rows = rows.withColumn("logit", clip((information * F.col("gain") / F.greatest("most", F.lit(1e-8)) + F.col("agree")) / heat, -30.0, 30.0))
    rows = with_totals(stored(rows.select("track", "node", *carry, "base", "logit"), "importance-logit"), "track", top=F.max("logit"))
    rows = with_share(rows, "track", F.col("base") * F.exp(F.col("logit") - F.col("top")), "target")
    rows = stored(within_kl(stored(rows.select("track", "node", *carry, "base", "target"), "importance-target"), "track", "base", "target", most_kl), "importance-mixed")
    held = F.col("base") * F.least(F.col("mixed") / F.greatest("base", F.lit(1e-20)), F.lit(ratio))
    return with_share(rows, "track", held, "importance").select("track", "node", *carry, "importance")


def within_kl(rows: DataFrame, key: str, base: str, target: str, limit: float, steps: int = 4) -> DataFrame:
    """Adds ``mixed``: base + t (target - base) with the largest t on a grid of 256^steps for
    which KL(mixed, base) stays within the limit, for each key; the target if that is within.
    Each round sums 255 candidates a key over all rows (what 8 bisections would do)."""
    count = 255
    b, t = F.col(base), F.col(target)

    def terms(low: Column, span: float, points: Column) -> Column:
        return F.transform(points, lambda i: once(b + (low + i * span) * (t - b), lambda m: F.when((m > 0) & (b > 0), m * F.log(m / b)).otherwise(F.lit(0.0))))

    low = vector_sum(rows.select(key, terms(F.lit(0.0), 1.0, F.array(F.lit(1.0))).alias("v")), [key], "v").select(key, F.when(F.col("s")[0] <= limit, F.lit(1.0)).otherwise(0.0).alias("t"))
    low = stored(low, "kl-low")
    span = 1.0
    for _ in range(steps):
        span /= count + 1
        grid = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: i.cast("double"))
        sums = vector_sum(rows.join(low.where("t < 1"), key).select(key, terms(F.col("t"), span, grid).alias("v")), [key], "v")
        fits = sums.select(key, F.size(F.filter("s", lambda x: x <= limit)).alias("k"))
        low = stored(low.join(fits, key, "left").select(key, (F.col("t") + F.coalesce("k", F.lit(0)) * span).alias("t")), "kl-low")
    return rows.join(low, key).withColumn("mixed", b + F.col("t") * (t - b)).drop("t")


def build_tracks(nodes: DataFrame, links: DataFrame, tau: float = 1.0, mode: str = "support", least_support: float = 0.0, least_views: int = 1, **importance) -> tuple[DataFrame, DataFrame]:
    """(tracks (track, root, feature, support, views, eff_views, concentration, reliability),
    node_tracks (node, track or null)).

    nodes: (node, view, vec of unit length, support); links: (a, b). Linked nodes are one
    track; nodes unlike the others of theirs lose their support and their place; a track
    needs support and views. Tracks are numbered in order of their lowest node."""
    label = components(links).select("node", F.col("label").alias("root"))
    rows = stored(nodes.join(label, "node", "left").withColumn("track", F.coalesce("root", "node")).drop("root"), "track-nodes")
    kept = stored(rofa_filter(rows, "track", "node", "vec", tau).drop("loo"), "track-kept")
    kept = kept.withColumn("support", F.when(F.col("keep"), F.col("support")).otherwise(0.0))
    weighed = stored(node_importance(kept, mode, **importance, carry=("view", "vec", "support")), "track-importance")
    feature = vector_sum(weighed, ["track"], "vec", "importance").select("track", l2_normalize("s").alias("feature"))
    per_view = weighed.where("importance > 0").groupBy("track", "view").agg(F.sum("importance").alias("v")).groupBy("track").agg(F.count("*").alias("views"), (F.pow(F.sum("v"), F.lit(2)) / F.greatest(F.sum(F.col("v") * F.col("v")), F.lit(1e-12))).alias("eff_views"))
    near = weighed.join(feature, "track").groupBy("track").agg(F.sum("support").alias("support"), (F.sum(F.col("importance") * dot("vec", "feature")) / F.greatest(F.sum("importance"), F.lit(1e-12))).alias("concentration"))
    out = near.join(per_view, "track").join(feature, "track").where((F.col("support") >= least_support) & (F.col("views") >= least_views))
    out = out.withColumn("reliability", clip("concentration", 0.0, 1.0) * F.col("eff_views") / (F.col("eff_views") + 1))
    tracks = numbered(out.withColumnRenamed("track", "root"), [F.col("root")], "track")
    mapped = kept.select("node", "keep", F.col("track").alias("root")).join(tracks.select("root", "track"), "root", "left")
    return tracks, mapped.select("node", F.when(F.col("keep"), F.col("track")).alias("track"))


def aggregate_point_tracks(observed: DataFrame, most: int) -> DataFrame:
    """(gid, slot, track, score): summed scores of (gid, track, score), the ``most`` best of a
    point, scores as shares of those kept."""
    sums = observed.groupBy("gid", "track").agg(F.sum("score").alias("score"))
    top = pack_memberships(sums, most, 0.0)
    return top.withColumn("score", F.col("score") / F.greatest(F.sum("score").over(Window.partitionBy("gid")), F.lit(1e-8)))


def best_view_tracks(dominant: DataFrame) -> DataFrame:
    """(gid, track, support): the track of a point's view of most support, the earliest of
    equals; from (view, gid, track, support), tracks null where the segment has none."""
    rows = dominant.where(F.col("track").isNotNull() & (F.col("support") > 0))
    return first_rows(rows, ["gid"], [F.col("support").desc(), F.col("view")]).select("gid", "track", "support")


def _unit(s: dict[int, float], keep: int) -> dict[int, float]:
    top = sorted(s.items(), key=lambda e: (-e[1], e[0]))[:keep]
    length = max(float(np.sqrt(sum(w * w for _, w in top))), 1e-8)
    return {i: w / length for i, w in top}


def trace_memory(nodes: DataFrame, scene: str, least_overlap: float, least_cos: float, keep: int) -> DataFrame:
    """(scene, node, track): nodes (scene, view, node, ids, ws, vec, mass) matched, view after
    view, with a memory of every track so far: reciprocal best pairs by signature overlap
    times similarity above ``least_cos`` join. A joined track's signature becomes its mean
    over the nodes, cut to ``keep`` ids, of unit length; its vector is the mass-weighted sum.
    Each view depends on all before it, so a scene is one task; an inverted index keeps a
    view's work to the tracks that share an id with it."""
    kind = nodes.schema[scene].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        memory: list[dict[int, float]] = []
        sums: list[np.ndarray] = []
        counts: list[int] = []
        index: dict[int, set[int]] = {}
        out = []

        def put(m: int, s: dict[int, float]) -> None:
            memory[m] = s
            for i in s:
                index.setdefault(i, set()).add(m)

        for _, now in pdf.sort_values(["view", "node"]).groupby("view", sort=True):
            sigs = [_unit(dict(zip(map(int, i), map(float, w), strict=True)), len(i)) for i, w in zip(now["ids"], now["ws"], strict=True)]
            vecs = np.array(now["vec"].tolist(), float)
            vecs /= np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-8)
            best_of: dict[int, tuple[float, int]] = {}
            best_for: dict[int, tuple[float, int]] = {}
            for a, s in enumerate(sigs):
                over: dict[int, float] = {}
                for i, v in s.items():
                    for m in index.get(i, ()):
                        if i in memory[m]:
                            over[m] = over.get(m, 0.0) + v * memory[m][i]
                for m in sorted(over):
                    cos = float(vecs[a] @ sums[m]) / max(float(np.linalg.norm(sums[m])), 1e-8)
                    if over[m] < least_overlap or cos < least_cos:
                        continue
                    score = over[m] * min(max((cos - least_cos) / max(1e-8, 1 - least_cos), 0.0), 1.0)
                    if score > best_of.get(a, (0.0, -1))[0]:
                        best_of[a] = score, m
                    if score > best_for.get(m, (0.0, -1))[0]:
                        best_for[m] = score, a
            for a, (node, mass) in enumerate(zip(now["node"], now["mass"], strict=True)):
                m = best_of.get(a, (0.0, -1))[1]
                if m >= 0 and best_for[m][1] == a:
                    merged = {i: w * counts[m] for i, w in memory[m].items()}
                    for i, w in sigs[a].items():
                        merged[i] = merged.get(i, 0.0) + w
                    put(m, _unit(merged, keep))
                    sums[m] = sums[m] + vecs[a] * max(float(mass), 1e-6)
                    counts[m] += 1
                else:
                    m = len(memory)
                    memory.append({})
                    put(m, _unit(sigs[a], keep))
                    sums.append(vecs[a] * max(float(mass), 1e-6))
                    counts.append(1)
                out.append((node, m))
        return pd.DataFrame({scene: pdf[scene].iloc[0], "node": [n for n, _ in out], "track": [t for _, t in out]})

    return nodes.groupBy(scene).applyInPandas(run, f"`{scene}` {kind}, node bigint, track bigint")


def _sparse(s: dict[int, float], keep: int) -> dict[int, float]:
    """The ``keep`` heaviest entries as shares of their sum."""
    top = sorted(s.items(), key=lambda e: (-e[1], e[0]))[: keep or len(s)]
    total = sum(w for _, w in top)
    return {i: w / total if total > 1e-9 else w for i, w in top}


def lift_groups(masks: DataFrame, scene: str, least_iou: float, least_cos: float, iou_share: float, merge: float, keep: int = 0, seeds: int = 64, indexed: int = 64) -> DataFrame:
    """(scene, mask, group_id, count, mass, size, feature, ids, ws): masks (scene, place, mask,
    ids, ws, vec, mass) in order of place, each merged into the group of highest score.

    Groups are found by the mask's ``seeds`` heaviest points in an inverted index of each
    group's ``indexed`` heaviest; the score is iou_share x weighted Jaccard + the rest x
    cosine, both at least their bounds, and has to reach ``merge``. A merged group adds
    weights by mass, keeps its ``keep`` heaviest points (0: all), and its feature is the
    mass-weighted direction. The result depends on the order, so a scene is one task, which
    reads its masks as a sorted stream and holds the groups in flat arrays. Group columns are
    the group's final state, repeated for each of its masks."""
    kind = masks.schema[scene].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return lifted(batches, scene, least_iou, least_cos, iou_share, merge, keep, seeds, indexed)

    rows = masks.select(scene, "place", "mask", "ids", "ws", "vec", "mass").repartition(scene).sortWithinPartitions(scene, "place", "mask")
    return rows.mapInArrow(run, f"`{scene}` {kind}, mask bigint, group_id bigint, count bigint, mass double, size bigint, feature array<double>, ids array<bigint>, ws array<double>")


class _Groups:
    """Groups of a scene in order of their making: members by falling weight, in flat arrays."""

    def __init__(self) -> None:
        self.ids: list[array] = []
        self.ws: list[array] = []
        self.mass, self.count = array("d"), array("q")
        self.sums: list[np.ndarray] = []  # blocks of ROWS rows
        self.index: dict[int, array] = {}
        self.masks, self.of = array("q"), array("q")

    def sum(self, g: int) -> np.ndarray:
        return self.sums[g // ROWS][g % ROWS]

    def feature(self, g: int) -> np.ndarray:
        total = self.sum(g)
        length = float(np.linalg.norm(total))
        return total / length if length >= 1e-9 else total

    def members(self, g: int) -> dict[int, float]:
        return dict(zip(self.ids[g], self.ws[g], strict=True))

    def put(self, g: int, s: dict[int, float], indexed: int) -> None:
        self.ids[g], self.ws[g] = array("q", s.keys()), array("d", s.values())
        for i in _heaviest(s, indexed):
            at = self.index.setdefault(i, array("q"))
            if g not in at:
                at.append(g)

    def make(self, v: np.ndarray, mass: float) -> int:
        g = len(self.ids)
        if g % ROWS == 0:
            self.sums.append(np.zeros((ROWS, len(v))))
        self.sums[-1][g % ROWS] = v * mass
        self.ids.append(array("q"))
        self.ws.append(array("d"))
        self.mass.append(mass)
        self.count.append(1)
        return g

    def batches(self, scene: str, value: pa.Array) -> Iterator[pa.RecordBatch]:
        def lists(x: list, kind: pa.DataType) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum([len(e) for e in x])])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.asarray(e) for e in x]), kind))

        for start in range(0, len(self.of), ROWS):
            of = self.of[start : start + ROWS]
            whole = [sorted(zip(self.ids[g], self.ws[g], strict=True)) for g in of]
            columns = [
                pa.array(self.masks[start : start + ROWS], pa.int64()), pa.array(of, pa.int64()), pa.array([self.count[g] for g in of], pa.int64()), pa.array([self.mass[g] for g in of]),
                pa.array([len(w) for w in whole], pa.int64()), lists([self.feature(g) for g in of], pa.float64()), lists([[i for i, _ in w] for w in whole], pa.int64()), lists([[x for _, x in w] for w in whole], pa.float64()),
            ]
            names = [scene, "mask", "group_id", "count", "mass", "size", "feature", "ids", "ws"]
            yield pa.RecordBatch.from_arrays([value.take(pa.array([0] * len(of))), *columns], names=names)


def _heaviest(s: dict[int, float], n: int) -> list[int]:
    return [i for i, _ in sorted(s.items(), key=lambda e: (-e[1], e[0]))[:n]]


def lifted(batches: Iterator[pa.RecordBatch], scene: str, least_iou: float, least_cos: float, iou_share: float, merge: float, keep: int, seeds: int, indexed: int) -> Iterator[pa.RecordBatch]:
    """What :func:`lift_groups` gives for masks (scene, place, mask, ids, ws, vec, mass) that come
    in order, scene after scene."""
    groups, value, now = _Groups(), None, None
    for batch in batches:
        for n in range(batch.num_rows):
            at, _, mask, ids, ws, vec, mass = (batch.column(c)[n].as_py() for c in range(7))
            if value is None or at != now:
                if value is not None:
                    yield from groups.batches(scene, value)
                groups, value, now = _Groups(), pa.array([at], batch.column(0).type), at
            s = _sparse(dict(zip(ids, map(float, ws), strict=True)), keep)
            v, mass = np.array(vec, float), float(mass)
            found, best = -1, -1.0
            for g in sorted({g for i in _heaviest(s, seeds) for g in groups.index.get(i, ())}):
                own = groups.members(g)
                low = sum(min(w, own[i]) for i, w in s.items() if i in own)
                union = sum(s.values()) + sum(own.values()) - low
                iou = low / union if low and union > 1e-9 else 0.0
                if iou < least_iou:
                    continue
                cos = float(v @ groups.feature(g))
                if cos < least_cos:
                    continue
                score = iou_share * iou + (1 - iou_share) * cos
                if score > best:
                    found, best = g, score
            if found >= 0 and best >= merge:
                merged = {i: w * groups.mass[found] for i, w in groups.members(found).items()}
                for i, w in s.items():
                    merged[i] = merged.get(i, 0.0) + w * mass
                s = _sparse(merged, keep)
                groups.mass[found] += mass
                groups.count[found] += 1
                groups.sums[found // ROWS][found % ROWS] += v * mass
            else:
                found = groups.make(v, mass)
            groups.put(found, s, indexed)
            groups.masks.append(mask)
            groups.of.append(found)
    if value is not None:
        yield from groups.batches(scene, value)


def assign_groups(groups: DataFrame, members: DataFrame, mode: str = "hard", least_count: int = 1, power: float = 1.0, least_score: float = 0.0, least_margin: float = 0.0) -> DataFrame:
    """(gid, group_id, best, second, feature): points' groups by weight x root of the group's
    count; the lower group of equals. groups: (group_id, feature, count), members: (group_id,
    gid, w). ``hard`` takes the best group's feature, ``soft`` the mean of all by score^power;
    points under the least score or lead are left out."""
    usable = groups.where(F.col("count") >= least_count)
    rows = members.join(usable, "group_id").withColumn("score", F.col("w") * F.sqrt(F.col("count").cast("double"))).where("score > 0")
    r = F.row_number().over(Window.partitionBy("gid").orderBy(F.col("score").desc(), "group_id"))
    ranked = rows.withColumn("r", r)
    top = ranked.where("r <= 2").groupBy("gid").agg(F.max(F.when(F.col("r") == 1, F.col("group_id"))).alias("group_id"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    top = top.where((F.col("best") >= least_score) & (F.col("best") - F.col("second") >= least_margin))
    if mode == "hard":
        return top.join(usable.select("group_id", "feature"), "group_id").select("gid", "group_id", "best", "second", "feature")
    if mode != "soft":
        raise ValueError(f"no such assignment: {mode}")
    mean = vector_sum(rows.withColumn("__w", F.pow("score", F.lit(power))), ["gid"], "feature", "__w").select("gid", l2_normalize("s", 1e-9).alias("feature"))
    return top.join(mean, "gid").select("gid", "group_id", "best", "second", "feature")


def semantic_scores(candidates: DataFrame, point_codes: DataFrame, codes: DataFrame, segments: DataFrame, levels: int) -> DataFrame:
    """(gid, seg_id, score): cosine of what a point's codes stand for with a segment's vector,
    for candidate pairs (gid, seg_id); minus infinity for points that lack a level."""
    whole = point_codes.groupBy("gid").agg(F.count_distinct("level").alias("n")).where(F.col("n") == levels).select("gid")
    points = reconstruct(point_codes.join(whole, "gid", "left_semi"), codes, ["gid"], ["level", "code_id"])
    rows = candidates.join(points, "gid", "left").join(segments.select("seg_id", "vec"), "seg_id")
    return rows.select("gid", "seg_id", F.when(F.col("feature").isNull(), F.lit(float("-inf"))).otherwise(cosine("feature", "vec")).alias("score"))


def box_nms(boxes: DataFrame, image: str, limit: float) -> DataFrame:
    """Greedy suppression of boxes (image, box, x0, y0, x1, y1, score): by falling score, a
    box stays unless it overlaps one that stayed by more than ``limit``. One image a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box"], ascending=[False, True])
        b = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        kept: list[int] = []
        for i in range(len(b)):
            k = np.array(kept, int)
            w = np.clip(np.minimum(b[i, 2], b[k, 2]) - np.maximum(b[i, 0], b[k, 0]), 0, None)
            h = np.clip(np.minimum(b[i, 3], b[k, 3]) - np.maximum(b[i, 1], b[k, 1]), 0, None)
            if not len(k) or (w * h / np.maximum(area[i] + area[k] - w * h, 1e-12)).max() <= limit:
                kept.append(i)
        return pdf.iloc[kept]

    return boxes.groupBy(image).applyInPandas(run, boxes.schema)


def mask_nms(pixels: DataFrame, scores: DataFrame, image: list[str], iou: float, inside: float, least: float) -> DataFrame:
    """(image, mask, score): matrix suppression of masks given as pixels: a mask goes if an
    earlier one (higher score) overlaps it over ``iou``, holds over ``inside`` of it, or its
    score is at most ``least``. Not greedy: every earlier mask counts, kept or not."""
    area = pixels.groupBy(*image, "mask").agg(F.count("*").alias("area"))
    s = scores.join(area, [*image, "mask"])
    x, y = (pixels.select(*image, "px", "py", F.col("mask").alias(c)) for c in ("a", "b"))
    both = x.join(y, [*image, "px", "py"]).where("a <> b").groupBy(*image, "a", "b").agg(F.count("*").alias("n"))
    sa, sb = (s.select(*image, F.col("mask").alias(c), F.col("score").alias(f"s{c}"), F.col("area").alias(f"area_{c}")) for c in ("a", "b"))
    rows = both.join(sa, [*image, "a"]).join(sb, [*image, "b"]).where((F.col("sa") > F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b"))))
    bad = rows.where((F.col("n") / (F.col("area_a") + F.col("area_b") - F.col("n")) > iou) | (F.col("n") / F.col("area_b") > inside)).select(*image, F.col("b").alias("mask")).distinct()
    return s.where(F.col("score") > least).join(bad, [*image, "mask"], "left_anti").select(*image, "mask", "score")


def associations(contribs: DataFrame, semantic: DataFrame, most: int, fraction: float) -> DataFrame:
    """(view_id, seg_id, gid, weight, rescued): what each segment of each view keeps of its points
    by mass and by meaning (gid, seg_id, score; minus infinity is unknown)."""
    mass = contribs.groupBy("view_id", "seg_id", "gid").agg(F.sum("weight").alias("weight"))
    rows = mass.join(semantic, ["gid", "seg_id"], "left").withColumn("score", F.when(F.col("score") != float("-inf"), F.col("score")))
    return geometry_semantic_union(rows, ["view_id", "seg_id"], most, fraction, "weight", "score").drop("score")


def cached_associations(spark: SparkSession, path: str, build) -> DataFrame:
    """Associations kept by view: those at ``path`` if they are there, else ``build()``, which is
    written first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        build().write.mode("overwrite").partitionBy("view_id").parquet(path)
    return spark.read.parquet(path)


def foreground(contribs: DataFrame, segment_track: DataFrame) -> DataFrame:
    """(gid, track, fg): mass of a point in the segments of a track; of selected pixels, if the
    contributions are those of some pixels only."""
    mass = contribs.groupBy("view_id", "seg_id", "gid").agg(F.sum("weight").alias("m"))
    return mass.join(segment_track, ["view_id", "seg_id"]).groupBy("gid", "track").agg(F.sum("m").alias("fg"))


def pack_foreground(rows: DataFrame, most: int, threshold: float, least_fg: float, excluded: DataFrame | None = None) -> DataFrame:
    """:func:`pack_memberships` of (gid, track, score, fg) with at least ``least_fg`` foreground,
    without excluded tracks."""
    rows = rows.where(F.col("fg") >= least_fg)
    if excluded is not None:
        rows = rows.join(excluded.select("track").distinct(), "track", "left_anti")
    return pack_memberships(rows, most, threshold)
