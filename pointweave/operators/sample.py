"""Shards, folds and seeded samples; order comes from hashes, so runs repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.vec import clip
from pointweave.operators.order import first_n, numbered
from pointweave.plans.storage import stored


def shard(df: DataFrame, index: str, n: int, which: int) -> DataFrame:
    return df.where(F.pmod(F.col(index), F.lit(n)) == which)


def missing_only(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def stratified(df: DataFrame, group: str, key: str, quota: int, total: int, seed: int = 0) -> DataFrame:
    """An equal quota a group, refilled from the rest up to ``total`` rows."""
    order = F.xxhash64(F.lit(seed), key)
    rows = df.withColumn("__h", order).withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__h", key)))
    return first_n(rows, total, [(F.col("__r") > quota).cast("int"), F.col("__h"), F.col(key)]).drop("__h", "__r")


def balanced(df: DataFrame, source: str, key: str, per_source: int, seed: int = 0) -> DataFrame:
    """At most ``per_source`` rows of each source, by seeded hash."""
    r = F.row_number().over(Window.partitionBy(source).orderBy(F.xxhash64(F.lit(seed), key), key))
    return df.withColumn("__r", r).where(F.col("__r") <= per_source).drop("__r")


def every_nth(df: DataFrame, name: str, n: int = 8) -> DataFrame:
    """Adds ``test``: whether the row is every n-th by name."""
    return numbered(df, [F.col(name)], "__place").withColumn("test", F.col("__place") % n == 0).drop("__place")


def view_importance(rows: DataFrame, limit_ratio: float, heat: float, ema: float) -> DataFrame:
    """(group_id, view_id, p): each group's support over views, tilted by score, each share
    changed by at most ``limit_ratio``, after blending the score with its last value."""
    w = Window.partitionBy("group_id")
    score = ema * F.col("last") + (1 - ema) * F.col("score")
    base = F.col("support") / F.sum("support").over(w)
    tilt = base * F.exp(heat * score)
    rows = rows.withColumn("base", base).withColumn("tilt", tilt)
    p = F.col("tilt") / F.sum("tilt").over(w)
    rows = rows.withColumn("p", F.col("base") * clip(p / F.col("base"), 1 / limit_ratio, limit_ratio))
    return rows.select("group_id", "view_id", (F.col("p") / F.sum("p").over(w)).alias("p"))


def draw_views(p: DataFrame, draws: DataFrame) -> DataFrame:
    """(draw, group_id, view_id): inverse-CDF draws, u in [0, 1) given with each draw."""
    w = Window.partitionBy("group_id").orderBy("view_id").rowsBetween(Window.unboundedPreceding, 0)
    cdf = p.withColumn("hi", F.sum("p").over(w)).withColumn("lo", F.col("hi") - F.col("p"))
    return draws.join(cdf, "group_id").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "group_id", "view_id")


def view_distributions(rows: DataFrame, heat: float = 1.0, even: float = 0.25, base_kl: float = 0.5, step_kl: float = 0.02) -> DataFrame:
    """(group_id, view_id, base, p): sampling shares of a group's views. rows: (group_id,
    view_id, share, score, last or null): a pixel share, its priority and the share that
    was drawn from so far. Scores are standardised under the base, tilt it through an
    exponent held in [-12, 12], are mixed with ``even`` of it, and move at most ``base_kl``
    from the base and ``step_kl`` from the last."""
    from pointweave.operators.track import with_share, with_totals, within_kl

    key = "group_id"
    rows = stored(with_share(rows.where("share > 0"), key, F.col("share"), "base"), "view-base")
    rows = stored(with_totals(rows, key, m=F.sum(F.col("base") * F.col("score"))), "view-mean")
    rows = stored(with_totals(rows, key, v=F.sum(F.col("base") * (F.col("score") - F.col("m")) * (F.col("score") - F.col("m")))), "view-spread")
    tilt = F.col("base") * F.exp(clip(heat * (F.col("score") - F.col("m")) / F.greatest(F.sqrt("v"), F.lit(1e-6)), -12.0, 12.0))
    rows = with_share(rows, key, tilt, "tilted").withColumn("wanted", (1 - even) * F.col("tilted") + even * F.col("base")).withColumn("old", F.coalesce("last", "base"))
    rows = stored(rows.select("group_id", "view_id", "base", "old", "wanted"), "view-shares")
    rows = stored(within_kl(rows, "group_id", "base", "wanted", base_kl).drop("wanted").withColumnRenamed("mixed", "wanted"), "view-shares")
    return within_kl(rows, "group_id", "old", "wanted", step_kl).select("group_id", "view_id", "base", F.col("mixed").alias("p"))


def observe_priority(scores: DataFrame, seen: DataFrame, decay: float) -> DataFrame:
    """(group_id, view_id, score) after priorities (group_id, view_id, priority) were seen."""
    rows = scores.join(seen, ["group_id", "view_id"], "left")
    return rows.select("group_id", "view_id", F.when(F.col("priority").isNull(), F.col("score")).otherwise(decay * F.col("score") + (1 - decay) * F.col("priority")).alias("score"))
