"""What point sets go through while they are fitted, short of gradients."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.geometry import rgb_to_sh, rotation
from pointweave.operators.spatial import mean_nearest


def initialise(points: DataFrame, side: float, gid: str = "gid") -> DataFrame:
    """(gid, xyz, features_dc, scaling, rotation, opacity) of a cloud (gid, xyz, rgb in [0, 1]):
    log scales from the root mean squared distance to the three nearest, no rotation,
    opacity 0.1 before its activation. A lone point has the least scale."""
    near = mean_nearest(points.withColumn("pos", F.col("xyz")), 3, side, gid=gid)
    rows = points.join(near, gid, "left")
    size = F.log(F.sqrt(F.greatest(F.coalesce("mean_d2", F.lit(0.0)), F.lit(1e-7))))
    return rows.select(gid, "xyz", F.transform("rgb", lambda x: rgb_to_sh(x)).alias("features_dc"), F.array_repeat(size, 3).alias("scaling"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))).alias("rotation"), F.lit(math.log(0.1 / 0.9)).alias("opacity"))


def densify(points: DataFrame, least_gradient: float, dense: float, extent: float, copies: int = 2, seed: int = 0, gid: str = "gid") -> DataFrame:
    """Points with the columns of ``points`` and ``copy``: 0 for what was there, 1.. for what is
    new. (gid, xyz, scaling log, rotation, gradient sum, seen.) Points of a mean gradient over
    the bound are cloned where their largest scale is at most ``dense`` x ``extent``; larger
    ones give way to ``copies`` points drawn from their Gaussian, with scales over 0.8 x copies."""
    mean = F.when(F.col("seen") > 0, F.col("gradient") / F.col("seen")).otherwise(0.0)
    large = F.exp(F.array_max("scaling")) > dense * extent
    rows = points.withColumn("__grow", mean >= least_gradient).withColumn("__large", large)
    own = rows.where(~(F.col("__grow") & F.col("__large"))).withColumn("copy", F.lit(0))
    clones = rows.where(F.col("__grow") & ~F.col("__large")).withColumn("copy", F.lit(1))
    split = rows.where(F.col("__grow") & F.col("__large")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    split = split.withColumn("__d", F.array(*[F.randn(seed + i) * F.exp(F.col("scaling")[i]) for i in range(3)]))
    r = rotation(F.col("rotation"))
    moved = F.array(*[F.col("xyz")[i] + sum((r[3 * i + j] * F.col("__d")[j] for j in range(3)), F.lit(0.0)) for i in range(3)])
    split = split.withColumn("xyz", moved).withColumn("scaling", F.transform("scaling", lambda x: x - math.log(0.8 * copies))).drop("__d")
    return own.unionByName(clones).unionByName(split).drop("__grow", "__large")


def prune(points: DataFrame, least_opacity: float, extent: float, most_radius: float | None = None) -> DataFrame:
    """Points whose activated opacity is at least the bound; with a screen bound, neither wider
    on screen nor larger than a tenth of the extent."""
    keep = 1 / (1 + F.exp(-F.col("opacity"))) >= least_opacity
    if most_radius:
        keep &= (F.col("max_radius") <= most_radius) & (F.exp(F.array_max("scaling")) <= 0.1 * extent)
    return points.where(keep)


def reset_opacity(points: DataFrame, most: float = 0.01) -> DataFrame:
    """Opacities of at most ``most`` after activation."""
    return points.withColumn("opacity", F.least("opacity", F.lit(math.log(most / (1 - most)))))


def gradient_statistics(points: DataFrame, seen: DataFrame, gid: str = "gid") -> DataFrame:
    """Adds the norm of (gid, gx, gy) of this step to the sums of the points that it names."""
    step = seen.groupBy(gid).agg(F.sum(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("__g"), F.count("*").alias("__n"))
    rows = points.join(step, gid, "left")
    return rows.withColumn("gradient", F.col("gradient") + F.coalesce("__g", F.lit(0.0))).withColumn("seen", F.col("seen") + F.coalesce("__n", F.lit(0))).drop("__g", "__n")
