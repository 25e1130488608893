"""From splats to pixels: expansion, visibility, contributions and their re-weighting.

Contributions are rows (view, pixel, gid, weight, ...), never padded arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.vec import clip, kl_trust_region


def tile_expand(splats: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """One row per splat and tile of its rectangle (ends exclusive); empty ones vanish."""
    some = splats.where((F.col(x1) > F.col(x0)) & (F.col(y1) > F.col(y0)))
    return some.withColumn("tile_x", F.explode(F.sequence(F.col(x0), F.col(x1) - 1))).withColumn("tile_y", F.explode(F.sequence(F.col(y0), F.col(y1) - 1)))


def splat_alpha(dx: Column, dy: Column, conic: tuple[Column, Column, Column], opacity: Column) -> Column:
    """min(.99, opacity e^power); null where the power is positive or alpha under 1/255."""
    power = -0.5 * (conic[0] * dx * dx + conic[2] * dy * dy) - conic[1] * dx * dy
    alpha = F.least(F.lit(0.99), opacity * F.exp(power))
    return F.when((power <= 0) & (alpha >= 1.0 / 255), alpha)


def composite(hits: DataFrame, pixel: list[str], order: list[str], alpha: str = "alpha", most: int | None = 100, stop: float = 1e-4) -> DataFrame:
    """Depth-ordered transmittance: adds ``slot``, ``t_after`` and ``weight`` = alpha times
    the light left before the hit. The running product never rises, so stopping at the
    first hit that would leave less than ``stop`` is a filter on it."""
    w = Window.partitionBy(*pixel).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(Window.partitionBy(*pixel).orderBy(*order))
    out = hits.withColumn("t_after", F.product(1 - F.col(alpha)).over(w)).withColumn("slot", rank - 1).where(F.col("t_after") >= stop)
    out = out.withColumn("weight", F.col(alpha) * F.col("t_after") / (1 - F.col(alpha)))
    return out if most is None else out.where(F.col("slot") < most)


def render(weighted: DataFrame, pixel: list[str], value: str, background: float = 0.0) -> DataFrame:
    """(pixel, rendered): weighted values plus the background through what light is left."""
    return weighted.groupBy(*pixel).agg((F.sum(F.col(value) * F.col("weight")) + background * F.min("t_after")).alias("rendered"))


def top_contributors(contribs: DataFrame, pixel: list[str], k: int, order: list[Column]) -> DataFrame:
    """The k first contributions of each pixel, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(*pixel).orderBy(*order))
    return contribs.withColumn("rank", rank).where(F.col("rank") <= k)


def truncate_visibility(contribs: DataFrame, pixel: list[str], order: list[str], fraction: float, relative: float, least: int, weight: str = "weight") -> DataFrame:
    """Largest first, contributions stay while the mass before them is under ``fraction`` of
    the pixel's and they have ``relative`` of its largest; ``least`` of them always do."""
    p = Window.partitionBy(*pixel)
    w = p.orderBy(F.col(weight).desc(), *order)
    before = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    keep = (F.row_number().over(w) <= least) | ((before < fraction * F.sum(weight).over(p)) & (F.col(weight) >= relative * F.max(weight).over(p)))
    return contribs.withColumn("keep", keep).where("keep").drop("keep")


def signed_ownership(contribs: DataFrame, view: list[str], gid: str = "gid", seg: str = "seg_id", weight: str = "weight") -> DataFrame:
    """(view, gid, owner, total, confidence): the segment of most mass per view and point,
    the lowest of equals, and how far it outweighs the rest, held in [0, 1]."""
    mass = contribs.groupBy(*view, gid, seg).agg(F.sum(weight).alias("m"))
    per = mass.groupBy(*view, gid).agg(F.sum("m").alias("total"), F.max(F.struct("m", (-F.col(seg)).alias("neg"))).alias("top"))
    confidence = F.when(F.col("total") > 0, clip((2 * F.col("top.m") - F.col("total")) / F.col("total"), 0.0, 1.0)).otherwise(0.0)
    return per.select(*view, gid, (-F.col("top.neg")).alias("owner"), "total", confidence.alias("confidence"))


def apply_ownership(contribs: DataFrame, owners: DataFrame, view: list[str], gid: str = "gid", seg: str = "seg_id", weight: str = "weight") -> DataFrame:
    """Contributions of a point to its owner's pixels, times the confidence; others go."""
    joined = contribs.join(owners.select(*view, gid, "owner", "confidence"), [*view, gid])
    return joined.where((F.col(seg) == F.col("owner")) & (F.col("confidence") > 0)).withColumn(weight, F.col(weight) * F.col("confidence")).drop("owner", "confidence")


def surface_responsibility(contribs: DataFrame, pixel: list[str], order: list[str], scale: float, limit: float, ratio: float = 5.0, front: float = 0.05, steps: int = 10, weight: str = "weight", depth: str = "depth") -> DataFrame:
    """Weights drawn toward a pixel's front surface: exp(-(depth - front) / scale), where
    the front is the least depth with ``front`` of the largest weight; each share changes
    by at most ``ratio`` and the distribution by at most ``limit`` in KL; mass is kept.

    One sorted array per pixel (bounded by the contributions that a pixel keeps)."""
    own = F.sort_array(F.collect_list(F.struct(*order, F.col(weight).alias("w"), F.col(depth).alias("d"))))
    per = contribs.groupBy(*pixel).agg(own.alias("own")).withColumn("mass", F.aggregate("own", F.lit(0.0), lambda a, x: a + x["w"]))
    most = F.array_max(F.transform("own", lambda x: x["w"]))
    per = per.withColumn("front", F.array_min(F.transform(F.filter("own", lambda x: x["w"] >= front * most), lambda x: x["d"])))
    base = F.transform("own", lambda x: x["w"] / F.col("mass"))
    per = per.withColumn("base", base)
    gate = lambda x: F.exp(-F.greatest(x["d"] - F.col("front"), F.lit(0.0)) / scale)
    per = per.withColumn("pull", F.transform("own", lambda x: gate(x) * x["w"] / F.col("mass")))
    total = F.aggregate("pull", F.lit(0.0), lambda a, x: a + x)
    held = F.zip_with(F.transform("pull", lambda x: x / total), F.col("base"), lambda t, b: F.least(b * ratio, F.greatest(b / ratio, t)))
    per = per.withColumn("held", held)
    again = F.aggregate("held", F.lit(0.0), lambda a, x: a + x)
    per = per.withColumn("target", F.transform("held", lambda x: x / again))
    per = per.withColumn("share", kl_trust_region("target", "base", limit, steps))
    out = per.select(*pixel, F.explode(F.arrays_zip("own", "share")).alias("e"), "mass")
    return out.select(*pixel, *(F.col(f"e.own.{c}").alias(c) for c in order), (F.col("e.share") * F.col("mass")).alias(weight))


def nearest_visible(points: DataFrame, pixel: list[str], z: str, tolerance: float) -> DataFrame:
    """Points within ``tolerance`` of the least depth at their pixel."""
    return points.withColumn("z_near", F.min(z).over(Window.partitionBy(*pixel))).where(F.col(z) <= F.col("z_near") + tolerance)


def interior_confidence(pixels: DataFrame, reach: int, floor: float, image: list[str], x: str = "px", y: str = "py", seg: str = "seg_id") -> DataFrame:
    """Confidence from ``floor`` at a segment's boundary to 1 at ``reach`` pixels from it.

    Boundary pixels have a 4-neighbour of another segment in the image; each spreads to
    the pixels within reach, an equi-join on pixel places."""
    here = pixels.select(*image, x, y, seg)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = here.select(*image, x, y, seg, steps.alias("s")).select(*image, x, y, F.col(seg).alias("own"), (F.col(x) + F.col("s.dx")).alias("nx"), (F.col(y) + F.col("s.dy")).alias("ny"))
    other = here.select(*image, F.col(x).alias("nx"), F.col(y).alias("ny"), F.col(seg).alias("theirs"))
    edge = near.join(other, [*image, "nx", "ny"]).where("own <> theirs").select(*image, x, y).distinct()
    span = F.sequence(F.lit(-reach), F.lit(reach))
    spread = edge.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).where(f"dx * dx + dy * dy < {reach * reach}")
    least = spread.select(*image, (F.col(x) + F.col("dx")).alias(x), (F.col(y) + F.col("dy")).alias(y), F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")).alias("d")).groupBy(*image, x, y).agg(F.min("d").alias("d"))
    away = F.least(F.coalesce("d", F.lit(float(reach))) / float(reach), F.lit(1.0))
    return here.join(least, [*image, x, y], "left").select(*image, x, y, seg, (floor + (1 - floor) * away).alias("confidence"))


def contribution_masks(contribs: DataFrame, thresholds: list[float], quantiles: list[float], gid: str = "gid", weight: str = "weight") -> DataFrame:
    """(threshold, kept, points, q..): points whose largest contribution over all views reaches
    each threshold, with quantiles of the largest contributions in percent."""
    most = contribs.groupBy(gid).agg(F.max(weight).alias("m"))
    q = most.agg(*(F.percentile("m", x).alias(f"q{round(100 * x)}") for x in quantiles))
    grid = most.select("m", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    kept = grid.groupBy("threshold").agg(F.count(F.when(F.col("m") >= F.col("threshold"), 1)).alias("kept"), F.count("*").alias("points"))
    return kept.join(F.broadcast(q), F.lit(True))
