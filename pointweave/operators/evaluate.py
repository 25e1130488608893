"""Selections against labels, threshold grids, image metrics, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.geometry import gaussian_window
from pointweave.functions.vec import clip
from pointweave.plans.storage import stored


def iou(p: Column, g: Column) -> Column:
    """Aggregate: intersection over union of two flags; 0 for an empty union."""
    union = F.count(F.when(p | g, 1))
    return F.when(union > 0, F.count(F.when(p & g, 1)) / union).otherwise(0.0)


def check_thresholds(thresholds: list[float]) -> list[float]:
    """Sorted, without repeats; all inside (0, 1)."""
    out = sorted(set(thresholds))
    if not out or out[0] <= 0 or out[-1] >= 1:
        raise ValueError("thresholds lie between 0 and 1")
    return out


def threshold_grid(rows: DataFrame, thresholds: list[float], by: list[str], score: str, truth: str) -> DataFrame:
    """(by, threshold, iou): selection score > threshold; the grid is spread over each row
    and summed map-side."""
    grid = F.explode(F.array(*[F.lit(t) for t in check_thresholds(thresholds)]))
    spread = rows.select(*by, score, truth, grid.alias("threshold"))
    return spread.groupBy(*by, "threshold").agg(iou(F.col(score) > F.col("threshold"), F.col(truth)).alias("iou"))


def summarise(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, miou, acc25, acc50, n) with strict accuracies."""
    return samples.groupBy(*by).agg(F.avg("iou").alias("miou"), F.avg((F.col("iou") > 0.25).cast("double")).alias("acc25"), F.avg((F.col("iou") > 0.5).cast("double")).alias("acc50"), F.count("*").alias("n"))


def best_threshold(grid: DataFrame, by: list[str]) -> DataFrame:
    """The threshold of highest miou, the lowest of equals."""
    w = Window.partitionBy(*by).orderBy(F.col("miou").desc(), "threshold") if by else Window.orderBy(F.col("miou").desc(), "threshold")
    return grid.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def shared_threshold(samples: DataFrame) -> DataFrame:
    """(threshold, miou, scenes): scenes weigh alike; only thresholds that all scenes have."""
    scenes = samples.select("scene").distinct()
    per = samples.groupBy("scene", "threshold").agg(F.avg("iou").alias("m"))
    grid = per.groupBy("threshold").agg(F.avg("m").alias("miou"), F.count("*").alias("scenes"))
    full = grid.join(F.broadcast(scenes.agg(F.count("*").alias("need"))), F.col("scenes") == F.col("need")).drop("need")
    return best_threshold(full, [])


def dataset_iou(rows: DataFrame, by: list[str]) -> DataFrame:
    """Summed intersections over summed unions of (by, inter, uni)."""
    return rows.groupBy(*by).agg(F.when(F.sum("uni") > 0, F.sum("inter") / F.sum("uni")).otherwise(0.0).alias("iou"))


def image_metrics(pixels: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, l1, mse, psnr) of two images with values in [0, 1]."""
    d = F.col(a) - F.col(b)
    out = pixels.groupBy(*by).agg(F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("mse"))
    return out.withColumn("psnr", -10 * F.log10(F.greatest("mse", F.lit(1e-12))))


def ssim(pixels: DataFrame, by: list[str], a: str, b: str, size: int = 11, sigma: float = 1.5) -> DataFrame:
    """(by, ssim): mean structural similarity with a Gaussian window and zeros outside.

    The window is separable: each pixel spreads its five moments over a row, then over a
    column, and sums meet in plain aggregates."""
    w = gaussian_window(size, sigma)
    half = size // 2
    moments = {"ma": F.col(a), "mb": F.col(b), "aa": F.col(a) * F.col(a), "bb": F.col(b) * F.col(b), "ab": F.col(a) * F.col(b)}
    rows = pixels.select(*by, "px", "py", *(c.cast("double").alias(k) for k, c in moments.items()))
    kernel = F.array(*[F.struct(F.lit(i - half).alias("o"), F.lit(v).alias("k")) for i, v in enumerate(w)])
    places = rows.select(*by, "px", "py")
    for axis in ("px", "py"):
        spread = rows.withColumn("e", F.explode(kernel)).withColumn(axis, F.col(axis) + F.col("e.o"))
        rows = spread.groupBy(*by, "px", "py").agg(*(F.sum(F.col(k) * F.col("e.k")).alias(k) for k in moments))
    rows = rows.join(places, [*by, "px", "py"], "left_semi")
    m = F.col
    va, vb, cov = m("aa") - m("ma") * m("ma"), m("bb") - m("mb") * m("mb"), m("ab") - m("ma") * m("mb")
    c1, c2 = 0.01**2, 0.03**2
    value = (2 * m("ma") * m("mb") + c1) * (2 * cov + c2) / ((m("ma") * m("ma") + m("mb") * m("mb") + c1) * (va + vb + c2))
    return rows.groupBy(*by).agg(F.avg(value).alias("ssim"))


def rasterise(polygons: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """(by, px, py): pixels whose centres lie inside any polygon (even-odd rule).

    polygons: (by, poly, points array of (x, y)). Each edge meets the scan lines that it
    crosses; a line's crossings in order are paired into runs."""
    edges = polygons.select(*by, "poly", F.col("points").alias("p"), F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1)).alias("q"))
    edges = edges.select(*by, "poly", F.explode(F.arrays_zip("p", "q")).alias("e")).select(*by, "poly", F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1")).where("y0 <> y1")
    first = F.greatest(F.lit(0), F.ceil(F.least("y0", "y1") - 0.5).cast("int"))
    last = F.least(F.lit(height - 1), (F.ceil(F.greatest("y0", "y1") - 0.5) - 1).cast("int"))
    lines = edges.withColumn("a", first).withColumn("z", last).where("z >= a").withColumn("py", F.explode(F.sequence("a", "z")))
    x = F.col("x0") + (F.col("py") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    hits = lines.select(*by, "poly", "py", x.alias("x")).groupBy(*by, "poly", "py").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.element_at("xs", 2 * i + 1).alias("s"), F.element_at("xs", 2 * i + 2).alias("e")))
    runs = hits.where(F.size("xs") >= 2).select(*by, "py", F.explode(pairs).alias("r"))
    runs = runs.withColumn("a", F.greatest(F.lit(0), F.ceil(F.col("r.s") - 0.5).cast("int"))).withColumn("z", F.least(F.lit(width - 1), (F.ceil(F.col("r.e") - 0.5) - 1).cast("int"))).where("z >= a")
    return runs.select(*by, F.explode(F.sequence("a", "z")).alias("px"), "py").distinct()


def run_lengths(pixels: DataFrame, by: list[str], height: int, x: str = "px", y: str = "py") -> DataFrame:
    """(by, start, length): column-major runs of set pixels, by gaps and islands."""
    place = F.col(x) * height + F.col(y)
    w = Window.partitionBy(*by).orderBy("place")
    rows = pixels.select(*by, place.alias("place")).distinct().withColumn("island", F.col("place") - F.row_number().over(w))
    return rows.groupBy(*by, "island").agg(F.min("place").alias("start"), F.count("*").alias("length")).drop("island")


def run_pixels(runs: DataFrame, by: list[str], height: int) -> DataFrame:
    out = runs.select(*by, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place"))
    return out.select(*by, F.floor(F.col("place") / height).alias("px"), F.pmod("place", F.lit(height)).alias("py"))


def storage(points: int, width: int, ids: int, shared: int, id_bytes: int = 2, mask_bytes: int = 1) -> dict[str, float]:
    """Bytes of a coded artifact against half-precision vectors."""
    dense = 2 * width * points
    coded = points * (id_bytes * ids + mask_bytes) + 2 * width * shared
    return {"dense": dense, "coded": coded, "ratio": dense / coded if coded else 0.0}


def report(metrics: DataFrame, baseline: str) -> DataFrame:
    """(scene, method, miou, delta, percent): every method's best against the baseline's."""
    w = Window.partitionBy("scene", "method").orderBy(F.col("miou").desc(), "threshold")
    best = metrics.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    base = best.where(F.col("method") == baseline).select("scene", F.col("miou").alias("base"))
    rows = best.join(base, "scene", "left")
    return rows.select("scene", "method", "miou", (F.col("miou") - F.col("base")).alias("delta"), F.concat(F.format_number(100 * F.col("miou"), 2), F.lit("%")).alias("percent"))


def gate(rows: DataFrame, least: float = 0.003) -> DataFrame:
    """(scene, go): at least ``least`` more miou and no accuracy lost."""
    go = (F.col("miou") - F.col("base_miou") >= least) & (F.col("acc25") >= F.col("base_acc25")) & (F.col("acc50") >= F.col("base_acc50"))
    return rows.select("scene", go.alias("go"))


def small_regions(pixels: DataFrame, image: str, least: int) -> DataFrame:
    """Pixels of 8-connected regions of at least ``least`` pixels. One image a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {(int(x), int(y)) for x, y in zip(pdf["px"], pdf["py"], strict=True)}
        keep = set()
        while left:
            stack, region = [left.pop()], set()
            while stack:
                x, y = stack.pop()
                region.add((x, y))
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        if (x + i, y + j) in left:
                            left.remove((x + i, y + j))
                            stack.append((x + i, y + j))
            if len(region) >= least:
                keep |= region
        return pdf[[(int(x), int(y)) in keep for x, y in zip(pdf["px"], pdf["py"], strict=True)]]

    return pixels.groupBy(image).applyInPandas(run, pixels.schema)


def rendered_selection(weights: DataFrame, scores: DataFrame, truth: DataFrame, thresholds: list[float], occupancy: float = 0.7, image: str = "view_id", pixel: str = "pixel_id", gid: str = "gid") -> DataFrame:
    """(image, query_id, threshold, iou): points over each threshold are rendered, and the pixels
    where their weights sum to more than ``occupancy`` are held against the truth.

    weights: (image, pixel, gid, weight), the points' shares of a pixel; scores: (gid,
    query_id, score); truth: (image, pixel, query_id), the labelled pixels. Only labelled
    pairs of image and query count. All thresholds are sums of one pass."""
    grid = check_thresholds(thresholds)
    labelled = truth.groupBy(image, "query_id").agg(F.count("*").alias("t"))
    rows = weights.join(scores, gid).join(F.broadcast(labelled.select(image, "query_id")), [image, "query_id"])
    lit = [F.sum(F.when(F.col("score") > x, F.col("weight")).otherwise(0.0)) > occupancy for x in grid]
    seen = rows.groupBy(image, "query_id", pixel).agg(F.array(*lit).alias("lit"))
    seen = seen.join(truth.select(image, "query_id", pixel, F.lit(True).alias("hit")), [image, "query_id", pixel], "left")
    counted = [c for i in range(len(grid)) for c in (F.count(F.when(F.col("lit")[i], 1)).alias(f"p{i}"), F.count(F.when(F.col("lit")[i] & F.col("hit"), 1)).alias(f"i{i}"))]
    per = labelled.join(seen.groupBy(image, "query_id").agg(*counted), [image, "query_id"], "left").na.fill(0)
    cells = F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"p{i}").alias("p"), F.col(f"i{i}").alias("i")) for i, x in enumerate(grid)])
    flat = per.select(image, "query_id", "t", F.explode(cells).alias("c"))
    return flat.select(image, "query_id", "c.threshold", (F.col("c.i") / (F.col("t") + F.col("c.p") - F.col("c.i"))).alias("iou"))


def completeness(want: DataFrame, have: DataFrame) -> DataFrame:
    """(columns, state): rows that are missing, and rows that are unknown."""
    return want.subtract(have).withColumn("state", F.lit("missing")).unionByName(have.subtract(want).withColumn("state", F.lit("unknown")))


def pca_colours(rows: DataFrame, gid: str = "gid", vec: str = "vec", limit: float = 3.0) -> DataFrame:
    """(gid, rgb): the three leading directions of the centred vectors as colours in [0, 1]; in
    each, values within ``limit`` median deviations of the (lower) median span the scale.
    Directions are fixed up to their sign, here such that their largest entry is positive."""
    from pointweave.functions.plug import LinearCodec
    from pointweave.operators.consensus import vector_sum

    own = rows.where(F.col(vec).isNotNull()).select(gid, F.col(vec).alias("vec"))
    mean = vector_sum(own.withColumn("one", F.lit(1)), ["one"], "vec").select(F.transform("s", lambda x: x / F.col("total_w")).alias("m"))
    centred = own.join(F.broadcast(mean), F.lit(True)).select(gid, "vec", F.zip_with("vec", "m", lambda x, y: x - y).alias("c"))
    codec = LinearCodec.fit(centred, 3, "c")
    codec.matrix = codec.matrix * np.sign(codec.matrix[np.abs(codec.matrix).argmax(0), np.arange(3)])
    code = stored(codec.encode(own.select(gid, "vec")).select(gid, "code"), "pca-code")
    median = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c})")
    mid = code.agg(*(median(f"code[{i}]").alias(f"m{i}") for i in range(3)))
    off = stored(code.join(F.broadcast(mid), F.lit(True)).select(gid, "code", *(F.abs(F.col("code")[i] - F.col(f"m{i}")).alias(f"d{i}") for i in range(3))), "pca-off")
    dev = off.agg(*(median(f"d{i}").alias(f"v{i}") for i in range(3)))
    inside = [F.col(f"d{i}") / F.col(f"v{i}") < limit for i in range(3)]
    edge = lambda f, i: f(F.when(inside[i], F.col("code")[i]))
    span = off.join(F.broadcast(dev), F.lit(True)).agg(*(x for i in range(3) for x in (edge(F.min, i).alias(f"lo{i}"), edge(F.max, i).alias(f"hi{i}"))))
    held = F.array(*[clip((F.col("code")[i] - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}")), 0.0, 1.0) for i in range(3)])
    return off.join(F.broadcast(span), F.lit(True)).select(gid, held.alias("rgb"))


def depth_colours(rows: DataFrame, depth: str, near: float | None = None, far: float | None = None) -> DataFrame:
    """Adds ``index``, the place in a colour table of 256: depth between the planes, by default
    the least and greatest depth, held in [0, 1]."""
    s = rows.agg(F.min(depth).alias("__n"), F.max(depth).alias("__f"))
    low, high = (F.lit(near) if near else F.col("__n")), (F.lit(far) if far else F.col("__f"))
    x = clip((F.col(depth) - low) / (high - low + 1e-10), 0.0, 1.0)
    return rows.join(F.broadcast(s), F.lit(True)).withColumn("index", F.floor(x * 255).cast("int")).drop("__n", "__f")


def mask_tiles(pixels: DataFrame, image: list[str], value: str) -> DataFrame:
    """(image, mask, side, tx, ty, value): the pixels of each mask, cut to its box and put in the
    middle of a square of the box's longer side; pixels that have no row are black."""
    w = Window.partitionBy(*image, "mask")
    box = {f"{a}{n}": f(f"p{a}").over(w) for a in "xy" for n, f in ((0, F.min), (1, F.max))}
    rows = pixels.withColumns(box).withColumn("w", F.col("x1") - F.col("x0") + 1).withColumn("h", F.col("y1") - F.col("y0") + 1)
    side = F.greatest("w", "h")
    pad = lambda n: F.floor((side - F.col(n)) / 2)
    return rows.select(*image, "mask", side.alias("side"), (F.col("px") - F.col("x0") + pad("w")).cast("long").alias("tx"), (F.col("py") - F.col("y0") + pad("h")).cast("long").alias("ty"), value)


def working_size(width: Column, height: Column, resolution: int = -1, most: int = 1080) -> tuple[Column, Column]:
    """Width and height at which an image is read: to the asked width, or by default not over
    ``most`` rows."""
    down = F.greatest(height / most, F.lit(1.0)) if resolution == -1 else width / resolution
    return F.floor(width / down).cast("int"), F.floor(height / down).cast("int")
