"""Nearest neighbours by grid buckets, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.vec import cosine, inverse_distance_weight, squared_distance
from pointweave.operators.order import first_n
from pointweave.plans.storage import Parts, stored

#: Widenings of the cell before the points that are left meet the whole source, block by
#: block; the least share of left points that another widening must answer.
WIDENINGS, WORTH = 12, 0.05
#: Points of a block that meets the whole source, and distances that a worker makes at once.
BLOCK, SCORES = 20_000, 1 << 21
#: Arrow batches of the source that a block meets at once.
BATCHES = 64
#: Widths of a cell in the tile that one task searches; distances that are made outright
#: rather than by another widening.
TILE, OUTRIGHT = 4, 1 << 27


def _best(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance): the k nearest of ``y``, ties to the earlier row."""
    parts = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    step = max(1, SCORES // max(1, len(y)))
    for i in range(0, len(x) if len(y) else 0, step):
        d = np.zeros((len(x[i : i + step]), len(y)))
        for a in range(x.shape[1]):
            d += (x[i : i + step, None, a] - y[None, :, a]) ** 2
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(y) > k else np.inf
        q, j = np.nonzero(d <= edge)
        order = np.lexsort((j, d[q, j], q))
        q, j = q[order], j[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, j = q[keep], j[keep]
        parts.append((q + i, j, d[q, j]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _points(t: pa.Table | pa.RecordBatch, axes: list[str]) -> np.ndarray:
    return np.stack([t.column(a).to_numpy() for a in axes], axis=1)


def _flat(df: DataFrame, pos: str, name: str, dims: int) -> DataFrame:
    """(name, p0, p1, ..): rows of a whole, finite position."""
    rows = df.select(name, *(F.col(pos)[i].cast("double").alias(f"p{i}") for i in range(dims)))
    for i in range(dims):
        rows = rows.where(F.abs(f"p{i}") < float("inf"))
    return rows


def _first_side(src: DataFrame, axes: list[str], side: float, most: int) -> float:
    """``side``, or less where a point would share its cell with over ``most`` on average."""
    for _ in range(WIDENINGS):
        cells = src.groupBy(*(F.floor(F.col(a) / side).alias(a) for a in axes)).count()
        held = cells.agg(F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).first()[0]
        if held <= 2 * most:
            break
        side *= max((most / held) ** (1 / len(axes)), 1 / 64)
    return side


def knn(queries: DataFrame, source: DataFrame, k: int, dims: int, side: float, gid: str = "gid", pos: str = "pos", drop_self: bool = True) -> DataFrame:
    """(gid, rank, neighbour, d2): the k nearest source rows of each query by exact squared
    distance, ties to the lower id; fewer if the source is smaller. Points without a finite
    position take no part; ids of the source are unique.

    Each place of a query is looked up once, in a tile of TILE cells a side with all source
    points up to a cell's width around it. It is answered when its k-th distance is at most
    that width: anything outside is farther. The first width is ``side``, or less where the
    source is dense; the rest go on with wider cells while that answers enough of them; what
    remains lies far from the source, or the source is sparse there, and meets all of it in
    blocks of BLOCK points. Of equal source positions only the k lowest ids are compared.
    """
    kind = source.schema[gid].dataType.simpleString()
    axes = [f"p{i}" for i in range(dims)]
    all_src = stored(_flat(source.withColumnRenamed(gid, "neighbour"), pos, "neighbour", dims), "knn-source")
    asked = stored(_flat(queries, pos, gid, dims), "knn-queries")
    total = all_src.count() - (1 if drop_self else 0)
    if total <= 0 or k <= 0:
        return queries.sparkSession.createDataFrame([], f"`{gid}` {queries.schema[gid].dataType.simpleString()}, rank int, neighbour {kind}, d2 double")
    want = min(k, total)
    need = want + (1 if drop_self else 0)
    first = F.row_number().over(Window.partitionBy(*axes).orderBy("neighbour"))
    src = stored(all_src.withColumn("__r", first).where(F.col("__r") <= need).drop("__r"), "knn-source")
    held = src.count()
    left = stored(asked.select(*axes).distinct(), "knn-left")
    waiting = left.count()
    schema = ", ".join([*(f"{a} double" for a in axes), f"neighbour {kind}", "d2 double"])
    out = Parts(queries.sparkSession, "knn", schema)
    width = _first_side(src, axes, side, need) if waiting * held > OUTRIGHT else side
    for _ in range(WIDENINGS):
        if waiting * held <= OUTRIGHT:
            break
        part = stored(_in_tiles(left, src, need, width, axes, schema), "knn-part")
        out.add(part)
        left = stored(left.join(part.select(*axes).distinct(), axes, "left_anti"), "knn-left")
        before, waiting = waiting, left.count()
        if not waiting or (width >= side and before - waiting < WORTH * before):
            break
        width *= 2
    blocks = -(-waiting // BLOCK)
    for b in range(blocks):
        out.add(_against_all(left.where(F.pmod(F.xxhash64(*axes), F.lit(blocks)) == b), src, need, axes, schema))
    found = asked.join(out.read(), axes)
    if drop_self:
        found = found.where(F.col(gid) != F.col("neighbour"))
    rank = F.row_number().over(Window.partitionBy(gid).orderBy("d2", "neighbour"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= want).select(gid, "rank", "neighbour", "d2")


def _in_tiles(left: DataFrame, src: DataFrame, k: int, width: float, axes: list[str], schema: str) -> DataFrame:
    """The k nearest of the places that have them all within ``width``."""
    tile = TILE * width
    tiles = [f"t{i}" for i in range(len(axes))]
    asked = left.select("*", *(F.floor(F.col(a) / tile).alias(t) for a, t in zip(axes, tiles, strict=True)))
    near = src
    for a, t in zip(axes, tiles, strict=True):
        near = near.withColumn(t, F.explode(F.sequence(F.floor((F.col(a) - width) / tile), F.floor((F.col(a) + width) / tile))))
    near = near.join(asked.select(*tiles).distinct(), tiles, "left_semi")
    sure = width * width * (1 - 1e-9)

    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        s = s.sort_by("neighbour")
        x = _points(q, axes)
        at, j, d = _best(x, _points(s, axes), k)
        n = np.bincount(at, minlength=len(x))
        far = np.full(len(x), np.inf)
        ends = np.cumsum(n)[n == k] - 1
        far[n == k] = d[ends]
        keep = (far <= sure)[at]
        at, j, d = at[keep], j[keep], d[keep]
        return pa.table([*(x[at, a] for a in range(len(axes))), s.column("neighbour").take(pa.array(j)), d], names=[*axes, "neighbour", "d2"])

    return asked.groupBy(*tiles).cogroup(near.groupBy(*tiles)).applyInArrow(run, schema)


def _against_all(block: DataFrame, src: DataFrame, k: int, axes: list[str], schema: str) -> DataFrame:
    """The k nearest of the whole source for a block of places: each task keeps its best
    of every BATCHES batches."""
    x = _points(block.toArrow(), axes)
    held = src.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        batches = iter(batches)
        while some := list(islice(batches, BATCHES)):
            s = pa.Table.from_batches(some).sort_by("neighbour")
            at, j, d = _best(x, _points(s, axes), k)
            yield from pa.table([*(x[at, a] for a in range(len(axes))), s.column("neighbour").take(pa.array(j)), d], names=[*axes, "neighbour", "d2"]).to_batches()

    local = src.select("neighbour", *axes).mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy(*axes).orderBy("d2", "neighbour"))
    return local.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r").select(*axes, "neighbour", "d2")


def mean_nearest(points: DataFrame, dims: int, side: float, k: int = 3, gid: str = "gid", pos: str = "pos") -> DataFrame:
    """(gid, mean_d2): mean squared distance of the k nearest others."""
    return knn(points, points, k, dims, side, gid, pos).groupBy(gid).agg(F.avg("d2").alias("mean_d2"))


def nearest_fill(missing: DataFrame, valid: DataFrame, needed: int, dims: int, side: float, gid: str = "gid", pos: str = "pos") -> DataFrame:
    """(gid, neighbour, d2): of the missing points the ``needed`` nearest to a valid one."""
    near = knn(missing, valid, 1, dims, side, gid, pos, drop_self=False)
    return first_n(near, needed, [F.col("d2"), F.col(gid)]).select(gid, "neighbour", "d2")


def two_source_fill(missing: DataFrame, valid: DataFrame, dims: int, side: float, least_cos: float = 0.8, most_ratio: float = 1.5, gid: str = "gid", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """(gid, source, weight): both nearest sources in 255ths by inverse distance where
    their vectors agree and their distances are alike, else the nearest alone."""
    near = knn(missing, valid, 2, dims, side, gid, pos, drop_self=False)
    v = valid.select(F.col(gid).alias("neighbour"), F.col(vec).alias("nv"))
    both = near.join(v, "neighbour").groupBy(gid).agg(*(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("neighbour", "d2", "nv")))
    near_d, far_d = F.sqrt("d21"), F.sqrt("d22")
    mix = F.col("neighbour2").isNotNull() & (cosine("nv1", "nv2") >= least_cos) & (far_d <= most_ratio * F.greatest(near_d, F.lit(1e-8)))
    share = F.when(mix, inverse_distance_weight(near_d, far_d)).otherwise(255)
    both = both.withColumn("share", share)
    rows = F.array(F.struct(F.col("neighbour1").alias("source"), F.col("share").alias("weight")), F.struct(F.col("neighbour2").alias("source"), (255 - F.col("share")).alias("weight")))
    return both.select(gid, F.explode(rows).alias("r")).select(gid, "r.source", "r.weight").where("weight > 0")


def neighbour_support(neighbours: DataFrame, points: DataFrame, candidate: str, floor: float, gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(gid, support, n): share of candidates among a point's neighbours of similarity at
    least ``floor``, each weighing exp(-d2 / d2 of the farthest)."""
    a = points.select(gid, F.col(vec).alias("v"))
    b = points.select(F.col(gid).alias("neighbour"), F.col(vec).alias("w"), candidate)
    far = neighbours.groupBy(gid).agg(F.max("d2").alias("far"))
    rows = neighbours.join(far, gid).join(a, gid).join(b, "neighbour")
    weight = F.exp(-F.col("d2") / F.greatest("far", F.lit(1e-12))) * (cosine("v", "w") >= floor).cast("double")
    rows = rows.select(gid, weight.alias("k"), F.col(candidate).cast("double").alias("hit"))
    return rows.groupBy(gid).agg((F.sum(F.col("k") * F.col("hit")) / F.greatest(F.sum("k"), F.lit(1e-12))).alias("support"), F.count(F.when(F.col("k") > 0, 1)).alias("n"))


def bounded_components(edges: DataFrame, scene: str, order: list[str], most: int, a: str = "a", b: str = "b") -> DataFrame:
    """(scene, node, component, size): union-find in edge order that refuses unions of more
    than ``most`` nodes. The result depends on the order, so a scene is one task."""
    kind = edges.schema[scene].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}
        size: dict[int, int] = {}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in pdf.sort_values(order)[[a, b]].itertuples(index=False):
            for n in (x, y):
                if n not in up:
                    up[n], size[n] = n, 1
            p, q = sorted((root(x), root(y)))
            if p != q and size[p] + size[q] <= most:
                up[q] = p
                size[p] += size[q]
        nodes = sorted(up)
        return pd.DataFrame({scene: pdf[scene].iloc[0], "node": nodes, "component": [root(n) for n in nodes], "size": [size[root(n)] for n in nodes]})

    return edges.groupBy(scene).applyInPandas(run, f"`{scene}` {kind}, node bigint, component bigint, size bigint")


def superpoint_edges(neighbours: DataFrame, points: DataFrame, factor: float, colour: float, log_scale: float, least_cos: float, gid: str = "gid") -> DataFrame:
    """Neighbour pairs near in space (factor times the lesser of both k-th distances),
    colour, size and meaning; points carry rgb, log_scale and vec."""
    far = neighbours.groupBy(gid).agg(F.sqrt(F.max("d2")).alias("r"))
    x = points.join(far, gid).select(gid, *(F.col(c).alias(f"{c}_a") for c in ("rgb", "log_scale", "vec", "r")))
    y = points.join(far, gid).select(F.col(gid).alias("neighbour"), *(F.col(c).alias(f"{c}_b") for c in ("rgb", "log_scale", "vec", "r")))
    rows = neighbours.join(x, gid).join(y, "neighbour")
    near = F.sqrt("d2") <= factor * F.least("r_a", "r_b")
    alike = (squared_distance("rgb_a", "rgb_b") <= colour * colour) & (F.abs(F.col("log_scale_a") - F.col("log_scale_b")) <= log_scale) & (cosine("vec_a", "vec_b") >= least_cos)
    return rows.where(near & alike).select(F.least(gid, "neighbour").alias("a"), F.greatest(gid, "neighbour").alias("b"), "d2").distinct()


def component_diagnostics(sizes: DataFrame, size: str = "size") -> DataFrame:
    return sizes.agg(F.count("*").alias("components"), F.percentile(size, 0.5).alias("median"), F.percentile(size, 0.9).alias("p90"), F.max(size).alias("largest"), F.avg((F.col(size) == 1).cast("double")).alias("singletons"))


def leave_one_out_support(points: DataFrame, group: str, candidate: Column) -> DataFrame:
    """Share of candidates among the others of a candidate's group; 0 alone in it, and for
    points that are no candidates."""
    w = Window.partitionBy(group)
    flag = candidate.cast("double")
    n, s = F.count("*").over(w), F.sum(flag).over(w)
    return points.withColumn("support", F.when((n > 1) & candidate, (s - flag) / (n - 1)).otherwise(0.0))
