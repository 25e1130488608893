"""Shared dictionaries of vectors: assignment, reconstruction, clustering, maintenance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.vec import add, as_double, clip, dot, l2_normalize, scale, squared_distance, subtract
from pointweave.operators.consensus import vector_sum
from pointweave.operators.order import numbered
from pointweave.plans.storage import stored

#: Codes are broadcast up to this many bytes; beyond, points meet them block by block.
BROADCAST_BYTES = 256 << 20
#: Points that a farthest-first start looks at; the driver holds them.
SAMPLE = 16_384
#: Scores (points x codes) that a worker makes at once.
SCORES = 1 << 22


def reconstruct(point_codes: DataFrame, codes: DataFrame, keys: list[str], on: list[str], weight: str | None = None, normalise: bool = True) -> DataFrame:
    """(gid, feature): sum of a point's codes, weighted if asked, then unit length."""
    joined = point_codes.join(codes, on)
    out = vector_sum(joined, keys, "vec", weight if weight else 1.0)
    return out.select(*keys, (l2_normalize("s") if normalise else F.col("s")).alias("feature"))


def nearest_code(points: DataFrame, codes: DataFrame, metric: str = "dot", gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(gid, code_id, score) by matrix products over Arrow batches; ties to the lowest id.

    The dictionary goes to every worker while it is under BROADCAST_BYTES; a larger one is
    taken in blocks of that size, the best of each block meeting in one aggregate."""
    spark = points.sparkSession
    width = len(codes.select("vec").first()[0] or [1])
    blocks = max(1, -(-codes.count() * width * 8 // BROADCAST_BYTES))
    parts = []
    kind = points.schema[gid].dataType.simpleString()
    for b in range(blocks):
        chosen = codes if blocks == 1 else codes.where(F.pmod(F.hash("code_id"), F.lit(blocks)) == b)
        pdf = chosen.select("code_id", "vec").orderBy("code_id").toPandas()
        if not len(pdf):
            continue
        held = spark.sparkContext.broadcast((pdf["code_id"].to_numpy(), np.array(pdf["vec"].tolist(), float)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, c = held.value
            half = (c * c).sum(1) / 2
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
                step = max(1, SCORES // len(ids))
                for i in range(0, n, step):
                    s = v[i : i + step] @ c.T
                    if metric == "l2":
                        s = s - half
                    at = s.argmax(1)
                    best = s[np.arange(len(at)), at]
                    if metric == "l2":
                        best = (v[i : i + step] ** 2).sum(1) - 2 * best
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(at)), pa.array(ids[at].astype(np.int64)), pa.array(best)], names=[gid, "code_id", "score"])

        parts.append(points.select(gid, vec).mapInArrow(run, f"`{gid}` {kind}, code_id bigint, score double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) == 1:
        return out
    sign = 1 if metric == "dot" else -1
    return out.groupBy(gid).agg(F.max(F.struct((sign * F.col("score")).alias("s"), (-F.col("code_id")).alias("c"))).alias("b")).select(gid, (-F.col("b.c")).alias("code_id"), (sign * F.col("b.s")).alias("score"))


def update_codes(points: DataFrame, assigned: DataFrame, codes: DataFrame, spherical: bool, gid: str = "gid", vec: str = "vec", weight: str | None = None) -> DataFrame:
    """Mean (or mean direction) of each code's points; (code_id, vec, n)."""
    joined = points.join(assigned.select(gid, "code_id"), gid)
    total = vector_sum(joined, ["code_id"], vec, weight if weight else 1.0)
    mean = l2_normalize("s") if spherical else F.transform("s", lambda x: x / F.col("total_w"))
    return total.select("code_id", mean.alias("vec"), F.col("total_w").alias("n"))


def kmeans(points: DataFrame, k: int, rounds: int, spherical: bool = True, empty: str = "keep", init: DataFrame | None = None, gid: str = "gid", vec: str = "vec", weight: str | None = None, tol: float = 1e-10) -> DataFrame:
    """(code_id, vec) after at most ``rounds`` rounds.

    ``init``: (code_id, vec); else the k points of lowest id. ``empty``: what becomes of a
    code without points: ``keep`` its vector, ``reseed`` from a point by hash of the round,
    or ``farthest``: the points farthest from their codes. As many points as codes, or
    fewer, are the codes. The k codes are the only thing that the driver holds, up to
    tens of thousands.
    """
    spark = points.sparkSession
    if init is None:
        if points.count() <= k:
            return numbered(points.select(gid, (l2_normalize(vec) if spherical else as_double(vec)).alias("vec")), [F.col(gid)], "code_id").select("code_id", "vec")
        first = points.orderBy(gid).limit(k).select(vec).collect()
        init = spark.createDataFrame([(i, [float(x) for x in r[0]]) for i, r in enumerate(first)], "code_id bigint, vec array<double>")
    codes = {r["code_id"]: np.array(r["vec"], float) for r in init.collect()}
    for step in range(rounds):
        frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in codes.items()], "code_id bigint, vec array<double>")
        assigned = nearest_code(points, frame, "dot" if spherical else "l2", gid, vec)
        moved = {r["code_id"]: np.array(r["vec"], float) for r in update_codes(points, assigned, frame, spherical, gid, vec, weight).collect()}
        gone = sorted(set(codes) - set(moved))
        if gone and empty != "keep":
            if empty == "farthest":
                order = F.col("score").asc() if spherical else F.col("score").desc()
                seeds = assigned.join(points.select(gid, vec), gid).orderBy(order, gid).limit(len(gone)).select(vec).collect()
            else:
                seeds = points.orderBy(F.xxhash64(F.lit(step), gid)).limit(len(gone)).select(vec).collect()
            for i, s in zip(gone, seeds, strict=False):
                v = np.array(s[0], float)
                moved[i] = v / max(np.linalg.norm(v), 1e-8) if spherical else v
        shift = max((float(np.abs(moved[i] - codes[i]).max()) for i in moved), default=0.0)
        codes.update(moved)
        if shift < tol:
            break
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in sorted(codes.items())], "code_id bigint, vec array<double>")


def farthest_first(points: DataFrame, k: int, sample: int = SAMPLE, seed: int = 0, gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(code_id, vec): k unit vectors of at most ``sample`` points (by seeded hash), each the one
    least like its likest among those before it; ties to the lower hash. A start for k-means."""
    rows = points.orderBy(F.xxhash64(F.lit(seed), gid), gid).limit(sample).select(l2_normalize(vec).alias("vec")).toArrow()
    v = rows.column("vec").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    chosen, near = [], np.full(len(v), -np.inf)
    for _ in range(min(k, len(v))):
        at = int((1 - near).argmax()) if chosen else 0
        chosen.append(at)
        near = np.maximum(near, v @ v[at])
    return points.sparkSession.createDataFrame([(i, v[at].tolist()) for i, at in enumerate(chosen)], "code_id bigint, vec array<double>")


def residuals(points: DataFrame, assigned: DataFrame, codes: DataFrame, gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(gid, vec): what the assigned code leaves of each vector."""
    joined = points.join(assigned.select(gid, "code_id"), gid).join(F.broadcast(codes.select("code_id", F.col("vec").alias("code_vec"))), "code_id")
    return joined.select(gid, F.zip_with(vec, "code_vec", lambda x, y: x.cast("double") - y).alias(vec))


def residual_quantise(points: DataFrame, sizes: list[int], rounds: int, gid: str = "gid", vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """(codes (level, code_id, vec), point_codes (gid, level, code_id)): level 0 spherical,
    later ones Euclidean on what the levels before left."""
    left, codes, ids = points.select(gid, vec), None, None
    for level, k in enumerate(sizes):
        own = kmeans(left, k, rounds, spherical=level == 0, gid=gid, vec=vec)
        assigned = nearest_code(left, own, "dot" if level == 0 else "l2", gid, vec)
        c, p = own.select(F.lit(level).alias("level"), "code_id", "vec"), assigned.select(gid, F.lit(level).alias("level"), "code_id")
        codes, ids = (c, p) if codes is None else (codes.unionByName(c), ids.unionByName(p))
        left = residuals(left, assigned, own, gid, vec)
    return codes, ids


def sparse_code(points: DataFrame, codes: DataFrame, slots: int, gain: float, target: float, capacity: str | None = None, gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(gid, slot, code_id, weight): matching pursuit. The first coefficient is 1, later
    ones the residual's projection held in [0, 1]; a slot is taken while the similarity is
    under ``target`` and gains at least ``gain``; slots below the point's ``capacity`` are
    mandatory; weights are 255ths of the point's largest. Vectorised over Arrow batches."""
    spark = points.sparkSession
    pdf = codes.select("code_id", "vec").orderBy("code_id").toPandas()
    held = spark.sparkContext.broadcast((pdf["code_id"].to_numpy(), np.array(pdf["vec"].tolist(), float)))
    kind = points.schema[gid].dataType.simpleString()
    cap = F.col(capacity).cast("int") if capacity else F.lit(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = held.value
        step = max(1, SCORES // len(ids))
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            n = batch.num_rows
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            must = batch.column(2).to_numpy(zero_copy_only=False)
            approx, similarity = np.zeros_like(v), np.full(n, -np.inf)
            active = np.ones(n, bool)
            rows = []
            used = np.zeros((n, len(ids)), bool)
            for slot in range(slots):
                score = (v - approx) @ c.T
                score[used] = -np.inf
                at = score.argmax(1)
                coef = np.ones(n) if slot == 0 else np.clip(score[np.arange(n), at], 0, 1)
                new = approx + coef[:, None] * c[at]
                cos = (new * v).sum(1) / np.maximum(np.linalg.norm(new, axis=1) * np.linalg.norm(v, axis=1), 1e-8)
                take = active & ((slot == 0) | (slot < must) | ((similarity < target) & (cos - similarity >= gain)))
                approx[take], similarity[take] = new[take], cos[take]
                used[take, at[take]] = True
                active = take
                rows.append((take, at, coef))
                if not take.any():
                    break
            weight = np.array([np.where(t, w, 0) for t, _, w in rows])
            top = np.maximum(weight.max(0), 1e-12)
            for slot, (take, at, w) in enumerate(rows):
                i = np.flatnonzero(take)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(np.full(len(i), slot, np.int32)), pa.array(ids[at[i]].astype(np.int64)), pa.array(np.rint(255 * w[i] / top[i]).astype(np.int32))], names=[gid, "slot", "code_id", "weight"])

    return points.select(gid, vec, cap.alias("cap")).mapInArrow(run, f"`{gid}` {kind}, slot int, code_id bigint, weight int")


def residual_spherical(points: DataFrame, sizes: list[int], rounds: int, weight: str | None = None, gid: str = "gid", vec: str = "vec") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(codes (level, code_id, vec), point_codes (gid, level, code_id), rebuilt (gid, vec)):
    every level is spherical, on what of the vectors is at right angles to what the levels
    before rebuilt, which has unit length."""
    kept = [gid, *([weight] if weight else [])]
    own = stored(points.select(*kept, l2_normalize(vec).alias("full")).withColumn("left", F.col("full")).withColumn("rebuilt", F.transform("full", lambda _: F.lit(0.0))), "spherical-points")
    codes, ids = None, None
    for level, k in enumerate(sizes):
        left = own.select(*kept, F.col("left").alias("vec"))
        book = kmeans(left, k, rounds, True, "farthest", None, gid, "vec", weight)
        at = stored(nearest_code(left, book, "dot", gid), "spherical-ids")
        c, p = book.select(F.lit(level).alias("level"), "code_id", "vec"), at.select(gid, F.lit(level).alias("level"), "code_id")
        codes, ids = (c, p) if codes is None else (codes.unionByName(c), ids.unionByName(p))
        joined = own.join(at.select(gid, "code_id"), gid).join(F.broadcast(book.withColumnRenamed("vec", "code")), "code_id")
        joined = joined.select(*kept, "full", l2_normalize(add("rebuilt", "code")).alias("rebuilt"))
        own = stored(joined.withColumn("left", l2_normalize(subtract("full", scale("rebuilt", dot("full", "rebuilt"))))), "spherical-points")
    return codes, ids, own.select(gid, F.col("rebuilt").alias("vec"))


def adaptive_codebook(points: DataFrame, k: int, rounds: int, slots: int, gain: float, target: float, capacity: str | None = None, codes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(codes, slots as of :func:`sparse_code`, histogram (slots, points)): one shared book,
    built or given, and as many ids a point as its distortion asks for."""
    if codes is None:
        codes = kmeans(points, k, rounds)
    rows = stored(sparse_code(points, codes, slots, gain, target, capacity), "adaptive-slots")
    histogram = rows.groupBy("gid").agg(F.count("*").alias("slots")).groupBy("slots").agg(F.count("*").alias("points"))
    return codes, rows, histogram


def extend_codes(points: DataFrame, slots: DataFrame, codes: DataFrame, extension: DataFrame, least_gain: float, gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(gid, code_id, coefficient, accepted, cosine): one more code a point, from an extension
    of the book, on what its slots (gid, code_id, weight u8) leave; accepted where it gains
    at least ``least_gain`` in cosine."""
    current = reconstruct(slots.withColumn("__w", F.col("weight") / 255.0), codes, [gid], ["code_id"], "__w").withColumnRenamed("feature", "now")
    rows = stored(points.select(gid, l2_normalize(vec).alias("goal")).join(current, gid), "extend-points")
    left = rows.select(gid, l2_normalize(subtract("goal", "now")).alias("vec"))
    at = nearest_code(left, extension, "dot", gid).select(gid, "code_id")
    joined = rows.join(at, gid).join(F.broadcast(extension.select("code_id", F.col("vec").alias("code"))), "code_id")
    joined = joined.withColumn("coefficient", clip(dot(subtract("goal", "now"), "code"), 0.0, 1.0))
    joined = joined.withColumn("new", l2_normalize(add("now", scale("code", "coefficient"))))
    old, new = dot("goal", "now"), dot("goal", "new")
    accepted = (F.col("coefficient") > 1e-6) & (new - old >= least_gain)
    return joined.select(gid, "code_id", "coefficient", accepted.alias("accepted"), F.when(accepted, new).otherwise(old).alias("cosine"))


def learn_extension(points: DataFrame, slots: DataFrame, codes: DataFrame, k: int, rounds: int, gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(code_id, vec): k unit codes of what the slots leave, with ids after the book's."""
    current = reconstruct(slots.withColumn("__w", F.col("weight") / 255.0), codes, [gid], ["code_id"], "__w").withColumnRenamed("feature", "now")
    left = stored(points.select(gid, l2_normalize(vec).alias("goal")).join(current, gid).select(gid, l2_normalize(subtract("goal", "now")).alias("vec")), "extend-left")
    first = codes.agg(F.max("code_id")).first()[0] + 1
    return kmeans(left, k, rounds, True, "farthest", None, gid, "vec").select((F.col("code_id") + first).alias("code_id"), "vec")


def mount_codes(points: DataFrame, codes: DataFrame, most: int, gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(gid, rank, code_id, score): the ``most`` best of the codes (parent, code_id, vec) of each
    point's own parent, ranks from 0, the lower code of equals. Workers hold all codes."""
    rows = codes.select("parent", "code_id", "vec").orderBy("parent", "code_id").toArrow()
    held = points.sparkSession.sparkContext.broadcast((rows.column("parent").to_numpy(), rows.column("code_id").to_numpy(), np.array(rows.column("vec").to_pylist(), float)))
    kind = points.schema[gid].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents, ids, c = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(1).to_numpy(zero_copy_only=False)
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            for p in np.unique(own):
                lo, hi = np.searchsorted(parents, [p, p + 1])
                at = np.flatnonzero(own == p)
                if lo == hi:
                    continue
                s = v[at] @ c[lo:hi].T
                order = np.argsort(-s, axis=1, kind="stable")[:, :most]
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, n))), pa.array(np.tile(np.arange(n, dtype=np.int32), len(at))), pa.array(ids[lo:hi][order].ravel().astype(np.int64)), pa.array(np.take_along_axis(s, order, 1).ravel())], names=[gid, "rank", "code_id", "score"])

    return points.select(gid, F.col("parent").cast("long").alias("parent"), vec).mapInArrow(run, f"`{gid}` {kind}, rank int, code_id bigint, score double")


def reverse_mounts(mounts: DataFrame, usage: DataFrame | None = None, gid: str = "gid") -> DataFrame:
    """(code_id, usage, gids): the points that each code is mounted on, in order, and what they
    use (gid, usage), one each where not given."""
    rows = mounts.withColumn("usage", F.lit(1.0)) if usage is None else mounts.join(usage, gid)
    return rows.groupBy("code_id").agg(F.sum("usage").alias("usage"), F.array_sort(F.collect_list(gid)).alias("gids"))


def hierarchical_codebook(points: DataFrame, coarse: int, fine: int, rounds: int, weight: str | None = None, gid: str = "gid", vec: str = "vec") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coarse codes, fine codes (parent, code_id, vec), points (gid, parent, vec)): spherical
    k-means, then k-means of up to ``fine`` codes within each coarse one, all parents side by
    side: a point meets its own parent's codes only, and a large parent is no single task. A
    parent's first points start its codes; an empty code keeps its vector."""
    kept = [gid, *([weight] if weight else [])]
    unit = stored(points.select(*kept, l2_normalize(vec).alias("vec")), "hierarchy-points")
    top = kmeans(unit, coarse, rounds, True, "farthest", None, gid, "vec", weight)
    own = stored(unit.join(nearest_code(unit, top, "dot", gid).select(gid, F.col("code_id").alias("parent")), gid), "hierarchy-parents")
    place = F.row_number().over(Window.partitionBy("parent").orderBy(gid))
    first = own.withColumn("r", place).where(F.col("r") <= fine)
    book = stored(numbered(first, [F.col("parent"), F.col("r")], "code_id").select("parent", "code_id", "vec"), "hierarchy-codes")
    for _ in range(rounds):
        at = mount_codes(own, book, 1, gid).select(gid, "code_id")
        moved = vector_sum(own.join(at, gid), ["code_id"], "vec", weight or 1.0).where("total_w > 0").select("code_id", l2_normalize("s").alias("new"))
        book = stored(book.join(moved, "code_id", "left").select("parent", "code_id", F.coalesce("new", "vec").alias("vec")), "hierarchy-codes")
    return top, book, own.select(gid, "parent", "vec")


def query_bank(rows: DataFrame, source: str, per_source: int, k: int, rounds: int, seed: int = 0, gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(code_id, vec): k unit queries that stand for observations, as many of each source as
    there are, up to ``per_source``."""
    from pointweave.operators.sample import balanced

    return kmeans(stored(balanced(rows, source, gid, per_source, seed).select(gid, vec), "bank"), k, rounds, True, "farthest", None, gid, vec)


def compact_id(code: Column, codes: int) -> Column:
    """A code's id as exported: 16 bits where ids and a mark for none fit, else 32; none (null or
    negative) is the largest number."""
    none = (1 << 16) - 1 if codes < (1 << 16) - 1 else (1 << 32) - 1
    return F.when(code.isNull() | (code < 0), F.lit(none)).otherwise(code).cast("long")


def merge_levels(codes: DataFrame, point_codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One id space: each level's ids follow those of the levels before it."""
    size = codes.groupBy("level").agg((F.max("code_id") + 1).alias("n"))
    offset = size.select("level", F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    move = lambda df: df.join(F.broadcast(offset), "level").withColumn("code_id", F.col("code_id") + F.col("offset")).drop("offset")
    return move(codes).drop("level"), move(point_codes).withColumnRenamed("level", "slot")


def valid_points(point_codes: DataFrame, levels: int, rule: str = "all", gid: str = "gid") -> DataFrame:
    """Ids with a code on every level (``all``) or on any (``any``)."""
    n = point_codes.groupBy(gid).agg(F.count_distinct("slot").alias("n"))
    return n.where(F.col("n") >= (levels if rule == "all" else 1)).select(gid)


def prune(point_codes: DataFrame, keep: DataFrame, gid: str = "gid") -> DataFrame:
    return point_codes.join(keep.select(gid).distinct(), gid, "left_semi")


def usage(point_codes: DataFrame, group: str, score: str) -> DataFrame:
    """(group, plain, relative): summed scores; and 1 + that, over its mean."""
    s = point_codes.groupBy(group).agg(F.sum(score).alias("plain"))
    return s.join(F.broadcast(s.agg(F.avg(F.col("plain") + 1).alias("mean"))), F.lit(True)).select(group, "plain", ((F.col("plain") + 1) / F.col("mean")).alias("relative"))


def dead_codes(codes: DataFrame, point_codes: DataFrame) -> DataFrame:
    return codes.join(point_codes.select("code_id").distinct(), "code_id", "left_anti").select("code_id")


def pq_decode(pq_codes: DataFrame, centroids: DataFrame, gid: str = "gid") -> DataFrame:
    """(gid, vec): sub-vectors' centroids in order, joined up; points whose codes are all
    the invalid mark (255 or -1) are left out."""
    bad = pq_codes.groupBy(gid).agg(F.bool_and(F.col("code").isin(-1, 255)).alias("bad")).where("bad")
    good = pq_codes.join(bad, gid, "left_anti").join(F.broadcast(centroids), ["sub", "code"])
    own = good.groupBy(gid).agg(F.array_sort(F.collect_list(F.struct("sub", "vec"))).alias("o"))
    return own.select(gid, l2_normalize(F.flatten(F.transform("o", lambda x: x["vec"]))).alias("vec"))


def pq_encode(points: DataFrame, centroids: DataFrame, subs: int, gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(gid, sub, code): the nearest centroid of each sub-vector; ties to the lowest code."""
    width = F.floor(F.size(vec) / subs).cast("int")
    parts = points.select(gid, vec, F.explode(F.sequence(F.lit(0), F.lit(subs - 1))).alias("sub")).withColumn("part", F.slice(vec, F.col("sub") * width + 1, width))
    c = F.broadcast(centroids.select("sub", "code", F.col("vec").alias("centre")))
    best = F.min(F.struct(squared_distance("part", "centre").alias("d"), "code"))
    return parts.join(c, "sub").groupBy(gid, "sub").agg(best.alias("b")).select(gid, "sub", F.col("b.code").alias("code"))


def split_groups(points: DataFrame, groups: DataFrame, dispersion: float, most: int, blend: float, rounds: int = 8, gid: str = "gid", vec: str = "vec") -> DataFrame:
    """(parent, child, vec, n): two-means of the ``most`` most dispersed groups at or above
    ``dispersion``, each child blended with its parent. A group is one task; groups are
    limited, and their sums are taken natively first."""
    chosen = groups.where(F.col("dispersion") >= dispersion).orderBy(F.col("dispersion").desc(), "group_id").limit(most)
    joined = points.join(F.broadcast(chosen.select("group_id", F.col("vec").alias("centre"))), "group_id")

    def two(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(gid)
        v = np.array(pdf[vec].tolist(), float)
        centre = np.array(pdf["centre"].iloc[0], float)
        far = int((v @ centre).argmin())
        c = np.stack([v[int((v @ v[far]).argmin())], v[far]])
        for _ in range(rounds):
            at = (v @ c.T).argmax(1)
            for j in (0, 1):
                if (at == j).any():
                    m = v[at == j].mean(0)
                    c[j] = m / max(np.linalg.norm(m), 1e-8)
        out = []
        for j in (0, 1):
            m = blend * centre + (1 - blend) * c[j]
            out.append((int(pdf["group_id"].iloc[0]), j, (m / max(np.linalg.norm(m), 1e-8)).tolist(), int((at == j).sum())))
        return pd.DataFrame(out, columns=["parent", "child", "vec", "n"])

    return joined.groupBy("group_id").applyInPandas(two, "parent bigint, child int, vec array<double>, n bigint")


def pq_blend(base: DataFrame, other: DataFrame, centroids: DataFrame, subs: int, share: float, gid: str = "gid") -> DataFrame:
    """(gid, sub, code): points valid in ``base``, encoded again; where ``other`` is valid too,
    as the direction of share x base + the rest x other."""
    a, b = pq_decode(base, centroids, gid), pq_decode(other, centroids, gid).withColumnRenamed("vec", "__b")
    mixed = l2_normalize(add(scale("vec", F.lit(share)), scale("__b", F.lit(1 - share))), 1e-9)
    rows = a.join(b, gid, "left").select(gid, F.when(F.col("__b").isNull(), F.col("vec")).otherwise(mixed).alias("vec"))
    return pq_encode(rows, centroids, subs, gid)


def compose(fine: DataFrame, whole: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """(keys, vec): fine codes plus ``share`` of the object codes of the same key, unit length;
    fine ones alone where there is none."""
    rows = fine.join(whole.select(*keys, F.col("vec").alias("__o")), keys, "left")
    both = F.when(F.col("__o").isNull(), F.transform("vec", lambda x: x.cast("double"))).otherwise(add("vec", scale("__o", F.lit(share))))
    return rows.select(*keys, l2_normalize(both).alias("vec"))
