"""Per-point aggregates of observed vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.vec import clip, cosine, l2_normalize, norm, sigmoid
from pointweave.operators.order import first_n


#: Vectors that a join may send to every worker.
BROADCAST_BYTES = 64 << 20


def _codes(keys: list[pa.Array]) -> list[np.ndarray]:
    return [k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _sums(keys: list[pa.Array], w: np.ndarray, v: np.ndarray) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """Sums of (already weighted) vectors over equal neighbouring keys."""
    begins = np.zeros(len(w), bool)
    begins[:1] = True
    for c in _codes(keys):
        begins[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(begins)
    return [k.take(pa.array(at)) for k in keys], np.add.reduceat(w, at), np.add.reduceat(v, at)


def _batch(keys: list[pa.Array], w: np.ndarray, v: np.ndarray, names: list[str]) -> pa.RecordBatch:
    offsets = np.arange(len(w) + 1, dtype=np.int32) * v.shape[1]
    return pa.RecordBatch.from_arrays([*keys, pa.array(w), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], names=names)


def _sum_sorted(rows: DataFrame, keys: list[str], vectors: Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(keys, total_w, s) from (keys, w, x) rows whose partitions hold equal keys together;
    ``vectors`` gives (weights, weighted vectors) of a column x and its weights. A batch's
    last key waits for more."""
    names = [*keys, "total_w", "s"]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, w, v = _sums(batch.columns[:n], *vectors(batch.column(n + 1), batch.column(n).to_numpy(zero_copy_only=False)))
            if held:
                own, w, v = _sums([pa.concat_arrays(x) for x in zip(held[0], own, strict=True)], np.concatenate([held[1], w]), np.concatenate([held[2], v]))
            held = [x.slice(len(w) - 1) for x in own], w[-1:], v[-1:]
            if len(w) > 1:
                yield _batch([x.slice(0, len(w) - 1) for x in own], w[:-1], v[:-1], names)
        if held:
            yield _batch(*held, names)

    return rows.mapInArrow(run, _schema(rows, keys))


def _schema(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "total_w double, s array<double>"])


def vector_sum(df: DataFrame, keys: list[str], vec: str, weight: Column | str | float = 1.0) -> DataFrame:
    """(keys, total_w, s): weighted sum of vectors of one width, over Arrow batches. Each
    batch sums its own keys before the shuffle, so a hot key is one row a batch."""
    w = F.lit(float(weight)) if isinstance(weight, int | float) else (F.col(weight) if isinstance(weight, str) else weight)
    rows = df.where(F.col(vec).isNotNull()).select(*keys, w.cast("double").alias("__w"), F.col(vec).alias("__v"))
    n, names = len(keys), [*keys, "total_w", "s"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = np.lexsort(_codes(batch.columns[:n])[::-1])
                own = [c.take(pa.array(order)) for c in batch.columns[:n]]
                w = batch.column(n).to_numpy(zero_copy_only=False)[order]
                yield _batch(*_sums(own, w, _matrix(batch.column(n + 1))[order] * w[:, None]), names)

    part = rows.mapInArrow(partial, _schema(rows, keys))
    return _sum_sorted(part.repartition(*keys).sortWithinPartitions(*keys), keys, lambda x, w: (w, _matrix(x)))


def segment_weights(contribs: DataFrame, keys: list[str], seg: str, weight: str = "weight") -> DataFrame:
    """Weights are summed by (keys, segment) before any vector is joined: the vector of a
    segment enters a sum once a point, not once a pixel."""
    return contribs.groupBy(*keys, seg).agg(F.sum(weight).alias("w"))


def weighted_sums(contribs: DataFrame, segments: DataFrame, keys: list[str], seg: str = "seg_id", vec: str = "vec", weight: str = "weight") -> DataFrame:
    """(keys, total_w, s): sums over each key's segments. Only (keys, segment, weight) rows
    are shuffled while the segments' vectors fit a broadcast; beyond, they are joined."""
    weights = segment_weights(contribs, keys, seg, weight)
    vectors = segments.where(F.col(vec).isNotNull()).select(seg, vec)
    size = vectors.agg((F.count("*") * F.max(F.size(vec)) * 8).alias("bytes")).first()[0] or 0
    if size > BROADCAST_BYTES:
        return vector_sum(weights.join(vectors, seg), keys, vec, "w")
    got = vectors.orderBy(seg).toArrow()
    held = contribs.sparkSession.sparkContext.broadcast((got.column(seg).to_numpy(), _matrix(got.column(vec).combine_chunks()) if got.num_rows else np.zeros((1, 0))))

    def looked_up(x: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, v = held.value
        at = np.minimum(np.searchsorted(ids, x.to_numpy(zero_copy_only=False)), max(len(ids) - 1, 0))
        w = w * (ids[at] == x.to_numpy(zero_copy_only=False)) if len(ids) else w * 0  # others have no vector, so no weight
        return w, v[at] * w[:, None]

    return _sum_sorted(weights.repartition(*keys).sortWithinPartitions(*keys).select(*keys, F.col("w").cast("double").alias("w"), seg), keys, looked_up).where("total_w > 0")


def consensus(contribs: DataFrame, segments: DataFrame, keys: list[str], seg: str = "seg_id", vec: str = "vec", weight: str = "weight", eps: float = 1e-8) -> DataFrame:
    """(keys, feature, total_w, mean_norm): direction and length of the weighted mean; no
    row without weight."""
    total = weighted_sums(contribs, segments, keys, seg, vec, weight).where("total_w > 0")
    return total.select(*keys, l2_normalize(F.transform("s", lambda x: x / F.col("total_w")), eps).alias("feature"), "total_w", (norm("s") / F.col("total_w")).alias("mean_norm"))


def split_reliability(v: Column, w: Column, a: Column, b: Column, floor: float) -> Column:
    """Agreement of two splits' directions above ``floor``, times the root of how evenly
    their weights are shared."""
    agree = clip((cosine(v, w) - floor) / (1 - floor), 0.0, 1.0)
    balance = 2 * F.least(a, b) / F.greatest(a + b, F.lit(1e-8))
    return F.when((a > 0) & (b > 0), agree * F.sqrt(balance)).otherwise(0.0)


def fusion_gate(base: Column, aux: Column, heat: float) -> Column:
    return sigmoid((aux - base) / heat)


def leave_one_out(total: Column, total_w: Column, own: Column, own_w: Column) -> Column:
    """Mean of the others; null where they have no weight."""
    return F.when(total_w - own_w > 1e-6, (total - own) / (total_w - own_w))


def geometric_median(rows: DataFrame, keys: list[str], vec: str, weight: str, rounds: int = 8, eps: float = 1e-4) -> DataFrame:
    """(keys, median): Weiszfeld's iteration from the weighted mean over the few rows of a
    key, each round renormalised; in the JVM, over one array a key."""
    from pointweave.functions.vec import as_double

    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(weight).cast("double").alias("w"), as_double(vec).alias("v")))).alias("own"))
    zero = F.transform(F.col("own")[0]["v"], lambda _: F.lit(0.0))

    def mean(weight_of) -> Column:
        s = F.aggregate("own", zero, lambda a, e: F.zip_with(a, e["v"], lambda x, y: x + weight_of(e) * y))
        return l2_normalize(s, 1e-8)

    def away(m: Column, e: Column) -> Column:
        d = F.aggregate(F.zip_with(m, e["v"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        return e["w"] / F.greatest(F.sqrt(d), F.lit(eps))

    # weights of a round first, then their sum: each distance is taken once
    def step(m: Column, _: Column) -> Column:
        weighed = F.transform("own", lambda e: F.struct(away(m, e).alias("w"), e["v"].alias("v")))
        s = F.aggregate(weighed, zero, lambda a, e: F.zip_with(a, e["v"], lambda x, y: x + e["w"] * y))
        length = F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x)
        return F.transform(F.array(F.struct(s.alias("s"), length.alias("l"))), lambda q: F.transform(q["s"], lambda x: x / F.greatest(F.sqrt(q["l"]), F.lit(1e-8))))[0]

    return got.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), mean(lambda e: e["w"]), step).alias("median"))


def top_fraction(df: DataFrame, fraction: float, population: int, score: str, tie: str, eligible: Column) -> DataFrame:
    """The best eligible rows, max(1, half-even round of ``fraction`` of the population)."""
    return first_n(df.where(eligible), max(1, round(fraction * population)), [F.col(score).desc(), F.col(tie)])


def others(sums: DataFrame, gid: str) -> DataFrame:
    """Adds to (gid, .., total_w, s) the direction of what all other rows of the point sum to;
    rows whose others have no weight are left out."""
    whole = vector_sum(sums, [gid], "s").select(gid, F.col("s").alias("__s")).join(sums.groupBy(gid).agg(F.sum("total_w").alias("__w")), gid)
    rows = sums.join(whole, gid).where(F.col("__w") - F.col("total_w") > 1e-6)
    return rows.withColumn("feature", l2_normalize(F.zip_with("__s", "s", lambda x, y: x - y))).drop("__s", "__w")


def weighted_cosine_loss(rows: DataFrame, by: list[str], a: str, b: str, weight: str) -> DataFrame:
    """(by, loss): weighted mean of 1 - cosine."""
    return rows.groupBy(*by).agg((F.sum(F.col(weight) * (1 - cosine(a, b))) / F.greatest(F.sum(weight), F.lit(1e-8))).alias("loss"))


def contrastive_loss(scores: DataFrame, by: list[str], score: str, own: str, heat: float) -> DataFrame:
    """(by, loss): cross-entropy of the own candidate among all, by softmax of score / heat."""
    rows = scores.withColumn("__z", F.col(score) / heat).withColumn("__m", F.max(F.col(score) / heat).over(Window.partitionBy(*by)))
    return rows.groupBy(*by).agg((F.log(F.sum(F.exp(F.col("__z") - F.col("__m")))) + F.max("__m") - F.max(F.when(F.col(own), F.col("__z")))).alias("loss"))


def view_offsets(codes: DataFrame, basis: DataFrame) -> DataFrame:
    """(view_id, s): low-rank vectors of views, codes (view_id, k, c) over a basis (k, vec)."""
    return vector_sum(codes.join(F.broadcast(basis), "k"), ["view_id"], "vec", "c").select("view_id", "s")
