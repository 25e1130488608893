"""Operator 6: exact top-k inner products by block-at-a-time pruning.

Vectors are integers floor(scale * x). Rows are first put in order of their two nearest
pivots, a bounded sample of rows, so that a range of ``RANGE`` rows that follow one another
holds vectors that are alike. A range carries, for each term (dimension), its largest and
least value, and its forward index is the matrix of its rows. A query takes the ranges in
the order of their summed term maxima, an upper bound of any score in them, in steps that
double, and scores them until the bound falls below its k-th best. A first threshold per
query comes from a bounded set of rows. Queries go against all rows in blocks of bounded
size, many blocks in one pass.

How much a bound can prune depends on the vectors: where they lie in groups, most ranges go
unread; for independent random vectors no range of more than two rows has a bound near the
k-th best, and everything is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.llm.common import stored
from pointweave.plans.ship import ship
from pointweave.plans.storage import Parts

#: Rows of a range; queries of a block; rows that seed the first thresholds; pivots.
RANGE, QUERIES, SEEDS, PIVOTS = 64, 4096, 2048, 256
#: Ranges that a worker takes at once, bytes of their rows, and of the queries of one pass.
RANGES, ROWS_BYTES, PASS_BYTES = 1024, 32 << 20, 32 << 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def integers(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of x as double, and a number of the row. Vectors
    that are null, empty, or hold null or non-finite components, before or after scaling,
    take no part; neither do rows without an id."""
    v = F.transform(vec_col, lambda x: F.lit(float(scale)) * x.cast("double"))
    sound = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    # rint(x - 1/2) would not do: floor() gives a long, which holds no large double
    whole = F.transform(v, lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x))
    return df.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def exact_kind(dim: int, largest: float) -> str:
    """The number type in which sums of ``dim`` products of numbers up to ``largest`` are
    exact: double, 64-bit integer, or Python's own."""
    most = dim * int(largest) ** 2
    return "f8" if most < 1 << 53 else "i8" if most < 1 << 63 else "O"


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = np.array([int(x) for x in flat], object) if kind == "O" else flat.astype(kind)
    return flat.reshape(len(column), -1)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; those beyond them are held at their ends."""
    out = queries @ rows.T
    if out.dtype == object:
        out = np.clip(out, _LEAST, _MOST)
    return out.astype(np.int64)


class Best:
    """The k best of each query of a block so far: (q, vec_id, row, score), ties to smaller
    ids, then rows. ``floor``: a score that k rows are known to reach."""

    def __init__(self, rows: np.ndarray, matrix: np.ndarray, floor: np.ndarray, k: int):
        self.rows, self.matrix, self.k = rows, matrix, k
        self.floor, self.last = floor.copy(), np.full(len(rows), _MOST)  # the k-th best's score and id
        self.found = [np.zeros(0, np.int64)] * 4
        self.scored = self.offered = 0

    def _keep(self, more: list[list[np.ndarray]]) -> None:
        q, ids, rows, score = (np.concatenate([c, *(m[i] for m in more)]) for i, c in enumerate(self.found))
        order = np.lexsort((rows, ids, ~score, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[rank < self.k]
        self.found = [c[order] for c in (q, ids, rows, score)]
        kth = order[rank[rank < self.k] == self.k - 1]
        raised = score[kth] >= self.floor[q[kth]]
        kth = kth[raised]
        self.floor[q[kth]], self.last[q[kth]] = score[kth], ids[kth]

    def feed(self, ids: np.ndarray, numbers: np.ndarray, vectors: np.ndarray) -> None:
        """Score rows (ids, row numbers, vectors) in ranges, per query in the order of the
        ranges' bounds."""
        edges = np.arange(0, len(ids), RANGE)
        self.offered += len(ids) * len(self.rows)
        high, low = np.maximum.reduceat(vectors, edges), np.minimum.reduceat(vectors, edges)
        plus, minus = np.maximum(self.matrix, 0), np.minimum(self.matrix, 0)
        bounds = plus @ high.T + minus @ low.T
        place = np.empty(bounds.shape, np.int32)  # where each query's order has each range
        order = np.argsort(-bounds, axis=1, kind="stable")
        np.put_along_axis(place, order, np.arange(len(edges), dtype=np.int32)[None], axis=1)
        begin, end = 0, 1
        while begin < len(edges):
            alive = (place >= begin) & (place < end) & (bounds >= self.floor[:, None])
            more = []
            for r in np.flatnonzero(alive.any(0)):
                own = np.flatnonzero(alive[:, r])
                part = slice(edges[r], edges[r] + RANGE)
                s = _scores(self.matrix[own], vectors[part])
                self.scored += s.size
                floor = self.floor[own, None]
                good = (s > floor) | ((s == floor) & (ids[part] <= self.last[own, None]))
                good &= numbers[part] != self.rows[own, None]
                i, j = np.nonzero(good)
                more.append([own[i], ids[part][j], numbers[part][j], s[i, j]])
            if not more and (np.take_along_axis(bounds, order[:, begin : begin + 1], 1)[:, 0] < self.floor).all():
                return
            if more:
                self._keep(more)
            begin, end = end, 2 * end


def in_order(base: DataFrame, dim: int, n: int) -> DataFrame:
    """The rows in ``n`` partitions, in order of their two nearest pivots, then of their
    number: rows that are alike follow one another, and equal rows are no hot task."""
    sample = base.orderBy(F.xxhash64("row")).limit(PIVOTS).select("v").toArrow()
    pivots = _matrix(sample.column("v"), "f8")
    with np.errstate(over="ignore"):
        half = np.minimum((pivots * pivots).sum(1) / 2, np.finfo(float).max)
    held = base.sparkSession.sparkContext.broadcast((pivots, half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, h = held.value
        for batch in batches:
            if batch.num_rows:
                with np.errstate(over="ignore", invalid="ignore"):
                    near = np.argsort(-np.nan_to_num(_matrix(batch.column(2), "f8") @ p.T - h), axis=1, kind="stable")[:, :2]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0], pa.int32()), pa.array(near[:, -1], pa.int32())], names=["row", "vec_id", "v", "near", "next"])

    placed = base.select("row", "vec_id", "v").mapInArrow(run, "row bigint, vec_id bigint, v array<double>, near int, next int")
    return placed.repartitionByRange(n, "near", "next", "row").sortWithinPartitions("near", "next", "row").select("row", "vec_id", "v")


def search(df: DataFrame, every: int, k: int, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, its ``k``
    highest inner products with other rows (all, if fewer), ties to smaller ids.

    Vectors of another length than the query's score nothing with it. Rows that repeat an
    id are rows like any others: each is a candidate, also of a query of the same id, and
    each such query is answered on its own, under the same query_id. Scores are exact;
    those beyond 64 bits are held at their ends, and tie there. An empty table gives no rows.
    """
    spark = df.sparkSession
    base = stored(integers(df, scale, id_col, vec_col), "topk-vectors")
    shape = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).collect()
    out = Parts(spark, "topk", "query_id bigint, rank int, vec_id bigint, score bigint")
    for dim, count, largest in sorted(map(tuple, shape)):
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * dim * 8 // ROWS_BYTES))
        rows = stored(in_order(base.where(F.size("v") == dim), dim, n), "topk-rows")
        queries = rows.where(F.col("vec_id") % F.lit(every) == 0)
        passes = -(-queries.count() * dim * 8 // PASS_BYTES)
        seeds = rows.limit(SEEDS).toArrow() if passes else None
        for p in range(passes):
            block = queries.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).toArrow()
            if block.num_rows:
                out.add(_answer(rows, block, seeds, k, exact_kind(dim, largest)))
    return out.read()


def _answer(rows: DataFrame, block: pa.Table, seeds: pa.Table, k: int, kind: str) -> DataFrame:
    numbers, ids = (block.column(c).to_numpy() for c in ("row", "vec_id"))
    matrix, seed, seed_rows = _matrix(block.column("v"), kind), _matrix(seeds.column("v"), kind), seeds.column("row").to_numpy()
    floor = np.full(len(numbers), _LEAST)
    for i in range(0, len(numbers), QUERIES):
        s = _scores(matrix[i : i + QUERIES], seed)
        own = seed_rows == numbers[i : i + QUERIES, None]
        if len(seed_rows) > k:  # k seeds beside the query's own row score at least this much
            floor[i : i + QUERIES] = np.partition(np.where(own, _LEAST, s), -k, axis=1)[:, -k]
    held = rows.sparkSession.sparkContext.broadcast((numbers, ids, matrix, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, matrix, floor = held.value
        best = [Best(numbers[i : i + QUERIES], matrix[i : i + QUERIES], floor[i : i + QUERIES], k) for i in range(0, len(numbers), QUERIES)]
        most = max(RANGE, min(RANGES * RANGE, ROWS_BYTES // (8 * matrix.shape[1])))
        for part in _together(batches, most):
            own, vec_ids, vectors = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), kind)
            for b in best:
                b.feed(vec_ids, own, vectors)
        for i, b in enumerate(best):
            q, vec_id, row, score = b.found
            if len(q):
                q = q + i * QUERIES
                yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(ids[q]), pa.array(row), pa.array(vec_id), pa.array(score)], names=["q", "query_id", "row", "vec_id", "score"])

    local = rows.select("row", "vec_id", "v").mapInArrow(run, "q bigint, query_id bigint, row bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", "row"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches joined and cut to at most ``most`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most - sum(b.num_rows for b in held))
            held.append(part)
            at += part.num_rows
            if sum(b.num_rows for b in held) == most:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)
