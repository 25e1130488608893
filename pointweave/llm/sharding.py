"""Operator 7: shards of near equal size by histogram sort, native throughout.

Rows are ordered by (60 bits of the text's md5, doc_id). Splitters are found by counting:
every round sums the exact bytes below candidate key boundaries over all partitions, and
narrows each splitter's interval to the bin that its target falls into, until an interval
holds one unit. A unit is a group of equal texts, so that copies stay together; groups
that outweigh ``1 / FINE`` of a shard are cut between rows, ordered by doc_id. A unit goes
where its middle byte falls, so a shard misses its share by at most half a unit at
either end. Rows are exchanged once, to number them within their shard.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.llm.common import documents, stored

#: Bins that one round counts for each splitter; hot groups hold over 1/FINE of a shard;
#: rows of a deal, which one task sorts; deals whose sizes are broadcast.
BINS, FINE, DEAL, DEALS = 1024, 100, 100_000, 1 << 16
KEY_BITS, LEAST_ID = 60, -(1 << 63)


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key): UTF-8 bytes plus 1, and the place in key order.
    A null text counts as empty, and has the empty text's key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = text.cast("binary")
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.conv(F.substring(F.md5(raw), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )


@dataclass(frozen=True)
class Splitter:
    """Rows with (key, doc_id) at or above it lie to its right; a null id lies lowest.
    ``id`` None: the whole group of that key lies to the right."""

    key: int
    id: int | None = None

    def right(self) -> Column:
        above = F.col("key") > F.lit(self.key)
        same = F.col("key") == F.lit(self.key)
        if self.id is None:
            return above | same
        return above | (same & (F.coalesce("doc_id", F.lit(LEAST_ID)) >= F.lit(self.id)))


def _count(df: DataFrame, column: Column, spans: list[tuple[int, int]]) -> list[dict[int, int]]:
    """For each interval [lo, hi) the bytes in each of its BINS equal bins, one job for
    all; at most len(spans) x BINS rows return."""
    which, at = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (lo, hi) in enumerate(spans):
        inside = (column >= F.lit(lo)) & (column <= F.lit(hi - 1))
        # ids can be negative: their distance to lo may need more than 64 bits
        wide = "decimal(38,0)" if lo < 0 else "bigint"
        bin_ = F.call_function("div", column.cast(wide) - F.lit(lo).cast(wide), F.lit(_step(lo, hi)).cast(wide)).cast("long")
        which = F.when(inside, F.lit(i)).otherwise(which)
        at = F.when(inside, bin_).otherwise(at)
    rows = df.select(which.alias("i"), at.alias("b"), "size").where(F.col("i").isNotNull()).groupBy("i", "b").agg(F.sum("size").alias("n")).collect()
    out: list[dict[int, int]] = [{} for _ in spans]
    for r in rows:
        out[r["i"]][r["b"]] = r["n"]
    return out


def _step(lo: int, hi: int) -> int:
    return max(1, -(-(hi - lo) // BINS))


def _narrow(df: DataFrame, column: Column, targets: dict[int, tuple[Fraction, int]], lo: int, hi: int) -> dict[int, tuple[int, int, int]]:
    """For each target (bytes wanted below it, bytes below ``lo``) the single value of the
    column whose bytes it falls into: (value, bytes below it, its own bytes)."""
    at = {t: (lo, hi, below) for t, (_, below) in targets.items()}
    done: dict[int, tuple[int, int, int]] = {}
    while at:
        spans = sorted({(a, b) for a, b, _ in at.values()})
        counts = dict(zip(spans, _count(df, column, spans), strict=True))
        following = {}
        for t, (a, b, below) in at.items():
            step = _step(a, b)
            bins = counts[a, b]
            for k in sorted(bins):
                if below + bins[k] > targets[t][0] or k == max(bins):
                    start, end = a + k * step, min(b, a + (k + 1) * step)
                    if step == 1:
                        done[t] = (start, below, bins[k])
                    else:
                        following[t] = (start, end, below)
                    break
                below += bins[k]
        at = following
    return done


def splitters(slim: DataFrame, shards: int, fine: int = FINE) -> list[Splitter]:
    """The shards - 1 splitters of the rows of :func:`sizes`."""
    total = slim.agg(F.sum("size")).first()[0]
    if not total:
        return []
    targets = {i: (Fraction(total * i, shards), 0) for i in range(1, shards)}
    found = _narrow(slim, F.col("key"), targets, 0, 1 << KEY_BITS)
    out: dict[int, Splitter] = {}
    hot: dict[int, dict[int, tuple[Fraction, int]]] = {}
    for i, (key, below, own) in found.items():
        if own * shards * fine > total:
            hot.setdefault(key, {})[i] = (targets[i][0], below)
        else:  # the group stays whole, on the side of its middle
            out[i] = Splitter(key if 2 * (targets[i][0] - below) <= own else key + 1)
    for key, wanted in hot.items():
        group = slim.where(F.col("key") == F.lit(key))
        ids = _narrow(group, F.coalesce("doc_id", F.lit(LEAST_ID)), wanted, LEAST_ID, 1 << 63)
        for i, (at, below, own) in ids.items():
            out[i] = Splitter(key, at if 2 * (wanted[i][0] - below) <= own else at + 1)
    return [out[i] for i in sorted(out)]


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", fine: int = FINE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row.

    Law ``bytes``. A null text is empty, size 1; null ids order first; rows that repeat
    with one id stay together; an empty table gives no rows; fewer units than shards
    leave shards empty. Slots run from 0 without gaps, in the order of the id's md5: rows
    are dealt by its first digits within their shard, as many as make deals of about DEAL
    rows, numbered within each deal, and moved by the sizes of the deals before.
    """
    spark = df.sparkSession
    slim = stored(sizes(df, id_col, text_col), "shard-sizes")
    cuts = splitters(slim, shards, fine)
    place = F.lit(0)
    for s in cuts:
        place = place + s.right().cast("int")
    tasks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), slim.count() // DEAL)
    digits = max(1, -(-(tasks // shards).bit_length() // 4))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    dealt = slim.select("doc_id", "size", "text_crc32", place.alias("shard"), order.alias("order")).withColumn("deal", F.substring("order", 1, digits))
    before = dealt.groupBy("shard", "deal").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("shard").orderBy("deal").rowsBetween(Window.unboundedPreceding, 0))
    before = before.select("shard", "deal", (running - F.col("n")).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "deal").orderBy("order", "doc_id", "text_crc32", "size")) - 1
    return (
        dealt.withColumn("number", number)
        .join(F.broadcast(before) if shards * 16**digits <= DEALS else before, ["shard", "deal"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 8)
