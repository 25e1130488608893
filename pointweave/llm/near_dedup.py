"""Operator 3: near-duplicates by bottom-k sketches.

One hash function orders all shingles; a document's sketch is its ``K`` least hashes, a
uniform sample of its set. Documents with equal sets become one node first.

1. Inverted lists. Two sets at the threshold share at least ``need`` sketch values, so each
   node is listed only under its rarest values, as many as that leaves (a prefix in order
   of frequency). Values that many unrelated documents share fall out of the prefix.
2. Lists of up to ``SHORT`` nodes give their pairs. Longer ones give a star: their most
   central node with every other.
3. Pairs whose sizes, or whose estimate from the union's sketch, rule the link out are
   dropped; the rest are confirmed by exact Jaccard on the full sets.
4. Where a long list is not yet one component, the nodes outside the largest one are
   compared with all nodes of the list's group, in blocks of bounded size, again on full
   sets; only links that join components are written.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.common import Words, arrow_map, documents, grams, mix, stored
from pointweave.operators.graph import components

#: Words of a shingle; least similarity in percent; values of a sketch.
SHINGLE, PERCENT, K = 5, 75, 128
#: Longest list that gives all its pairs; most nodes of one side of a block.
SHORT, BLOCK = 32, 256
#: Standard deviations by which an estimate may fall short.
SLACK = 5.3


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted within each text, without repeats; starts). Texts with fewer words
    than a shingle are one; those without words have none."""
    words = Words(texts)
    h = words.hashes()
    n = np.diff(words.first)
    g = grams(h, SHINGLE)
    at = np.arange(len(g))
    own = words.doc[at] == words.doc[at + SHINGLE - 1] if len(g) else np.zeros(0, bool)
    value, row = g[own], words.doc[at[own]]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        whole = []
        for i in few:
            x = np.uint64(n[i])
            for w in h[words.first[i] : words.first[i + 1]]:
                x = mix(np.array([x], np.uint64) + w)[0]
            whole.append(x)
        value, row = np.append(value, np.array(whole, np.uint64)), np.append(row, few)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.searchsorted(row, np.arange(len(texts) + 1))


def set_nodes(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, 0 for empty ones."""
    n = np.diff(starts)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(value), starts[full]) + n[full].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def scan(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n, node, sketch): a hash of the text, set size, the set's name, and its
    k least hashes in order."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, starts = shingle_sets(batch.column(2))
        n = np.diff(starts)
        took = np.minimum(n, k)
        ends = np.cumsum(took)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[:-1] - (ends - took), took)
        sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(value[at].view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(set_nodes(value, starts)), sketch], names=["id", "text_key", "n", "node", "sketch"])

    text = F.col(text_col).cast("string")
    return arrow_map(df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("__text")), run, f"id {kind}, text_key bigint, n bigint, node bigint, sketch array<bigint>")


def need(n: int, k: int, percent: int = PERCENT) -> int:
    """Sketch values that a set of size ``n`` shares with any set that it is linked with.
    Exact where both sketches must be whole sets, else short by SLACK deviations."""
    t = percent / 100
    if n <= t * k:
        return math.ceil(t * n - 1e-9)
    return max(1, math.floor(t * k - SLACK * math.sqrt(t * (1 - t) * k)))


def index(nodes: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """(v, node, n, weight): the inverted lists. ``weight``: the summed frequency of the
    node's sketch values, highest at the centre of a group of near-copies."""
    values = nodes.select("node", "n", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    kept = values.join(shared, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("own"), F.sum("df").alias("weight"))
    t = percent / 100
    least = F.when(F.col("n") <= t * k, F.ceil(F.col("n") * F.lit(t) - F.lit(1e-9))).otherwise(F.lit(need(10 * k, k, percent)))
    # prefix of size - need + 1; the values that nobody else has come first and need no list
    take = (F.size("own") - least + 1).cast("int")
    kept = kept.withColumn("take", take).where("take > 0")
    return kept.select("node", "n", "weight", F.explode(F.slice("own", F.lit(1), F.col("take"))).alias("e")).select("e.v", "node", "n", "weight")


def _fit(a: str, b: str, percent: int):
    """Sizes allow the link."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.col(a) > 0)


def candidates(lists: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b), stars of long lists (node, hub)): pairs a < b, each once."""
    heads = lists.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    short = lists.join(heads.where(F.col("m") <= SHORT), "v")
    x, y = short.select("v", F.col("node").alias("a"), F.col("n").alias("na")), short.select("v", F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = x.join(y, "v").where((F.col("a") < F.col("b")) & _fit("na", "nb", percent)).select("a", "b").distinct()
    long = lists.join(heads.where(F.col("m") > SHORT), "v")
    central = F.max(F.struct("weight", F.col("node").alias("hub"), F.col("n").alias("nh")))
    hubs = long.groupBy("v").agg(central.alias("c")).select("v", "c.hub", "c.nh")
    stars = stored(long.join(hubs, "v").where(F.col("node") != F.col("hub")).select("node", "n", "hub", "nh").distinct(), "near-stars")
    more = stars.where(_fit("n", "nh", percent)).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return pairs.unionByName(more).distinct(), stars.select("node", "hub")


def _estimate(x: np.ndarray, y: np.ndarray, k: int) -> tuple[float, bool]:
    """(Jaccard estimate from the k least values of the union, whether it is exact)."""
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:][both[1:] == both[:-1]]
    single = np.unique(both)
    whole = len(x) < k and len(y) < k
    if not whole:
        single = single[:k]
        twice = twice[twice <= single[-1]]
    return len(twice) / len(single), whole


def estimated(pairs: DataFrame, nodes: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """The pairs whose union sketch doesn't rule the link out."""
    t = percent / 100
    least = t - SLACK * math.sqrt(t * (1 - t) / k)
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"s_{c}"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            j, whole = _estimate(*(s.values.to_numpy().view(np.uint64) for s in (x, y)), k)
            keep.append(j >= (t - 1e-9 if whole else least))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")
    return arrow_map(joined, run, "a bigint, b bigint")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the whole sets of wanted nodes (id, node), read from the text of
    one document each; those that only documents without an id have, by node."""

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = set_nodes(*shingle_sets(batch.column(0)))
        return pa.RecordBatch.from_arrays([pa.array(node), batch.column(0)], names=["node", "text"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, starts = shingle_sets(batch.column(1))
        own = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(value.view(np.int64)))
        out = pa.RecordBatch.from_arrays([batch.column(0), own], names=["node", "shingles"])
        return out.filter(pa.array(set_nodes(value, starts) == batch.column(0).to_numpy()))

    texts = docs.join(wanted, "id").select("node", "text")
    nameless = arrow_map(docs.where("id is null").select("text"), named, "node bigint, text string")
    texts = texts.unionByName(nameless.join(wanted.where("id is null").select("node"), "node").select("node", "text"))
    return arrow_map(texts, run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard reaches the threshold."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")
    return arrow_map(joined, run, "a bigint, b bigint")


def block_links(pdf: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """Links of a block's left nodes with its right nodes of another label; of each left
    node one link to each label."""
    empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if not len(left) or not len(right):
        return empty
    _, ids = np.unique(np.concatenate([*left["shingles"], *right["shingles"]]), return_inverse=True)
    size_l, size_r = left["shingles"].map(len).to_numpy(), right["shingles"].map(len).to_numpy()
    edge = np.concatenate([[0], np.cumsum(size_l)])
    rest = ids[edge[-1] :]
    starts = np.concatenate([[0], np.cumsum(size_r)[:-1]])
    flag = np.zeros(int(ids.max()) + 1, np.int64)
    label, node = right["label"].to_numpy(), right["node"].to_numpy()
    found_a, found_b = [], []
    for i, (own_label, own) in enumerate(zip(left["label"], left["node"], strict=True)):
        mine = ids[edge[i] : edge[i + 1]]
        flag[mine] = 1
        both = np.add.reduceat(flag[rest], starts)
        flag[mine] = 0
        hit = np.flatnonzero((100 * both >= percent * (size_l[i] + size_r - both)) & (label != own_label))
        if len(hit):
            first = hit[np.unique(label[hit], return_index=True)[1]]
            found_a += [own] * len(first)
            found_b += node[first].tolist()
    return pd.DataFrame({"a": found_a, "b": found_b}, dtype=np.int64) if found_a else empty


def leftover(stars: DataFrame, labels: DataFrame, sets_of, percent: int = PERCENT) -> DataFrame | None:
    """Links (a, b) between components that meet in one group of long lists; None if there
    is no such group. ``sets_of``: nodes -> their full sets."""
    groups = components(stars.select(F.col("node").alias("a"), F.col("hub").alias("b"))).select("node", F.col("label").alias("g"))
    # a node without any link is a component of its own
    member = stored(groups.join(labels, "node", "left").select("g", "node", F.coalesce("label", "node").alias("label")), "near-members")
    by = member.groupBy("g", "label").agg(F.count("*").alias("n"))
    tops = by.groupBy("g").agg(F.sum("n").alias("size"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1")
    if tops.isEmpty():
        return None
    open_ = member.join(tops.select("g", "size", F.col("top.label").alias("main")), "g").withColumn("out", F.col("label") != F.col("main"))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    open_ = open_.select("g", "node", "label", "out", blocks.alias("k"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("i"))
    open_ = stored(open_.join(sets_of(open_.select("node").distinct()), "node"), "near-open")
    spread = lambda: F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    left = open_.where("out").select("g", "i", spread().alias("j"), "node", "label", "shingles", F.lit(0).alias("side"))
    # right blocks go only to the left blocks that exist
    rows = open_.where("out").select("g", "i").distinct()
    right = open_.select("g", F.col("i").alias("j"), "node", "label", "shingles").join(rows, "g").select("g", "i", "j", "node", "label", "shingles", F.lit(1).alias("side"))
    return left.unionByName(right).groupBy("g", "i", "j").applyInPandas(lambda pdf: block_links(pdf, percent), "a bigint, b bigint")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, text_key, n, component_id) of each row of (id, text)."""
    scanned = stored(scan(docs, k, "id", "text"), "near-scan")
    nodes = stored(scanned.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.first("sketch").alias("sketch")), "near-nodes")
    lists = stored(index(nodes, k, percent), "near-lists")
    pairs, stars = candidates(lists, percent)
    pairs = stored(estimated(pairs, nodes, k, percent), "near-pairs")
    name = nodes.select("node", "id")

    def sets_of(chosen: DataFrame) -> DataFrame:
        return stored(full_sets(docs, chosen.join(name, "node")), "near-sets")

    sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    links = stored(confirmed(pairs, sets, percent), "near-links")
    labels = components(links)
    more = leftover(stars, labels, sets_of, percent)
    more = stored(more, "near-more") if more is not None else None
    if more is not None and not more.isEmpty():
        labels = components(links.unionByName(more))
    least = labels.join(name, "node").groupBy("label").agg(F.min("id").alias("component_id"))
    named = name.join(labels.join(least, "label").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "id").alias("component_id"))
    rows = scanned.select("id", "text_key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    alone = rows.where("n = 0").select("id", "text_key", "n", F.col("id").alias("component_id"))
    return rows.where("n > 0").join(named, "node").select("id", "text_key", "n", "component_id").unionByName(alone)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of ``df``.

    component_id: the least id that links reach; kept: whether it is the row's own. Null,
    empty and blank texts have no shingles and stand alone. Rows that repeat an id with
    one text are one document: all are kept, or none. Null ids never name a component
    unless all of its ids are null. An empty table gives no rows; other columns are dropped.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _grouped(docs, k, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that :func:`near_duplicates` keeps, all columns; rows are told apart
    by id and text, so of two texts under one id either may go. Null and empty texts stay.
    Rows that repeat an id with one text stay or go together, and so do copies of a text
    that all lack an id."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    gone = _grouped(docs, k, percent).where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__key"))
    return df.join(gone, same, "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
