"""Operator 9: repeated passages by sparse suffixes over words.

Of all suffixes only those at content-selected places are kept: the minimisers of runs of
``GRAM`` words in windows of ``WINDOW`` runs, so a passage of ``LEAST`` words holds the
same chosen places wherever it stands. Suffixes whose next ``REACH`` words occur nowhere
else are dropped by counting. Each passage of ``LEAST`` words whose first chosen place is
left is then looked up among those of all other texts, whatever of it lies left or right
of the place: they are sorted by hash, in ranges over the whole cluster. Those that two
texts hold are marked, and marks that touch are joined.

Equal texts are one text here: each copy of a text that occurs twice is wholly repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.common import Words, arrow_map, documents, grams, pieces, stored

#: Least words of a passage; words of a run; runs of a window.
LEAST, GRAM, WINDOW = 50, 4, 30
#: Words after a chosen place that surely lie in the passage: the first place is at most
#: WINDOW - 1 words from its start.
REACH = LEAST - WINDOW + 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chosen(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words of the windows, place in each of its least run hash, the leftmost of
    equals); windows don't cross texts. ``h``: word hashes; ``first``: each text's first
    word."""
    g = grams(h, GRAM)
    n = len(g)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a run that crosses into the next text never wins
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    crosses = owner[:n] != owner[GRAM - 1 : n + GRAM - 1]
    g = np.where(crosses, np.uint64(0xFFFFFFFFFFFFFFFF), g)
    best, span = g.copy(), 1  # least of [i, i + span), doubled
    while span * 2 <= WINDOW:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    m = n - WINDOW + 1
    least = np.minimum(best[:m], best[WINDOW - span : WINDOW - span + m])
    inside = owner[:m] == owner[WINDOW + GRAM - 2 : m + WINDOW + GRAM - 2]
    # the leftmost place that holds the least value of each whole window
    windows = np.flatnonzero(inside)
    at = np.full(m, -1)
    for i in range(WINDOW - 1, -1, -1):
        hit = g[windows + i] == least[windows]
        at[windows[hit]] = windows[hit] + i
    return windows, at[windows]


def minimisers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places (word numbers) that any window chooses."""
    return np.unique(chosen(h, first)[1])


def _places(part: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, their hashes, chosen places with REACH words after them in their text)."""
    w = Words(part)
    h = w.hashes()
    at = minimisers(h, w.first)
    return w, h, at[at + REACH <= w.first[w.doc[at] + 1]] if len(at) else at


def repeated_places(texts: DataFrame) -> DataFrame:
    """(text_key, places): the chosen places whose next REACH words also occur in another
    text; from (text_key, text), where copies of a text share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w, h, at = _places(part.column(1))
                if len(at):
                    key = grams(h, REACH)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(w.doc[at])), pa.array((at - w.first[w.doc[at]]).astype(np.int32))], names=["key", "text_key", "place"])

    keyed = stored(texts.select("text_key", "text").mapInArrow(run, "key bigint, text_key bigint, place int"), "suffix-keys")
    often = keyed.groupBy("key").agg(F.min("text_key").alias("x"), F.max("text_key").alias("y")).where("x <> y").select("key")
    often = stored(often, "suffix-often")  # on its own, so that the join's hot keys can be split
    return keyed.join(often, "key").groupBy("text_key").agg(F.collect_set("place").alias("places"))


_PASSAGE = "key bigint, text_key bigint, start int"


def candidates(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(key, text_key, start): the hash and first word of each passage of LEAST words whose
    first window chooses one of the places. Equal passages choose the same place."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(1))
        h = w.hashes()
        lists = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        start, at = chosen(h, w.first)
        wanted = np.zeros(len(h), bool)
        wanted[w.first[row] + lists.flatten().to_numpy()] = True
        start = start[wanted[at]]
        row = w.doc[start]
        inside = start + LEAST <= w.first[row + 1]
        start, row = start[inside], row[inside]
        key = grams(h, LEAST)[start].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), pa.array((start - w.first[row]).astype(np.int32))], names=["key", "text_key", "start"])

    joined = texts.join(places, texts["id"].eqNullSafe(places["id"]) & (texts["text_key"] == places["text_key"])).select(texts["text_key"], "text", "places")
    return arrow_map(joined, run, _PASSAGE)


def repeated(passage: DataFrame) -> DataFrame:
    """(text_key, start, end): the passages whose key another text has too.

    They are sorted by key and text in ranges, so that a key of many texts is no hot task.
    A key may go on in the next ranges: of its first and last key each range hands on the
    least and greatest text, two rows for each task, and the passages of these keys that
    found no other text in their range wait for the comparison of all ranges.
    """
    spark = passage.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "text_key", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of the last key that go on to the next batch: all while only one text has
        # it, else the least and greatest text, marked as done
        held: list[np.ndarray] | None = None
        is_first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns] + [np.zeros(batch.num_rows, bool)]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            key, text, start, done = rows
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(begins[1:], len(key))
            many = text[begins] != text[ends - 1]
            hit = np.repeat(many, ends - begins) & ~done
            if hit.any():
                yield _found(None, text[hit], start[hit])
            if is_first and len(begins) > 1:
                yield from _edge(*(c[: ends[0]] for c in rows))
                is_first = False
            at = np.array([begins[-1], ends[-1] - 1]) if many[-1] else np.arange(begins[-1], ends[-1])
            held = [c[at] for c in rows]
            held[3][:] = many[-1]
        if held is not None:
            yield from _edge(*held)

    found = stored(passage.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order).mapInArrow(run, _FOUND), "suffix-marks")
    spread: dict[int, tuple[int, int]] = {}
    for r in found.where("high is not null").collect():
        low, high = spread.get(r["key"], (r["text_key"], r["high"]))
        spread[r["key"]] = min(low, r["text_key"]), max(high, r["high"])
    keys = [k for k, (low, high) in spread.items() if low != high]
    return found.where(F.col("high").isNull() & (F.col("key").isNull() | F.col("key").isin(keys))).select("text_key", "start", (F.col("start") + LEAST).alias("end"))


_FOUND = "key bigint, text_key bigint, start int, high bigint"


def _found(key: np.ndarray | None, text: np.ndarray, start: np.ndarray | None, high: np.ndarray | None = None) -> pa.RecordBatch:
    """Passages that are repeated (no key), or wait (key), or a range's edge (key and high)."""
    n = len(text)
    cols = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in ((key, pa.int64()), (text, pa.int64()), (start, pa.int32()), (high, pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=["key", "text_key", "start", "high"])


def _edge(key: np.ndarray, text: np.ndarray, start: np.ndarray, done: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a range hands on of its first or last key, from the rows in order of the text."""
    yield _found(key[:1], text[:1], None, text[-1:])
    if text[0] == text[-1]:
        yield _found(key[~done], text[~done], start[~done])


def joined_spans(marks: DataFrame) -> DataFrame:
    """(text_key, start, end): marks that touch or overlap become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy().astype(np.int64) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            key, start, end = rows
            text = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) << 32
            far = np.maximum.accumulate(text + end)
            begins = np.flatnonzero(np.concatenate([[True], (text + start)[1:] > far[:-1]]))
            last = np.append(begins[1:], len(key)) - 1
            spans = [key[begins], start[begins], (far - text)[last]]
            held = [c[-1:] for c in spans]
            yield _spans(*(c[:-1] for c in spans))
        if held is not None:
            yield _spans(*held)

    return marks.repartition("text_key").sortWithinPartitions("text_key", "start", "end").select("text_key", "start", "end").mapInArrow(run, "text_key bigint, start int, end int")


def _spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["text_key", "start", "end"])


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word): maximal spans of words (from 0, end exclusive, as split
    at blanks, A-Z in lower case) that are covered by passages of LEAST words or more that
    also occur in another document; one row for each span of each row of ``df``.

    Null, empty and shorter texts give no rows. Rows that repeat an id with the same text
    are copies like any others. A passage that only repeats within its own text is not
    marked. Other columns are dropped.
    """
    return keyed_repeats(df, id_col, text_col).drop("text_key")


def keyed_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`repeats` with ``text_key``, which tells apart texts that share an id."""
    docs = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.diff(Words(batch.column(2)).first)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64))], names=["id", "text_key", "n"])

    kind = df.schema[id_col].dataType.simpleString()
    slim = stored(arrow_map(docs.select("id", "text_key", "text"), count, f"id {kind}, text_key bigint, n bigint"), "suffix-docs")
    names = slim.groupBy("text_key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"))
    places = repeated_places(docs).join(names.select("text_key", "id"), "text_key")
    passage = stored(candidates(docs, places), "suffix-rows")
    whole = names.where((F.col("copies") > 1) & (F.col("n") >= LEAST)).select("text_key", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"))
    spans = joined_spans(repeated(passage).unionByName(whole))
    return slim.join(spans, "text_key").select(F.col("id").alias(id_col), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "text_key")


def passages(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, passage): the spans of :func:`keyed_repeats`, or of :func:`repeats`
    where no id has two texts, as code points of the texts, with their words, one row for
    each. Ids may be null or repeat."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, s, e in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            m = [x.span() for x in WORD.finditer(text)]
            out.append((m[s][0], m[e - 1][1], text[m[s][0] : m[e - 1][1]]))
        cols = [*zip(*out, strict=True)] or [[], [], []]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, (pa.int64(), pa.int64(), pa.string()))], names=["id", "start", "end", "passage"])

    # a text that an id holds twice has its spans twice already
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).distinct()
    same = F.col("id").eqNullSafe(F.col("own"))
    if "text_key" in spans.columns:
        same &= F.xxhash64("text") == F.col("text_key")
    joined = texts.join(spans.withColumnRenamed(id_col, "own"), same).select("id", "text", "start_word", "end_word")
    return arrow_map(joined, run, f"id {df.schema[id_col].dataType.simpleString()}, start bigint, end bigint, passage string").withColumnRenamed("id", id_col)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))
