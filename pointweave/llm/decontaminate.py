"""Operator 4: benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is cut into e + 1 pieces: any passage within
e edits of it holds at least one piece unchanged. All pieces of a block of items form one
automaton that reports their exact hits in a text; each hit names a place where the item
may lie, and Myers' bit-parallel algorithm gives the least edit distance there. Texts and
items are compared in lower case with runs of blanks as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pointweave.llm.common import arrow_map, documents

#: Edits allowed per character of an item; least characters of a piece (a longer piece
#: lowers the budget) and of an item (a shorter one counts only as whole words, unchanged).
RATE, LEAST_PIECE, LEAST_ITEM = 0.06, 12, 24
#: Characters of items in one pass over the documents, which bounds a worker's automaton.
ITEM_CHARS = 1_000_000
WORD = re.compile(r"\S+")


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE) -> int:
    return max(0, min(int(rate * length), length // LEAST_PIECE - 1))


def cut(item: str, e: int) -> list[tuple[int, str]]:
    """(place, piece): e + 1 pieces of lengths as equal as can be."""
    edges = [len(item) * i // (e + 1) for i in range(e + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Pattern:
    """An item prepared for Myers' algorithm."""

    def __init__(self, text: str):
        self.m = len(text)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(text):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def ends(self, text: str) -> Iterator[int]:
        """The least edit distance between the pattern and any part of ``text`` that ends
        at each character."""
        mask, top = (1 << self.m) - 1, 1 << (self.m - 1)
        plus, minus, score = mask, 0, self.m
        get = self.bits.get
        for c in text:
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (~(xh | plus) & mask)
            down = plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1) & mask
            plus = ((down << 1) & mask) | (~(xv | up) & mask)
            minus = up & xv
            yield score


class Items:
    """A block of normalised items with the automaton of their pieces."""

    def __init__(self, items: list[tuple[tuple, str]], rate: float):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.budgets = [budget(len(t), rate) for t in self.texts]
        self.forward: dict[int, Pattern] = {}
        self.backward: dict[int, Pattern] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.texts):
            for at, piece in cut(t, self.budgets[n]):
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, distance) of the best match of each item in a normalised
        text, the leftmost of equals."""
        if not self.texts or not text:
            return []
        places: dict[int, list[int]] = {}
        for end, (length, owners) in self.automaton.iter(text):
            for n, at in owners:
                places.setdefault(n, []).append(end + 1 - length - at)
        out = []
        for n, starts in places.items():
            best = self._best(n, text, sorted(set(starts)))
            if best:
                out.append((n, *best))
        return sorted(out, key=lambda r: r[0])

    def _best(self, n: int, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        item, e = self.texts[n], self.budgets[n]
        m = len(item)
        whole = lambda s: m >= LEAST_ITEM or (text[s - 1 : s] in ("", " ") and text[s + m : s + m + 1] in ("", " "))
        for s in starts:  # an exact copy can't be beaten
            if s >= 0 and text.startswith(item, s) and whole(s):
                return s, s + m, 0
        if not e:
            return None
        best, done = None, None
        for s in starts:
            if done is not None and s - done <= e:
                continue  # inside what was verified for an earlier hit
            done = s
            lo, hi = max(0, s - 2 * e), min(len(text), s + m + 2 * e)
            p = self.forward.setdefault(n, Pattern(item))
            scores = np.fromiter(p.ends(text[lo:hi]), np.int64, hi - lo)
            at = int(scores.argmin()) if len(scores) else 0
            if len(scores) and scores[at] <= e and (best is None or scores[at] < best[2]):
                end, d = lo + at + 1, int(scores[at])
                r = self.backward.setdefault(n, Pattern(item[::-1]))
                back = np.fromiter(r.ends(text[max(0, end - m - e) : end][::-1]), np.int64)
                length = int(np.flatnonzero(back == d)[0]) + 1
                best = (end - length, end, d)
        return best


def _outward(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normalised text as spans of the text itself."""
    starts, place, n = [], [], 0
    for m in WORD.finditer(text):
        starts.append(n)
        place.append((m.start(), m.end()))
        n += len(m[0].lower()) + 1
    at = np.array(starts)
    out = []
    for s, e in spans:
        i, j = int(np.searchsorted(at, s, side="right")) - 1, int(np.searchsorted(at, e - 1, side="right")) - 1
        out.append((min(place[i][0] + s - starts[i], place[i][1]), min(place[j][0] + e - starts[j], place[j][1])))
    return out


@lru_cache(maxsize=2)
def _prepared(items: tuple[tuple[tuple, str], ...], rate: float) -> Items:
    return Items([*items], rate)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[tuple[tuple, str], ...]]:
    """(ids, text): the distinct normalised items with all their ids, ITEM_CHARS at a time;
    the driver holds one block. Items whose texts differ only in case and blanks are one."""
    held, size = [], 0
    text = F.trim(F.regexp_replace(F.lower(F.col(text_col).cast("string")), r"(?U)\s+", " "))
    rows = benchmark.where(F.col(text_col).isNotNull()).groupBy(text.alias("key")).agg(F.array_sort(F.collect_set(F.struct(F.col(id_col).alias("id")))).alias("ids"), F.min(text_col).alias("text")).orderBy("key")
    for r in rows.toLocalIterator():
        t = normal(r["text"])
        if not t:
            continue
        if held and size + len(t) > ITEM_CHARS:
            yield tuple(held)
            held, size = [], 0
        held.append((tuple(x["id"] for x in r["ids"]), t))
        size += len(t)
    if held:
        yield tuple(held)


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, item_col: str = "item_id") -> DataFrame:
    """(id, item_id, start, end, distance, budget): each item's best match in each row of
    ``df`` that holds it within its budget; code points of the text, end exclusive. An item
    that a row holds in several places gives one row, for the nearest, then leftmost.

    Rows without a match, null and empty texts give nothing; repeated rows repeat; items of
    one normalised text are each found, under their own ids, once for each id; null and
    blank items match nothing; those under LEAST_ITEM normalised characters match
    unchanged, as whole words. Ids may be of any type. Other columns are dropped.
    """
    spark = df.sparkSession
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {item_kind}, start bigint, end bigint, distance int, budget int"
    slim = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    out = None
    for block in blocks(benchmark, item_col):
        held = spark.sparkContext.broadcast((block, rate))
        id_type = to_arrow_type(benchmark.schema[item_col].dataType)

        def run(batch: pa.RecordBatch, held=held, id_type=id_type) -> pa.RecordBatch | None:
            items = _prepared(*held.value)
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = items.search(normal(text))
                for (n, _, _, d), (s, e) in zip(found, _outward(text, [(s, e) for _, s, e, _ in found]) if found else [], strict=True):
                    rows += [(i, item, s, e, d, items.budgets[n]) for item in items.ids[n]]
            if not rows:
                return None
            at, *columns = zip(*rows, strict=True)
            kinds = (id_type, pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, columns, kinds)], names=[id_col, "item_id", "start", "end", "distance", "budget"])

        part = arrow_map(slim, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``df`` without a match of any item, all columns kept. Null and empty texts
    stay; repeated rows stay or go together; an empty benchmark drops nothing; items match as
    in :func:`matches`."""
    spark = df.sparkSession
    at = df.columns.index(text_col)
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast((block, rate))

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            items = _prepared(*held.value)
            return batch.filter(pa.array([not items.search(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        df = arrow_map(df, run, df.schema)
    return df


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
