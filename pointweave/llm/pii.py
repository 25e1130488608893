"""Operator 2: personal data by fixed patterns and by what terms give away.

Fixed patterns give the base spans; each distinct value is a protected entity, and so
is each kind. Over the whole corpus, words near mentions of an entity are counted with
it. With N words in the corpus, p(e) is the share of them that stand near a mention of
entity e, and p(e | t) the share of the occurrences of term t that do, so both are exact
shares. A term discloses an entity when knowing it removes at least ``ALPHA`` of the
entity's information content: PMI(t; e) >= ALPHA * IC(e), with enough distinct contexts
behind it. Every occurrence of such a term, in any document, becomes a span; ``sanitise``
generalises it, or removes it at full disclosure.

A term is a word without outer punctuation, A-Z in lower case. Terms are counted and looked
up by 64-bit hashes, whole Arrow batches at a time.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.common import Words, arrow_map, documents, hash_spans, pieces, stored, text_buffers

#: Kinds in order, and the base patterns.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words looked at on either side of a mention; least distinct contexts of a pair; share
#: of an entity's information that a disclosing word removes; least letters of a word.
NEAR, SUPPORT, ALPHA, LETTERS = 8, 3, 0.9, 4
#: Terms that one pass over the documents looks for (8 bytes each on a worker).
TERMS_A_PASS = 4_000_000
_LOWER = {c: c + 32 for c in range(65, 91)}
PUNCTUATION = """!"#$%&'()*+,-./:;<=>?[\\]^_`{|}~"""
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in PUNCTUATION]] = True

Span = tuple[int, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each at sign so that long runs
    without one cost nothing."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by kind, then start."""
    out: list[Span] = [(s, e, 0) for s, e in emails(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def value(text: str, span: Span) -> str:
    """An entity: its kind and its value without case, blanks and punctuation of writing."""
    raw = text[span[0] : span[1]]
    return f"{KINDS[span[2]]}:{raw.lower() if span[2] < 2 else _digits(raw)}"


def terms(piece: str) -> str | None:
    """The term of a word: A-Z in lower case, outer punctuation off; None if it has too few
    letters, or any digit or at sign."""
    t = piece.strip(PUNCTUATION).translate(_LOWER)
    return t if sum(c.isalpha() for c in t) >= LETTERS and not any(c.isdigit() or c == "@" for c in t) else None


def term_hash(t: str) -> int:
    """A signed 64-bit hash, the same on every worker."""
    return int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def contexts(text: str, spans: list[Span]) -> list[dict]:
    """For each mention its entity and the terms within NEAR words, without the words of
    any mention, and a hash of them. Words are whole, however long; one that a mention is
    part of is cut at the mention. ``places``: of each word looked at
    its number and its term or None; a word on both sides of the mention comes twice."""
    words = [m.span() for m in WORD.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    begun, ended = sorted(s for s, _, _ in spans), sorted(e for _, e, _ in spans)
    known: dict[int, str | None] = {}

    def term(i: int) -> str | None:
        if i not in known:
            known[i] = terms(text[starts[i] : ends[i]])
        return known[i]

    out = []
    for s, e, k in spans:
        i, j = bisect_left(starts, s), bisect_right(ends, e)
        before, after = range(max(0, i - NEAR), i), range(j, min(j + NEAR, len(words)))
        places = []
        # a rest that holds another mention, so a digit or an at sign, is no term
        if before and ends[i - 1] > s:
            before = before[:-1]
            at = bisect_right(ended, s)
            places.append((i - 1, None if at and ended[at - 1] > starts[i - 1] else terms(text[starts[i - 1] : s])))
        if after and starts[j] < e:
            after = after[1:]
            at = bisect_left(begun, e)
            places.append((j, None if at < len(begun) and begun[at] < ends[j] else terms(text[e : ends[j]])))
        places += [(n, term(n)) for part in (before, after) for n in part]
        near = sorted({t for _, t in places if t})
        out.append({"entity": value(text, (s, e, k)), "kind": KINDS[k], "terms": near, "context": term_hash(" ".join(near)), "places": places})
    return out


def occurrences(text: str, spans: list[Span]) -> Counter:
    """Counts by (entity, term or None for any word, context): every word near a mention
    counts once for each entity, under the first mention that it is near, and has a 0 under
    further contexts. Entities are values and kinds (``kind:*``). A word that is only part
    of a word of the text (cut at a mention) is no occurrence of its term."""
    words = [m.group() for m in WORD.finditer(text)]
    seen: set[tuple[str, int]] = set()
    out: Counter = Counter()
    for c in contexts(text, spans):
        for entity in (c["entity"], c["kind"] + ":*"):
            for place, term in c["places"]:
                fresh = (entity, place) not in seen
                seen.add((entity, place))
                out[entity, None, 0] += fresh
                if term is not None:
                    out[entity, term, c["context"]] += fresh and terms(words[place]) == term
    return out


def _suspects(texts: pa.Array) -> np.ndarray:
    """Rows with an at sign, or at least four digits."""
    raw, offsets = text_buffers(texts)
    if not len(raw):
        return np.zeros(len(texts), bool)
    row = lambda at: np.searchsorted(offsets, at, side="right") - 1
    found = np.bincount(row(np.flatnonzero((raw >= 48) & (raw <= 57))), minlength=len(texts)) >= 4
    found[row(np.flatnonzero(raw == 64))] = True
    return found


_SPAN_FIELDS = ("start", "end", "kind", "removed")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("removed", pa.bool_())]))
_SPANS_SQL = "array<struct<start:bigint,end:bigint,kind:int,removed:boolean>>"


class Terms:
    """The terms of all words of a text column: their place in ``Words``, byte places
    without outer punctuation, and hashes; words of punctuation alone have none."""

    def __init__(self, texts: pa.Array):
        w = self.words = Words(texts)
        solid = np.flatnonzero(~_PUNCT[w.raw])
        edge = np.concatenate([solid, [len(w.raw)]])
        start = edge[np.searchsorted(solid, w.start)]
        self.word = np.flatnonzero(start < w.end)
        self.start = start[self.word]
        self.end = solid[np.searchsorted(solid, w.end[self.word]) - 1] + 1
        self.row = w.doc[self.word]
        self.hash = hash_spans(w.raw, self.start, self.end)

    def code_points(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of chosen terms in code points of their texts."""
        heads = np.concatenate([[0], np.cumsum((self.words.raw & 0xC0) != 0x80)])
        first = heads[self.words.offsets[self.row[chosen]]]
        return heads[self.start[chosen]] - first, heads[self.end[chosen]] - first


def mentions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, hash, context, n): :func:`occurrences` of all texts, summed in each
    chunk; the hash is that of :class:`Terms`, null without a term."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found: Counter = Counter()
        for i in np.flatnonzero(_suspects(batch.column(0))):
            text = batch.column(0)[int(i)].as_py()
            if spans := base_spans(text):
                found.update(occurrences(text, spans))
        if not found:
            return None
        entity, term, context = (list(c) for c in zip(*found, strict=True))
        distinct = pa.array(term, pa.string()).dictionary_encode()
        raw, offsets = text_buffers(distinct.dictionary)
        codes = pa.array(hash_spans(raw, offsets[:-1], offsets[1:]).view(np.int64)).take(distinct.indices)
        return pa.RecordBatch.from_arrays([pa.array(entity), distinct.dictionary_decode(), codes, pa.array(context, pa.int64()), pa.array([*found.values()], pa.int64())], names=["entity", "term", "hash", "context", "n"])

    return arrow_map(df.select(F.col(text_col).cast("string").alias("__text")), run, "entity string, term string, hash bigint, context bigint, n bigint")


def pairs(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, term, hash, n_joint, n_entity): occurrences of the term near a mention of the
    entity, and of any word, for pairs with ``support`` distinct contexts. All is summed
    map-side first, so a value with a third of all mentions is no hot task."""
    near = found.where("term is not null").groupBy("entity", "term", "hash", "context").agg(F.sum("n").alias("n"))
    joint = near.groupBy("entity", "term", "hash").agg(F.sum("n").alias("n_joint"), F.count("*").alias("n_contexts")).where(F.col("n_contexts") >= support)
    totals = found.where("term is null").groupBy("entity").agg(F.sum("n").alias("n_entity"))
    return joint.join(totals, "entity").select("entity", "term", "hash", "n_joint", "n_entity")


def term_counts(df: DataFrame, wanted: np.ndarray, text_col: str = "text") -> DataFrame:
    """(hash, n): how often each wanted term (sorted hashes) occurs in the whole corpus, and
    under a null hash the number of all words."""
    held = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = held.value, 0
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in pieces(batch):
                t = Terms(part.column(0))
                words += len(t.words.start)
                at, hit = _lookup(known, t.hash)
                counts += np.bincount(at[hit], minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*known[some].view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[some].tolist(), words], pa.int64())], names=["hash", "n"])

    return df.select(F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def _lookup(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted ``known``, whether each is there)."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return at, known[at] == wanted


def blocks(df: DataFrame, *columns: str) -> Iterator[DataFrame]:
    """The distinct rows of the columns, by ranges of the first, a hash, so that the driver
    and the workers hold about TERMS_A_PASS at a time."""
    keyed = df.select(*columns).distinct()
    n = max(1, math.ceil(keyed.count() / TERMS_A_PASS))
    for b in range(n):
        yield keyed.where(F.pmod(F.xxhash64(columns[0]), F.lit(n)) == b)


def disclosing(df: DataFrame, text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(hash, term, share): words that disclose an entity; ``share`` of its information
    content, 1 if the word never occurs without it.

    PMI / IC is 1 - log p(e | t) / log p(e); see the head of this file.
    """
    found = stored(pairs(mentions(df, text_col), support), "pii-pairs")
    counts = None
    for block in blocks(found, "hash"):
        wanted = np.sort(block.toArrow().column("hash").combine_chunks().to_numpy().view(np.uint64))
        part = stored(term_counts(df, wanted, text_col), "pii-terms")
        counts = part if counts is None else counts.unionByName(part)
    words = counts.where("hash is null").agg(F.max("n")).first()[0] or 0
    rare = F.least(F.col("n_entity") / F.lit(float(max(words, 1))), F.lit(0.5))  # an entity near every other word carries a bit at least
    share = 1 - F.log(F.col("n_joint") / F.col("n")) / F.log(rare)
    return found.where("n_joint > 0").join(counts, "hash").select("hash", "term", share.alias("share")).where(F.col("share") >= alpha).groupBy("hash").agg(F.first("term").alias("term"), F.max("share").alias("share"))


def _marked(df: DataFrame, codes: np.ndarray, full: np.ndarray, first: bool, last: bool) -> DataFrame:
    """One pass over (id, text, text again or earlier spans): base spans if ``first``, and
    the spans of terms with the sorted hashes ``codes``; ``full`` of them are removed, not
    generalised. The last one gives (id, spans, sanitised)."""
    held = df.sparkSession.sparkContext.broadcast((codes, full))
    kind = df.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, removed = held.value
        texts = batch.column(1)
        spans: list[list] = [[] for _ in range(batch.num_rows)] if first else [[tuple(s.values()) for s in own] for own in batch.column(2).to_pylist()]
        if first:
            for i in np.flatnonzero(_suspects(texts)):
                spans[i] = [(s, e, k, False) for s, e, k in base_spans(texts[int(i)].as_py())]
        if len(known):
            t = Terms(texts)
            at, hit = _lookup(known, t.hash)
            chosen = np.flatnonzero(hit)
            taken = {i: sorted(s[:2] for s in spans[i] if s[2] < 4) for i in np.unique(t.row[chosen]).tolist()}
            reach = {i: [*accumulate((e for _, e in own), max)] for i, own in taken.items()}
            for i, s, e, gone in zip(t.row[chosen].tolist(), *(c.tolist() for c in t.code_points(chosen)), removed[at[chosen]].tolist(), strict=True):
                before = bisect_left(taken[i], (e,))
                if not (before and reach[i][before - 1] > s):
                    spans[i].append((s, e, 4, gone))
        cols = [batch.column(0)]
        if last:
            clean = texts
            some = [i for i, own in enumerate(spans) if own]
            if some:
                out = texts.to_pylist()
                for i in some:
                    out[i] = sanitise(out[i], spans[i])
                clean = pa.array(out, texts.type)
            for own in spans:
                own.sort(key=lambda s: (s[2], s[0]))
        else:
            cols.append(texts)
        cols.append(pa.array([[dict(zip(_SPAN_FIELDS, s, strict=True)) for s in own] for own in spans], _SPANS))
        return pa.RecordBatch.from_arrays([*cols, clean] if last else cols, names=["id", "spans", "sanitised"] if last else ["id", "text", "spans"])

    return arrow_map(df, run, f"id {kind}, spans {_SPANS_SQL}, sanitised string" if last else f"id {kind}, text string, spans {_SPANS_SQL}")


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(id, spans array of (start, end, kind, removed), sanitised), one row for each row of
    ``df``; code points, end exclusive, by kind as in KINDS, then start; ``sanitised`` is
    the text after :func:`sanitise`. Base spans always stay; term spans don't overlap them.

    Null and empty texts have no spans and stay as they are; repeated rows are each marked,
    and count as often as they come, as do terms of equal share; an empty table gives an
    empty one; other columns are dropped.
    """
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = stored(disclosing(out, "text", alpha, support), "pii-disclosing")
    parts = [*blocks(found, "hash", "share")]
    for i, part in enumerate(parts):
        got = part.toArrow()
        codes = got.column("hash").combine_chunks().to_numpy().view(np.uint64)
        order = np.argsort(codes)
        marked = _marked(out, codes[order], got.column("share").combine_chunks().to_numpy()[order] >= 1, i == 0, i == len(parts) - 1)
        out = stored(marked, "pii-marked") if i < len(parts) - 1 else marked
    return out.withColumnRenamed("id", id_col)


def sanitise(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    """Base spans become their kind in brackets; disclosing terms become [TERM], or go where
    they are marked as removed (full disclosure). Overlapping spans are one, of the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end, kind, removed in sorted(spans):
        if start >= at:
            out.append(text[at:start])
            if not removed:
                out.append(f"[{KINDS[kind].upper()}]")
        at = max(at, end)
    return "".join([*out, text[at:]])


def as_text(spans, base_only: bool = False):
    """Column of kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    chosen = F.filter(spans, lambda s: s["kind"] < 4) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of :func:`detect` over the documents."""
    found = detect(documents(spark, sf_dir))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(n(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(as_text(F.col("spans"), True), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), n(4).alias("n_term"), F.size(F.filter("spans", lambda s: s["kind"] < 4)).cast("long").alias("n_base"), F.sha2(F.coalesce("sanitised", F.lit("")), 256).alias("sanitised_sha256"))
