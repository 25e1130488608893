"""Operator 8: secrets by fixed patterns and a battery of randomness tests.

Fixed patterns give the base spans. Beside them every run of 20 or more key
characters is a candidate: its encoding (hex, base32, alphanumeric, base64, url
base64) is inferred, and three tests are computed over that alphabet: chi-squared
uniformity, runs, and lag-1 serial correlation. Each is read in two ways. Against
uniform random characters, a candidate whose least p-value is below ``REJECT`` is
not random, and its p-value is 1. Otherwise the three p-values against ordinary
words (as uniform, as many runs, as little correlation) are combined into one by
Fisher's rule, and a candidate counts when that survives Benjamini-Hochberg
control within its length class, over all candidates of the table. Only -log10 of
a p-value is ever carried, so no length underflows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.common import arrow_map, documents, stored, text_buffers

#: The base patterns, their order, and their least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_RUN = 6, 20, 20
#: An equals sign ends a run, except as padding: a key behind a name is a run of its own.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: The alphabets in the order in which they are tried.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_PLACE = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS}
_VALUE = {name: np.array([chars.find(chr(c)) for c in range(128)]) for name, chars in ALPHABETS}
#: Chance that two characters of ordinary words agree; changes of character class a
#: character in them.
COINCIDENCE, CHANGES = 0.065, 0.04
#: p-value below which randomness is rejected; rate of false discoveries; histogram bins of
#: -log10 p and their width (the last holds all beyond).
REJECT, FDR, BINS, PER_BIN = 1e-4, 1e-3, 600, 0.1
_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True

Span = tuple[int, int, int]


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _log_phi(z: float) -> float:
    """Natural log of the normal distribution function, also far out."""
    if z > -30:
        return math.log(_phi(z))
    return -z * z / 2 - math.log(-z * math.sqrt(2 * math.pi)) + math.log1p(-1 / (z * z))


def _log_poisson_tail(k: int, mean: float) -> float:
    """Natural log of P(X >= k), by its first terms relative to the first of all."""
    if k <= mean:
        return 0.0
    total, term = 0.0, 1.0
    for i in range(k, k + 100):
        total += term
        term *= mean / (i + 1)
    return min(0.0, -mean + k * math.log(mean) - math.lgamma(k + 1) + math.log(total))


def infer(token: str) -> str | None:
    """The first alphabet that holds the token without its padding; None without
    both digits and letters or both cases, which plain words and numbers lack."""
    body = token.rstrip("=")
    digits, upper, lower = any(c.isdigit() for c in body), any(c.isupper() for c in body), any(c.islower() for c in body)
    if digits + upper + lower < 2 or not (upper or lower):
        return None
    return next((name for name, _ in ALPHABETS if all(c in _PLACE[name] for c in body)), None)


def _classes(body: str) -> np.ndarray:
    raw = np.frombuffer(body.encode("ascii"), np.uint8)
    return (raw <= 57) * (raw >= 48) + 2 * ((raw <= 90) & (raw >= 65)) + 4 * ((raw <= 122) & (raw >= 97))


def battery(token: str, name: str) -> float:
    """-log10 of a token's p-value against ordinary words; 0 where its randomness is
    rejected. See the head of this file."""
    body = token.rstrip("=")
    at = _VALUE[name][np.frombuffer(body.encode("ascii"), np.uint8)]
    n, a = len(at), len(_PLACE[name])
    counts = np.bincount(at, minlength=a)
    chi = float((counts * counts).sum()) * a / n - n
    # uniform random characters: the statistic's z, runs about the median, correlation 0
    z_chi = (chi - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n)
    high = 2 * at >= a
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        mean = 1 + 2 * n1 * n2 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        z_runs = (1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)
    else:
        z_runs = -math.sqrt(n)
    dev = at - at.mean()
    spread = float((dev * dev).sum())
    serial = float((dev[1:] * dev[:-1]).sum()) / spread if spread else 1.0
    if 3 * min(_phi(-z_chi), 2 * _phi(-abs(z_runs)), 2 * _phi(-abs(serial) * math.sqrt(n))) < REJECT:
        return 0.0
    # ordinary words: few characters, used often; ...
    excess = a * COINCIDENCE - 1
    if excess > 0:
        l_chi = _log_phi((chi - (a - 1) - (n - 1) * excess) / math.sqrt(2 * (a - 1) + 4 * n * excess))
    else:  # ... an alphabet so small that words hardly fit into it
        l_chi = -n * math.log(2)
    # ... long runs of one class of characters; ...
    kind = _classes(body)
    l_runs = _log_poisson_tail(int((kind[1:] != kind[:-1]).sum()), CHANGES * n)
    # ... and so neighbours that lie in one part of the alphabet: the share of the spread
    # that lies between the classes carries over as far as classes seldom change
    between, random_changes = 0.0, 1.0
    for c in np.unique(kind):
        own = kind == c
        between += float(dev[own].sum()) ** 2 / int(own.sum())
        random_changes -= (int(own.sum()) / n) ** 2
    words = between / spread * (1 - CHANGES / random_changes) if spread and random_changes > CHANGES else 0.0
    l_serial = _log_phi((serial - words) * math.sqrt(n))
    s = -(l_chi + l_runs + l_serial)
    return max(0.0, (s - math.log1p(s + s * s / 2)) / math.log(10))  # Fisher's rule for three


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin of -log10 p) of untaken key-like runs."""
    out = []
    begun = [s for s, _, _ in base]  # in order; the furthest end of each and all before it:
    ended = list(accumulate((e for _, e, _ in base), max))
    for m in RUN.finditer(text):
        at = bisect_left(begun, m.end())
        if at and ended[at - 1] > m.start():
            continue
        name = infer(m[0])
        if name:
            out.append((m.start(), m.end(), min(6, (m.end() - m.start()).bit_length()), min(BINS - 1, int(battery(m[0], name) / PER_BIN))))
    return out


def _suspects(batch: pa.Array) -> np.ndarray:
    """Rows that may hold any span: a long key-like run, or a sign of assignment."""
    raw, offsets = text_buffers(batch)
    if not len(raw):
        return np.zeros(len(batch), bool)
    row = lambda at: np.searchsorted(offsets, at, side="right") - 1
    found = np.zeros(len(batch), bool)
    found[row(np.flatnonzero((raw == 58) | (raw == 61)))] = True
    gaps = np.concatenate([[-1], np.flatnonzero(~_KEY[raw]), [len(raw)]])
    long = np.flatnonzero(np.diff(gaps) > LEAST_RUN)
    for lo, hi in zip(row(gaps[long] + 1), row(gaps[long + 1] - 1), strict=True):
        found[lo : hi + 1] = True  # a run may cross from one text into the next: look at all
    return found


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base array of (start, end, kind), found array of (start, end, size, bin)): one row for each row of ``df``; null and empty texts have empty arrays."""
    kind = df.schema[id_col].dataType.simpleString()
    base_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
    found_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("size", pa.int32()), ("bin", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        bases: list[list] = [[]] * batch.num_rows
        found: list[list] = [[]] * batch.num_rows
        for i in np.flatnonzero(_suspects(texts)):
            text = texts[int(i)].as_py() or ""
            base = base_spans(text)
            bases[i] = [{"start": s, "end": e, "kind": k} for s, e, k in base]
            found[i] = [{"start": s, "end": e, "size": z, "bin": b} for s, e, z, b in candidates(text, base)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, base_t), pa.array(found, found_t)], names=[id_col, "base", "found"])

    schema = f"`{id_col}` {kind}, base array<struct<start:bigint,end:bigint,kind:int>>, found array<struct<start:bigint,end:bigint,size:int,bin:int>>"
    return arrow_map(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")), run, schema)


def cutoffs(scanned: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each length class the least bin of -log10 p that Benjamini-Hochberg still admits,
    over all candidates; classes without one are absent. A p-value counts as the largest
    of its bin. The histogram has at most 7 x BINS rows."""
    rows = scanned.select(F.explode("found").alias("c")).groupBy("c.size", "c.bin").agg(F.count("*").alias("n")).collect()
    out = {}
    for size in {r["size"] for r in rows}:
        own = sorted((r["bin"], r["n"]) for r in rows if r["size"] == size)
        total, seen = sum(n for _, n in own), 0
        for b, n in reversed(own):
            seen += n
            if 10 ** (-b * PER_BIN) <= fdr * seen / total:
                out[size] = b
    return out


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(id, spans array of (start, end, kind)), one row for each row of ``df``, code points,
    end exclusive, by start, then kind as in KINDS; base spans always stay.

    Nulls and empty texts: no spans. Repeated rows are each scanned. Without candidates
    only base spans remain. Other columns are dropped.
    """
    scanned = stored(scan(df, id_col, text_col), "secrets")
    cut = cutoffs(scanned, fdr)
    spans = F.col("base")
    if cut:
        least = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
        good = F.filter("found", lambda c: c["bin"] >= F.coalesce(least[c["size"]], F.lit(BINS)))
        spans = F.array_sort(F.concat("base", F.transform(good, lambda c: F.struct(c["start"], c["end"], F.lit(3).alias("kind")))), _by_start)
    return scanned.select(id_col, spans.alias("spans"))


def _by_start(a, b):
    lower = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"]))
    return F.when(lower, F.lit(-1)).when((a["start"] == b["start"]) & (a["kind"] == b["kind"]), F.lit(0)).otherwise(F.lit(1))


def as_text(spans, base_only: bool = False):
    """Column of kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    chosen = F.filter(spans, lambda s: s["kind"] < 3) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each span, or chain of overlapping spans, replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, fdr: float = FDR) -> DataFrame:
    """``df`` with the spans of :func:`detect` replaced in its texts, all columns kept;
    ``length_col``, if given, becomes the new length in code points (null for a null text).
    Null and empty texts stay as they are; repeated rows are each redacted."""
    cut = cutoffs(stored(scan(df, id_col, text_col), "secrets"), fdr)
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at)
        suspects = np.flatnonzero(_suspects(texts))
        if not len(suspects):
            return batch
        out = texts.to_pylist()
        for i in suspects:
            text = out[i] or ""
            spans = base_spans(text)
            spans += [(s, e, 3) for s, e, z, b in candidates(text, spans) if b >= cut.get(z, BINS)]
            out[i] = redact(out[i], spans)
        return batch.set_column(at, batch.schema.field(at), pa.array(out, texts.type))

    done = arrow_map(df, run, df.schema)
    if length_col:
        done = done.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
    return done.select(*df.columns)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of :func:`detect` over the documents."""
    found = detect(documents(spark, sf_dir))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(as_text(F.col("spans"), True), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), n(3).alias("n_random"))
