"""Operator 1: language identification with interpolated Kneser-Ney character models.

A text becomes a row of lower-case letters with single blanks between words. One model of
``ORDER`` characters per language is trained on a bounded sample of labelled rows, and lies
in sorted arrays of its own packed n-gram keys with their log-probabilities and back-off
weights; distinct n-grams of a batch of texts are looked up once. The language of lowest cross-entropy per character wins; it is rejected when that is far
above what most held-back labelled rows of the language show. Every text is scored whole.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.common import arrow_map, documents, fold, stored

#: Characters of an n-gram: four of 16 bits fill a key.
ORDER = 4
#: Expected rows of each language in the sample that fits its model; one in four of them
#: only calibrates. Languages that are learned, the commonest labels. Both bound the model
#: and what the driver sees.
SAMPLE_ROWS, LANGUAGES = 1600, 256
#: Symbols of a text that count as evidence, whatever its length. The symbols of a text
#: aren't independent: its cross-entropy stops closing in on the language's own when
#: its topic and author are settled, so that beyond about this many symbols neither the
#: odds between languages nor the deviation from the usual may go on growing as if they were.
#: The cross-entropy itself is always that of the whole text.
EVIDENCE = 2000
#: Deviations above a language's usual cross-entropy at which a text is rejected, at least.
REJECT = 6.0
#: Share of the held-back rows that the limit may reject; held-back rows from which a
#: language's own deviation is taken; least deviation in bits per root character.
FALSE_REJECTION, OWN_ROWS, LEAST_DEVIATION = 0.01, 20, 0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each 16-bit unit its symbol: itself for letters and marks, else 0. Characters
    beyond them are folded into 16 bits, and count as letters if Unicode says so."""
    return np.array([c if unicodedata.category(chr(c))[0] in "LM" else 0 for c in range(1 << 16)], np.uint64)


def lettered(texts: pa.Array) -> np.ndarray:
    """Which texts hold a letter; marks alone are none."""
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, starts): every text opens with ORDER - 1 blanks; runs of
    anything but letters and marks are one blank."""
    parts = [(t or "").lower() for t in texts.to_pylist()]
    joined = "\n".join(["", *parts, ""])
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    wide = cp >= 1 << 16
    sym = _letters()[np.where(wide, 0, cp)]
    if wide.any():
        far = cp[wide]
        known = {int(c): ((int(c) * 40503) & 0xFFFF or 1) if chr(int(c)).isalpha() else 0 for c in np.unique(far)}
        sym[wide] = [known[int(c)] for c in far]
    begin = np.cumsum([1, *(len(p) + 1 for p in parts)])[:-1] - 1  # the blank before each text
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    keep[begin] = True
    keep[-1] = False
    owner = np.zeros(len(cp), np.int64)
    owner[begin] = 1
    owner = np.cumsum(owner) - 1
    kept = np.flatnonzero(keep)
    n = np.bincount(owner[kept], minlength=len(parts)) + ORDER - 2
    starts = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(starts[-1], np.uint64)
    out[np.arange(len(kept)) + (owner[kept] + 1) * (ORDER - 2)] = sym[kept]
    return out, starts


def keys(sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed ORDER-grams of every symbol after a text's opening blanks, their texts'
    row numbers)."""
    n = len(sym) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for i in range(ORDER):
        key |= sym[i : i + n] << np.uint64(16 * (ORDER - 1 - i))
    length = np.maximum(np.diff(starts) - (ORDER - 1), 0)
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(row)) + (row * (ORDER - 1))
    return key[at], row


@dataclass
class Language:
    """Per order n = 1..ORDER the sorted n-grams and their log2 probabilities, and the sorted
    contexts and their log2 back-off weights; ``floor``: log2 probability of an unseen
    symbol."""

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float

    def score(self, key: np.ndarray) -> np.ndarray:
        """log2 probabilities of the last symbols of packed ORDER-grams."""
        out = np.zeros(len(key), np.float32)
        left = np.arange(len(key))
        for n in range(ORDER, 0, -1):
            part = key[left] & np.uint64((1 << 16 * n) - 1) if n < ORDER else key
            at, hit = _lookup(self.grams[n - 1], part)
            out[left[hit]] += self.logp[n - 1][at[hit]]
            left, part = left[~hit], part[~hit]
            if not len(left):
                return out
            if n > 1:
                at, seen = _lookup(self.contexts[n - 1], part >> np.uint64(16))
                out[left[seen]] += self.backoff[n - 1][at[seen]]  # an unseen context hands all on
        out[left] += np.float32(self.floor)
        return out


def _lookup(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return at, known[at] == wanted


@dataclass
class Model:
    """langs, the model of each, and their calibration."""

    langs: list[str]
    own: list[Language]
    usual: np.ndarray | None = None  # [lang, (median, deviation per root character, limit)]
    heat: float = 1.0

    def score(self, key: np.ndarray) -> np.ndarray:
        """[key, lang] log2 probabilities of the last symbols of packed ORDER-grams."""
        distinct, which = np.unique(key, return_inverse=True)
        return np.stack([x.score(distinct) for x in self.own], axis=1)[which]


def _per_language(key: np.ndarray, count: np.ndarray, alphabet: int) -> list[tuple]:
    """Interpolated Kneser-Ney of one language: for n = 1..ORDER (n-grams, probabilities,
    contexts, back-off weights). Lower orders count distinct left extensions."""
    tables = {ORDER: (key, count.astype(float))}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = tuple(x for x in np.unique(tables[n + 1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True))
        tables[n] = (tables[n][0], tables[n][1].astype(float))
    out: list[tuple] = []
    for n in range(1, ORDER + 1):
        g, c = tables[n]
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx, which = np.unique(g >> np.uint64(16), return_inverse=True)
        total, kinds = np.bincount(which, c), np.bincount(which)
        gamma = discount * kinds / total
        if n == 1:
            lower = np.full(len(g), 1.0 / alphabet)
        else:
            low_g, low_p = out[-1][:2]
            lower = low_p[np.searchsorted(low_g, g & np.uint64((1 << 16 * (n - 1)) - 1))]
        p = (c - discount) / total[which] + gamma[which] * lower
        out.append((g, p, ctx, gamma))
    return out


def train(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from (sorted packed ORDER-grams, counts) of each language."""
    langs = sorted(counts)
    alphabet = len(np.unique(np.concatenate([counts[x][0] & np.uint64(0xFFFF) for x in langs]))) + 1
    own = []
    for lang in langs:
        tables = _per_language(*counts[lang], alphabet)
        logs = lambda x: np.log2(x).astype(np.float32)
        own.append(Language([t[0] for t in tables], [logs(t[1]) for t in tables], [t[2] for t in tables], [logs(t[3]) for t in tables], float(np.log2(tables[0][3][0] / alphabet))))
    return Model(langs, own)


def entropies(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """([text, lang] cross-entropies in bits per symbol, symbols per text; a text's count
    is 0 if it has no letter)."""
    sym, starts = symbols(texts)
    key, row = keys(sym, starts)
    n = np.diff(starts) - (ORDER - 1)
    total = np.zeros((len(n), len(model.langs)))
    if len(key):
        has = np.flatnonzero(n > 0)
        heads = np.concatenate([[0], np.cumsum(n[has])[:-1]])
        total[has] = np.add.reduceat(model.score(key), heads, axis=0, dtype=np.float64)
    return -total / np.maximum(n, 1)[:, None], np.where(lettered(texts), n, 0)


def sample(df: DataFrame, rows: int) -> DataFrame:
    """(id, text, lang) of a share of the rows of each of the LANGUAGES commonest labels, so
    that about ``rows`` of it are expected; chosen by a hash of id and text."""
    labelled = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    if not counts:
        return labelled.limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 30, int((1 << 30) * rows / r["n"]) + 1))])
    return labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.coalesce(share[F.col("lang")], F.lit(0)))


def fit(df: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """A calibrated model from the labelled rows of (id, text, lang), None without any."""
    chosen = stored(sample(df, rows).select("text", "lang", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("held")), "langid-sample")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        langs = np.array(batch.column(1).to_pylist(), object)
        key, row = keys(*symbols(batch.column(0)))
        found = []
        for lang in sorted(set(langs)):
            k, c = np.unique(key[langs[row] == lang], return_counts=True)
            found.append((lang, k, c))
        if not len(key):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).tolist()), pa.array(np.concatenate([f[1] for f in found]).view(np.int64)), pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))], names=["lang", "key", "n"])

    def counted(part: DataFrame) -> dict:
        got = arrow_map(part.select("text", "lang"), count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
        out = {}
        for lang, g in got.groupby("lang"):
            k = g["key"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(k)
            out[lang] = (k[order], g["n"].to_numpy()[order])
        return out

    counts = counted(chosen.where(~F.col("held")))
    every = counted(chosen.where("held"))
    trained = frozenset(every) - frozenset(counts)
    counts = {**{k: v for k, v in every.items() if k not in counts}, **counts}
    if not counts:
        return None
    model = train(counts)
    _calibrate(model, chosen.where("held").select("text", "lang"), trained)
    return model


def _calibrate(model: Model, held: DataFrame, trained: frozenset[str] = frozenset()) -> None:
    """Usual cross-entropies and the softmax heat, from labelled rows that trained nothing
    but the languages ``trained``.

    Medians and median deviations, so that a few mislabelled or mixed rows move nothing;
    equal rows count once. The limit is one upper quantile over the rows of all languages.
    A language with few rows has the largest deviation of the others, and without any the
    largest median; without a row of any language nothing is rejected.
    """
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ce, n = entropies(shared.value, batch.column(0))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(n), pa.array(list(ce), pa.list_(pa.float64()))], names=["lang", "n", "ce"])

    got = arrow_map(held, run, "lang string, n bigint, ce array<double>").where("n > 0").toPandas()
    place = {x: i for i, x in enumerate(model.langs)}
    got = got[got["lang"].isin(place)]
    usual, rest = np.full((len(place), 3), np.nan), {}
    for lang, j in place.items():
        own = got[got["lang"] == lang]
        if lang in trained or not len(own):
            continue
        ce, n = np.unique([(c[j], min(n, EVIDENCE)) for c, n in zip(own["ce"], own["n"], strict=True)], axis=0).T
        usual[j, 0] = np.median(ce)
        rest[j] = (ce - usual[j, 0]) * np.sqrt(n)
        if len(ce) >= OWN_ROWS:
            usual[j, 1] = max(LEAST_DEVIATION, 1.4826 * float(np.median(np.abs(rest[j]))))
    if rest:
        if np.isnan(usual[:, 1]).all():
            usual[:, 1] = max(LEAST_DEVIATION, 1.4826 * float(np.median(np.abs(np.concatenate([*rest.values()])))))
        for c in (0, 1):
            usual[np.isnan(usual[:, c]), c] = np.nanmax(usual[:, c])
        z = np.concatenate([r / usual[j, 1] for j, r in rest.items()])
        usual[:, 2] = max(REJECT, float(np.quantile(z, 1 - FALSE_REJECTION, method="lower")))
    else:
        usual[:] = 0.0, 1.0, np.inf
    model.usual = usual
    if len(got):
        ce, n = np.array(got["ce"].tolist()), got["n"].to_numpy(float)
        true = np.array([place[x] for x in got["lang"]])
        best = None
        for heat in 2.0 ** np.arange(-8, 1):
            z = -ce * np.minimum(n, EVIDENCE)[:, None] * np.log(2) * heat
            z -= z.max(1, keepdims=True)
            like = float(np.mean(z[np.arange(len(true)), true] - np.log(np.exp(z).sum(1))))
            if best is None or like > best[0]:
                best = (like, heat)
        model.heat = best[1]


def decide(model: Model, ce: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, probability, rejected) of each text; ``und``, 0 and True without letters."""
    best = ce.argmin(1)
    z = -ce * np.minimum(n, EVIDENCE)[:, None] * np.log(2) * model.heat
    z -= z.max(1, keepdims=True)
    score = 1 / np.exp(z).sum(1)
    mean, dev, limit = model.usual[best].T
    far = (ce[np.arange(len(best)), best] - mean) * np.sqrt(np.minimum(n, EVIDENCE)) / dev > limit
    return [model.langs[b] if k > 0 else "und" for b, k in zip(best, n, strict=True)], np.where(n > 0, score, 0.0), (n <= 0) | far


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected, bits): one row for each row of ``df``.

    Null and empty texts, and texts without a letter, are ``und`` with score 0, rejected.
    Ties go to the language that sorts first. Without a model all are ``und``. Other
    columns are dropped.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, k = shared.value, batch.num_rows
        if m is None:
            lang, score, no, bits = ["und"] * k, np.zeros(k), np.ones(k, bool), np.zeros(k)
        else:
            ce, n = entropies(m, batch.column(1))
            lang, score, no = decide(m, ce, n)
            bits = ce.min(1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(no), pa.array(bits)], names=[id_col, "lang_pred", "score", "rejected", "bits"])

    return arrow_map(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")), run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean, bits double")


def accepted(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`predict` doesn't reject, all columns kept. Null and
    empty texts, and those without a letter, go; repeated rows stay or go together."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if shared.value is None:
            return None
        ce, n = entropies(shared.value, batch.column(at).cast(pa.string()))
        return batch.filter(pa.array(~decide(shared.value, ce, n)[2]))

    return arrow_map(df, run, df.schema)


def training_rows(df: DataFrame) -> DataFrame:
    """(id, text, lang) of the rows that may be learned from."""
    return df.where(fold(F.col("doc_id"), 3) != 1).select(F.col("doc_id").alias("id"), "text", "lang")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    out = predict(df, fit(training_rows(df)))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected", "bits")
