"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from pointweave.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PIECES = list("abcdethTHE  \n\t\r\x1c\x85  'sé́ßñ中文😀٣²_-=!0123") + ["th", "er", "in", " the", "tion", "<|endoftext|>", "\n\n", "  ", "0000", "ababab", "===="]


@pytest.fixture(scope="module")
def both():
    return bpe.Codec(bpe.vocabulary()), tokenizers.Tokenizer.from_file(bpe.vocabulary())


def test_same_ids_and_texts(both):
    mine, ref = both
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    for t, e in zip(texts, ref.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = mine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert mine.decode(ids).decode() == ref.decode(e.ids, skip_special_tokens=False)


def test_long_piece(both):
    mine, ref = both
    for t in ("a" * 30000, "ab" * 20000, "é" * 5000):
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids


def test_query(spark, sf, both):
    rows = {r["doc_id"]: r for r in bpe.op10_bpe(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = both[1].encode(d["text"] or "", add_special_tokens=False).ids
        assert rows[d["doc_id"]]["n_tokens"] == len(ids)
        assert rows[d["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d["doc_id"]]["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "hi there", "y"), (2, "", "z")], "doc_id long, text string, ids string")
    got = bpe.encode(df, bpe.vocabulary()).orderBy("doc_id", "n_tokens").collect()
    assert [(r["doc_id"], r["n_tokens"], r["decoded"]) for r in got] == [(None, 2, "hi there"), (1, 0, ""), (1, 0, ""), (2, 0, "")]
    assert bpe.encode(df.limit(0), bpe.vocabulary()).count() == 0
