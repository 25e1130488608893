import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pointweave.llm import suffix_dedup as sd

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, n=sd.LEAST):
    """Spans covered by windows of n words that another document also holds."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))) for i, t in rows]
    texts = [t for _, t in rows]
    seen = defaultdict(set)
    for x, (_, w) in enumerate(words):
        for j in range(len(w) - n + 1):
            seen[tuple(w[j : j + n])].add(x)
    out = []
    for x, (i, w) in enumerate(words):
        spans = []
        for j in range(len(w) - n + 1):
            if len(seen[tuple(w[j : j + n])]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + n
                else:
                    spans.append([j, j + n])
        out += [(i, *s) for s in spans]
    return sorted(out, key=str), texts


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n int, text_key string")


def got(df):
    return sorted((tuple(r) for r in sd.repeats(df).collect()), key=str)


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    first = np.array([0, 200, 210, 500])
    at = sd.minimisers(h, first)
    width = sd.WINDOW + sd.GRAM - 1
    for a, b in zip(first, first[1:], strict=False):
        for j in range(a, b - width + 1):
            assert ((at >= j) & (at < j + sd.WINDOW)).any()


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (50, 55, 64, 120, 400)]
    rows = []
    for p in shared:
        for _ in range(4):
            rows.append(" ".join(text(rng.randint(0, 80)) + p + text(rng.randint(0, 80))))
    common = text(70)
    rows += [" ".join(text(rng.randint(0, 40)) + common + text(rng.randint(0, 40))).upper() for _ in range(60)]
    rows += [" ".join(text(49) * 3), " ".join(text(30)), "", None]
    rows += [" ".join(text(100))] * 5 + [" ".join(text(20))] * 3
    short = text(45)
    rows += [" ".join(text(40) + short + text(40)) for _ in range(6)]
    rng.shuffle(rows)
    return [*enumerate(rows)]


def test_planted_passages(spark, planted):
    want, _ = brute(planted)
    have = got(frame(spark, planted))
    assert len({w[0] for w in want}) >= 80
    assert have == want


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, _ = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    have = got(df)
    cover = lambda spans: {(i, k) for i, s, e in spans for k in range(s, e)}
    w, h = cover(want), cover(have)
    assert h <= w
    assert len(h) >= 0.999 * len(w)
    assert {i for i, _, _ in have} == {i for i, _, _ in want}


def test_passages_and_empty_table(spark, planted):
    df = frame(spark, planted)
    assert got(df.limit(0)) == []
    spans = sd.repeats(df).where("doc_id < 20")
    texts = dict(planted)
    for r in sd.passages(df, spans).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["passage"] and len(r["passage"].split()) >= 50


def test_partners_that_agree_to_the_left_of_a_frequent_line(spark):
    rng = random.Random(5)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    line = text(40)
    rows = [" ".join(text(45) + line + text(45)) for _ in range(300)]
    for _ in range(30):
        before = text(15)
        rows += [" ".join(text(30) + before + line + text(45)) for _ in range(2)]
    rng.shuffle(rows)
    rows = [*enumerate(rows)]
    want, _ = brute(rows)
    assert len(want) == 60
    assert got(frame(spark, rows)) == want


def test_one_passage_over_many_ranges(spark):
    """Ranges end between the places of one text that holds a passage twice, and between
    these and the other text."""
    rng = random.Random(6)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows = []
    for _ in range(6):
        p = text(50)
        rows += [" ".join(text(3) + p + text(3) + p + text(3) + p), " ".join(text(3) + p)]
    alone = text(50)
    rows = [*enumerate([*rows, " ".join(alone + text(3) + alone)])]
    want, _ = brute(rows)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert got(frame(spark, rows)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_text_under_a_null_id(spark):
    rng = random.Random(8)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    p = text(60)
    rows = [(None, " ".join(text(9) + p)), (1, " ".join(p + text(9))), (None, " ".join(text(70)))]
    want, _ = brute(rows)
    assert len(want) == 2 and got(frame(spark, rows)) == want


def test_passages_of_ids_that_repeat(spark):
    shared = " ".join(f"word{i}" for i in range(70))
    rows = [(1, "tiny"), (1, f"one two {shared}"), (2, f"{shared} three"), (None, f"x {shared}"), (2, f"{shared} three")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    got = [(r["doc_id"], r["passage"]) for r in sd.passages(df, sd.keyed_repeats(df)).collect()]
    assert sorted(got, key=str) == sorted([(1, shared), (2, f"{shared} three"), (2, f"{shared} three"), (None, shared)], key=str)
