import random
import re

import pyarrow as pa
import pytest

from pointweave.llm import near_dedup as nd

LOWER = {i: i + 32 for i in range(65, 91)}


def sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        out.append((i, s))
    return out


def brute(rows):
    own = sets(rows)
    up = list(range(len(own)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(own)):
        for y in range(x):
            a, b = own[x][1], own[y][1]
            if a and b and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    up[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(own):
        r = find(x)
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[find(x)], i == least[find(x)]) for x, (i, s) in enumerate(own))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, node string")


def got(df, **more):
    return sorted(tuple(r) for r in nd.near_duplicates(df, **more).collect())


def test_set_sizes():
    rows = [(0, "A b\tc d e f a b c d e f"), (1, "one TWO"), (2, None), (3, " \n"), (4, "a b c d e")]
    value, starts = nd.shingle_sets(pa.array([t for _, t in rows]))
    assert (starts[1:] - starts[:-1]).tolist() == [len(s) for _, s in sets(rows)]


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("short", [32, 4])
def test_groups_of_copies(spark, monkeypatch, short):
    """Chains, hubs and half-linked copies; small limits force stars and blocks."""
    monkeypatch.setattr(nd, "SHORT", short)
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for length in (40, 150, 400):
        base = [word() for _ in range(length)]
        for _ in range(45):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, length // 28))):
                copy[rng.randrange(length)] = word()
            rows.append(" ".join(copy))
    for _ in range(60):  # a common passage in unlike documents, some of them little else
        rows.append(" ".join(passage + [word() for _ in range(rng.choice([5, 12, 20, 90]))]))
    rows += ["short one", "Short  One", "", None, "   "]
    rng.shuffle(rows)
    rows = [*enumerate(rows)]
    assert got(frame(spark, rows)) == brute(rows)


def test_repeats_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (8, None)]
    assert got(frame(spark, rows)) == [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 0, 8, True)]
    assert got(frame(spark, rows).limit(0)) == []


def test_texts_under_null_ids_link(spark):
    """Two documents are linked only through a text that has no id."""
    w = [f"w{i}" for i in range(120)]
    ends = [w, w[12:] + [f"x{i}" for i in range(12)], w[24:] + [f"x{i}" for i in range(24)]]
    rows = [(1, " ".join(ends[0])), (None, " ".join(ends[1])), (2, " ".join(ends[2])), (None, "quite another text of a few words")]
    have = {(i, n): c for i, n, c, _ in map(tuple, nd.near_duplicates(frame(spark, rows)).collect())}
    assert have == {(1, 116): 1, (None, 116): 1, (2, 116): 1, (None, 3): None}
    assert [r[:1] + r[2:3] for r in got(frame(spark, [rows[0], rows[2]]))] == [(1, 1), (2, 2)]


def test_rows_are_kept_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, c), (7, None), (8, "")]
    kept = nd.deduplicated(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "node"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (5, b), (None, c), (7, None), (8, "")], key=str)


def test_ids_of_text(spark):
    df = spark.createDataFrame([("x", "a b c d e f"), ("w", "a b c d e f"), (None, "a b c d e f")], "doc_id string, text string")
    assert {r["component_id"] for r in nd.near_duplicates(df).collect()} == {"w"}
    assert [r["doc_id"] for r in nd.deduplicated(df).collect()] == ["w"]
