import numpy as np
import pytest

from pointweave.llm import topk

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def brute(rows, every, k):
    """Row by row in Python's integers; rows are (id, ints)."""
    out = []
    for a, (qi, q) in enumerate(rows):
        if qi % every == 0:
            s = sorted((-min(max(sum(int(x) * int(y) for x, y in zip(q, v, strict=True)), LEAST), MOST), i) for b, (i, v) in enumerate(rows) if a != b and len(v) == len(q))
            out += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_against_all_products(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], float)).astype(int).tolist()) for r in df.collect()]
    got = sorted(tuple(r) for r in topk.op6_topk(spark, sf).collect())
    assert got == brute(rows, 50, 5)


@pytest.mark.parametrize("ranges", [1024, 2])
def test_ties_nulls_and_ranges(spark, monkeypatch, ranges):
    for name, value in (("SEEDS", 8), ("RANGES", ranges), ("RANGE", 16), ("PASS_BYTES", 64), ("PIVOTS", 5)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(i % 290, rng.integers(-2, 3, 4).tolist()) for i in range(300)]
    bad = [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0]), (1003, [float("nan")] * 4), (1004, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    other = [(2000, [1.0, 2.0]), (2001, [3.0, 1.0])]  # of another length
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 0, 1, 2) for i, v in rows + bad + other], "vec_id long, embedding array<float>, score int, row int, near int")
    got = sorted(tuple(r) for r in topk.search(df, 50, 5, scale=1).collect())
    assert got == brute([*rows, *other], 50, 5)
    assert topk.search(df.limit(0), 50, 5).count() == 0
    two = topk.search(df.where("vec_id in (11, 50, 51)"), 50, 5, scale=1).collect()
    assert [r["rank"] for r in sorted(two)] == [1, 2]


def test_a_repeated_id_is_a_row_like_any_other(spark):
    rows = [(50, [1.0, 0.0]), (50, [3.0, 1.0]), (7, [2.0, 2.0])]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50, 5, scale=1).collect())
    assert got == [(50, 1, 7, 8), (50, 1, 50, 3), (50, 2, 7, 2), (50, 2, 50, 3)] == brute([(i, [int(x) for x in v]) for i, v in rows], 50, 5)


def test_large_components_are_exact(spark):
    for size in (1.0, 1e6, 3e7, 1e12, 3e38):
        rng = np.random.default_rng(2)
        rows = [(i, (np.float32(size) * rng.uniform(-1, 1, 3).astype(np.float32)).tolist()) for i in range(60)] + [(100, [float(np.float32(size))] * 3)]
        whole = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows]
        got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50, 5).collect())
        assert got == brute(whole, 50, 5)


def test_groups_are_pruned(spark):
    """Vectors in groups: most of what a pass is offered is never scored."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32)) * 100
    vectors = np.floor(centres[rng.integers(0, 40, 20000)] + rng.normal(size=(20000, 32)) * 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    base = topk.integers(df, 1, "vec_id", "embedding")
    rows = topk.in_order(base, 32, 4).toArrow()
    ids, numbers, matrix = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy(), topk._matrix(rows.column("v"), "f8")
    queries = np.flatnonzero(ids % 50 == 0)
    best = topk.Best(numbers[queries], matrix[queries], np.full(len(queries), LEAST), 5)
    best.feed(ids, numbers, matrix)
    assert best.scored < 0.1 * best.offered
    scores = matrix[queries] @ matrix.T
    scores[np.arange(len(queries)), queries] = -np.inf
    want = np.sort(scores, axis=1)[:, ::-1][:, :5]
    assert np.array_equal(best.found[3].reshape(-1, 5), want)
