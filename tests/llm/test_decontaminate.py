import random

from pointweave.llm import decontaminate as dc


def edit(a, b):
    """Least edits between a and any part of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def exact(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_search_equals_edit_distance():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    hits = misses = 0
    for _ in range(250):
        item = " ".join(word() for _ in range(rng.randint(12, 30)))
        if len(item) < dc.LEAST_ITEM:
            continue
        noisy = list(item)
        e = dc.budget(len(item))
        for _ in range(rng.randint(0, 2 * e)):
            at = rng.randrange(len(noisy))
            noisy[at : at + 1] = rng.choice([[], ["x"], [noisy[at], "y"]])
        text = dc.normal(" ".join(word() for _ in range(20)) + " " + "".join(noisy) + " " + " ".join(word() for _ in range(20)))
        want = edit(item, text)
        got = dc.Items([(5, item)], dc.RATE).search(text)
        assert bool(got) == (want <= e)
        if got:
            n, s, t, d = got[0]
            assert d == want == exact(item, text[s:t])
        hits, misses = hits + bool(got), misses + (not got)
    assert hits > 40 and misses > 40


def test_documents_and_edges(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions"
    docs = [
        (1, f"before it\n{item.upper()} after", 1),
        (2, "x " + item.replace("seven", "sevn") + " y", 1),
        (3, "nothing of that kind " * 50, 1),
        (4, None, 1),
        (5, "", 1),
        (6, item.replace("brown fox jumps over", "red cat sleeps under"), 1),
        (None, item, 1),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "short"), (12, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.matches(df, bench).collect()}
    assert set(got) == {(i, n) for i in (1, 2, None) for n in (9, 12)}
    assert docs[0][1][got[1, 9]["start"] : got[1, 9]["end"]] == item.upper() and got[1, 9]["distance"] == 0
    assert got[2, 9]["distance"] == 1
    assert sorted(r["doc_id"] for r in dc.clean(df, bench).collect()) == [3, 4, 5, 6]
    assert dc.matches(df, bench.limit(0)).count() == 0 and dc.matches(df.limit(0), bench).count() == 0


def test_short_items_and_ids_of_any_type(spark):
    docs = [("a", "So the Answer is\n forty two, or: answer is forty two !"), ("b", "answer is forty twofold"), ("c", "nothing"), ("d", None)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    bench = spark.createDataFrame([("q1", "answer is forty two"), ("q2", "Answer  is forty two"), ("q2", "answer is forty two"), (None, "ANSWER is forty two"), ("q3", " "), ("q4", None)], "item_id string, text string")
    got = dc.matches(df, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == [("a", "q1"), ("a", "q2"), ("a", None)]
    assert all(docs[0][1][r["start"] : r["end"]] == "answer is forty two" and r["distance"] == 0 == r["budget"] for r in got)
    assert sorted(r["doc_id"] for r in dc.clean(df, bench).collect()) == ["b", "c", "d"]


def test_query_finds_verbatim_items(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["item_id"]) for r in dc.op4_decontamination(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if dc.normal(b["text"]) in dc.normal(d["text"])}
    assert got >= want and want
