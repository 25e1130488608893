import hashlib
import zlib
from collections import Counter, defaultdict

from pointweave.llm import sharding


def brute(rows, shards, fine=100):
    """The middle-byte law, row by row: (id, size, crc, shard) and slots by md5 of the id."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    key = lambda b: hashlib.md5(b).hexdigest()[:15]
    total = sum(len(b) + 1 for _, b in rows)
    group = Counter()
    for _, b in rows:
        group[key(b)] += len(b) + 1
    low = -(1 << 63)
    unit = lambda r: (key(r[1]), (low if r[0] is None else r[0]) if group[key(r[1])] * shards * fine > total else 0)
    size = Counter()
    for r in rows:
        size[unit(r)] += len(r[1]) + 1
    place, before = {}, 0
    for u in sorted(size):
        place[u] = (2 * before + size[u]) * shards // (2 * total)
        before += size[u]
    return sorted(((i is not None, i, len(b) + 1, zlib.crc32(b), place[unit((i, b))]) for i, b in rows), key=str)


def check(df, rows, shards):
    got = sharding.shard(df, shards).collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got), key=str) == brute(rows, shards)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(df, [(r["doc_id"], r["text"]) for r in df.collect()], 8)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) < 2 * max(r["size"] for r in got)


def test_hot_copies_nulls_and_negative_ids(spark):
    rows = [(-i if i % 3 else i, "same text") for i in range(500)] + [(i, f"text {i}") for i in range(1000, 1400)] + [(None, None), (7, None), (7, ""), (7, "same text")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, size int, shard int")
    got = check(df, rows, 5)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) < 60


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r["shard"], r["slot"]) for r in sharding.shard(df, 4).collect()] == [(2, 0)]
    assert sharding.shard(df.limit(0), 4).count() == 0


def test_slots_do_not_depend_on_the_deals(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(tuple(r) for r in sharding.shard(df, 3).drop("grown_shard").collect())
    monkeypatch.setattr(sharding, "DEAL", 2)
    monkeypatch.setattr(sharding, "DEALS", 1)
    assert sorted(tuple(r) for r in sharding.shard(df, 3).drop("grown_shard").collect()) == want
