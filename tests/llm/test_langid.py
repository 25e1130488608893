import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pointweave.llm import langid


def brute_kn(texts, order, alphabet):
    """Interpolated Kneser-Ney, straight from its definition."""
    top = Counter()
    for t in texts:
        s = "\0" * (order - 1) + t
        top.update(s[i : i + order] for i in range(len(s) - order + 1))
    tables = {order: top}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / alphabet
        c = tables[n]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = [v for k, v in c.items() if k[:-1] == g[:-1]]
        if not own:
            return p(g[1:])
        return max(c[g] - d, 0) / sum(own) + d * len(own) / sum(own) * p(g[1:])

    return p


def test_probabilities_follow_the_definition():
    texts = {"x": ["abab ba", "abc"], "y": ["cab", "bb a"]}
    counts = {}
    for lang, own in texts.items():
        k, _ = langid.keys(*langid.symbols(pa.array(own)))
        counts[lang] = np.unique(k, return_counts=True)
    model = langid.train(counts)
    probe = "\0\0\0" + "abac bbz"
    sym, starts = langid.symbols(pa.array(["abac bbz"]))
    got = model.score(langid.keys(sym, starts)[0])
    blank = lambda t: t.replace(" ", "\0")
    for j, lang in enumerate(model.langs):
        p = brute_kn([("\0" + blank(t))[1:] for t in texts[lang]], 4, 5)
        probe = "\0" * 3 + blank("abac bbz")
        want = [math.log2(p(probe[i : i + 4])) for i in range(len(probe) - 3)]
        assert np.allclose(got[:, j], want, atol=1e-4)


def test_symbols():
    sym, starts = langid.symbols(pa.array(["A, b!", None, "12", "é"]))
    rows = ["".join(chr(c) if c else "_" for c in sym[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)]
    assert rows == ["___a_b_", "___", "___", "___é"] 


def test_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = langid.op1_langid(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in rows]) < 0.01


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(langid.training_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_rejection_and_edges(spark, model):
    texts = ["qxzj vvkq jjxw zzqk xkcd qqqq wxyz jkjk " * 20, None, "", "123 !?", "la maison est dans la rue et les enfants " * 9, "x " * 40000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert got[0]["rejected"]
    for i in (1, 2, 3):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[4]["lang_pred"] == "fr"
    assert langid.predict(df.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "id long, text string, lang string")
    assert langid.fit(empty) is None
    assert langid.predict(df, None).where("lang_pred <> 'und'").count() == 0


def test_marks_alone_are_no_letters(spark, model):
    df = spark.createDataFrame([(1, "\u0301\u0301"), (2, "1\u0301 2"), (3, "e\u0301te\u0301"), (3, "e\u0301te\u0301")], "doc_id long, text string")
    got = sorted(langid.predict(df, model).collect(), key=lambda r: r["doc_id"])
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in got[:2]] == [("und", 0.0, True)] * 2
    assert got[2] == got[3] and got[2]["lang_pred"] != "und" and got[2]["score"] > 0


def test_equal_models_tie_to_the_first(spark):
    rows = [(i, f"word number {i % 7} of some text", lang) for i in range(200) for lang in ("b", "a")]
    model = langid.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "some word")], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == "a" and abs(got["score"] - 0.5) < 1e-6


def test_only_the_commonest_labels_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, f"word {i} text", lang) for lang, n in (("a", 40), ("b", 30), ("c", 2)) for i in range(n)]
    assert langid.fit(spark.createDataFrame(rows, "id long, text string, lang string")).langs == ["a", "b"]


@pytest.mark.parametrize("absent", ["es", "de"])
def test_documents_of_a_language_not_learned_are_rejected(spark, absent):
    """Also where single held rows are mislabelled, and languages have few of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = langid.training_rows(docs).where(f"lang <> '{absent}'")
    model = langid.fit(learned)
    foreign = docs.where(f"lang = '{absent}' and length(text) >= 200").select("doc_id", "text")
    share = lambda df: np.mean([r["rejected"] for r in langid.predict(df, model).collect()])
    assert share(foreign) >= 0.97

    held = learned.where("pmod(xxhash64(text), 4) = 0").select("text", "lang")
    few = held.where("lang <> 'fr'").unionByName(held.where("lang = 'fr'").limit(6))
    wrong = foreign.orderBy("doc_id").limit(1).selectExpr("text", "'en' as lang")
    langid._calibrate(model, few.unionByName(wrong))
    assert share(foreign) >= 0.97
    assert share(docs.where(f"lang <> '{absent}'").select("doc_id", "text")) < 0.02
