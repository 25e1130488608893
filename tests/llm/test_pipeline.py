"""The pipeline against brute force, stage by stage."""

import numpy as np
import pytest

import corpus_pipeline as cp
from pointweave.llm import bpe, decontaminate
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_spans import brute_secrets

tokenizers = pytest.importorskip("tokenizers")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = docs
    for name, stage in cp.STAGES:
        after = stage(spark, before, sf)
        old = {r["doc_id"]: r for r in before.collect()}
        new = {r["doc_id"]: r for r in after.collect()}
        if name == "bpe":
            ref = tokenizers.Tokenizer.from_file(bpe.vocabulary())
            assert set(new) == set(old)
            assert all(r["ids"] == ref.encode(old[i]["text"], add_special_tokens=False).ids for i, r in new.items())
            return
        assert after.columns == docs.columns
        assert set(new) <= set(old)
        if name == "language_id":
            assert len(new) >= 0.99 * len(old)
            assert all(new[i] == old[i] for i in new)
        if name == "near_dedup":
            assert set(new) == {i for i, _, _, kept in groups([(i, r["text"]) for i, r in old.items()]) if kept}
        if name == "decontamination":
            leaks = {i for i, r in old.items() if any(b in decontaminate.normal(r["text"]) for b in bench)}
            assert not leaks & set(new) and len(old) - len(new) < 2 * len(leaks) + 3
        if name == "secrets":
            assert set(new) == set(old)
            for i, r in new.items():
                assert not brute_secrets(r["text"]) and r["n_chars"] == len(r["text"])
                if not brute_secrets(old[i]["text"]) and "[SECRET]" not in r["text"]:
                    assert r["text"] == old[i]["text"]
        before = spark.createDataFrame(after.collect(), docs.schema)


def test_run_and_empty(spark, sf, tmp_path):
    n = cp.run(spark, sf).count()
    assert 0 < n <= spark.read.parquet(f"{sf}/documents.parquet").count()
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0
    assert np.all([len(s) == 2 for s in cp.STAGES])


def test_repeated_and_null_ids_extra_columns_and_no_benchmark(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()
    text = {r["doc_id"]: r["text"] for r in docs}
    ids = sorted(text)
    own = lambda r, **new: tuple((r.asDict() | new).values())
    rows = [own(r) for r in docs]
    by = {r["doc_id"]: r for r in docs}
    last = by[ids[-1]]
    rows += [own(last, text=by[ids[0]]["text"]), own(last, doc_id=None), own(last, text=None), own(last, text="")]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    clash = ["node", "spans", "item_id"]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as node", "2 as spans", "3 as item_id")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    at = f"file://{tmp_path}"
    now = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, now, at)
        assert after.columns == now.columns and set(clash) <= set(after.columns)
        if name == "near_dedup":
            left = [(r["doc_id"], r["text"]) for r in after.collect()]
            # the copy of the first text goes from the last id, whose own text stays
            assert (ids[-1], text[ids[0]]) not in left and None not in [i for i, _ in left]
            assert (ids[-1], text[ids[-1]]) in left or any(i < ids[-1] for i, _ in left)
        now = spark.createDataFrame(after.collect(), now.schema)
    out = cp.STAGES[-1][1](spark, now, at)
    assert out.count() == now.count() == cp.run(spark, at).count()
