"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of ``documents``. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm import bpe, decontaminate, langid, near_dedup, secrets
from pointweave.llm.common import documents, stored

#: No stage but the first could be put in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: those far from every language, and
    those without a letter, null and empty texts among them."""
    return langid.accepted(docs, langid.fit(langid.training_rows(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays. Documents are told
    apart by id and text, so an id may keep one text and lose another; one without an id
    stays only where no document of its group has one."""
    return near_dedup.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Without items none do; repeated rows stay or
    go together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced, and n_chars follows (null for a
    null text)."""
    return secrets.redacted(docs, length_col="n_chars")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    return bpe.encode(docs, bpe.vocabulary()).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
