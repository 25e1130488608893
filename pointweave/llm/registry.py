"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pointweave.llm import bpe, decontaminate, langid, lm_score, near_dedup, oracles, pii, secrets, sharding, suffix_dedup, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1_langid,
        "op2_pii": pii.op2_pii,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_lm_score": lm_score.op5_lm_score,
        "op6_topk": topk.op6_topk,
        "op7_sharding": sharding.op7_sharding,
        "op8_secrets": secrets.op8_secrets,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_bpe": bpe.op10_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": oracles.NEAR_DEDUP, "op6_topk": oracles.TOPK, "op7_sharding": oracles.SHARDING}
