"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bytemill.llm import decontaminate, language_id, lm_score, near_dedup, packing, secret_scan, sharding, substring_dedup, toxicity, vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_secret_scan": secret_scan.op2,
        "op3_packing": packing.op3,
        "op4_vector_search": vector_search.op4,
        "op5_decontamination": decontaminate.op5,
        "op6_sharding": sharding.op6,
        "op7_simhash_near_dedup": near_dedup.op7,
        "op8_language_id": language_id.op8,
        "op9_lm_score": lm_score.op9,
        "op10_substring_dedup": substring_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_vector_search": vector_search.OP4_SQL,
        "op5_decontamination": decontaminate.OP5_SQL,
    }
