"""The subpackage's queries and SQL oracles, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import ann, bpe, exact_dedup, line_dedup, mixing, near_dedup, quality, sharding, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": ann.op1_ann,
        "op2_quality": quality.op2_quality,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_substring": substring.op4_substring,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_shard": sharding.op6_shard,
        "op7_bpe": bpe.op7_bpe,
        "op8_mix": mixing.op8_mix,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.ORACLE, "op4_substring": substring.ORACLE, "op6_shard": sharding.ORACLE, "op8_mix": mixing.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
