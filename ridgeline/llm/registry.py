"""Queries of this subpackage and their DuckDB SQL; ``__spark_entry__`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import decontaminate, jaccard, language, packing, pii, quality, recompression, suffix, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_language_id": language.op2_language_id,
    "op3_pii": pii.op3_pii,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_recompression_dedup": recompression.op6_recompression_dedup,
    "op7_token_files": token_files.op7_token_files,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_suffix_array_dedup": suffix.op9_suffix_array_dedup,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE_SQL,
    "op6_recompression_dedup": recompression.ORACLE_SQL,
    "op10_ngram_jaccard_join": jaccard.ORACLE_SQL,
}
