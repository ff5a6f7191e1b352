"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import q_text, sql

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": q_text.op1_quality_rules,
        "op2_suffix_array_repeats": q_text.op2_suffix_array_repeats,
        "op3_warc_round_trip": q_text.op3_warc_round_trip,
        "op4_token_counts": q_text.op4_token_counts,
        "op5_license_scan": q_text.op5_license_scan,
        "op6_simhash_near_duplicates": q_text.op6_simhash_near_duplicates,
        "op7_hash_prefix_forest": q_text.op7_hash_prefix_forest,
        "op8_context_mixing": q_text.op8_context_mixing,
        "op9_bpe_round_trip": q_text.op9_bpe_round_trip,
        "op10_best_fit_packing": q_text.op10_best_fit_packing,
        "op11_minhash_near_duplicates": q_text.op11_minhash_near_duplicates,
        "op12_importance_resampling": q_text.op12_importance_resampling,
        "op13_tokenizer_alignment": q_text.op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
