"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthoscan.llm import chat_format, decontaminate, exact_dedup, language_id, line_dedup, packing, quality, secret_scan, simhash, suffix_dedup, suffix_lm, vector_codes, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_neardup": simhash.op1_simhash_neardup,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_suffix_lm": suffix_lm.op7_suffix_lm,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_template_decontamination": decontaminate.op10_template_decontamination,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op8_secret_scan": secret_scan.OP8_SQL,
        "op9_chat_format": chat_format.OP9_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op12_suffix_dedup": suffix_dedup.OP12_SQL,
    }
