"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import archives, bpe, class_lm, decontaminate, exact_dedup, language, line_quality, resampling, simhash, spelling, suffix_dedup, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_warc": archives.op2_warc,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_simhash": simhash.op4_simhash,
        "op5_language": language.op5_language,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_bpe_chunks": bpe.op7_bpe_chunks,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_class_lm": class_lm.op10_class_lm,
        "op11_resampling": resampling.op11_resampling,
        "op12_spelling": spelling.op12_spelling,
        "op13_line_quality": line_quality.op13_line_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op2_warc": archives.ORACLE,
        "op9_exact_dedup": exact_dedup.ORACLE,
        "op11_resampling": resampling.ORACLE,
        "op12_spelling": spelling.ORACLE,
    }
