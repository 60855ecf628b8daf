"""Queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import ann, bpe, decontamination, html_extract, language_id, line_dedup, minhash_dedup, quality, secrets, substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_minhash_dedup": minhash_dedup.op2_minhash_dedup,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_quality": quality.op5_quality,
        "op6_secrets": secrets.op6_secrets,
        "op7_ann": ann.op7_ann,
        "op8_bpe": bpe.op8_bpe,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": substring_dedup.ORACLE_SQL,
        "op4_decontamination": decontamination.ORACLE_SQL,
        "op10_line_dedup": line_dedup.ORACLE_SQL,
    }
