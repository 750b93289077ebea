"""The registered queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary, chat, decontaminate, html, jaccard, language, packing, quality, suffix_dedup, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": url_filters.query,
        "op2_decontamination": decontaminate.query,
        "op3_language_id": language.query,
        "op4_quality_rules": quality.query,
        "op5_html_extraction": html.query,
        "op6_token_ids": binary.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_jaccard_join": jaccard.query,
        "op9_chat_formatting": chat.query,
        "op10_best_fit_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    """op2 to op7 and op10 have none: SQL can't express the learned verdicts, the tokenizer or byte strings; tests hold them against brute force."""
    return {
        "op1_url_filters": url_filters.ORACLE,
        "op8_jaccard_join": jaccard.ORACLE,
        "op9_chat_formatting": chat.ORACLE,
    }
