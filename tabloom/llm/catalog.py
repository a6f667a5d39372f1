"""Queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import (
    byte_bpe, conversation_repair, decontaminate, fingerprints, html_extract, language_id, lm_scoring, ngram_join, pii, prefix_trie,
    quality_classifier, token_count, url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_pii": pii.op2_pii,
        "op3_language_id": language_id.op3_language_id,
        "op4_byte_bpe": byte_bpe.op4_byte_bpe,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_token_count": token_count.op9_token_count,
        "op10_html_extract": html_extract.op10_html_extract,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_lm_scoring": lm_scoring.op13_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op6_url_filter": url_filter.ORACLE,
        "op7_ngram_join": ngram_join.ORACLE,
        "op11_conversation_repair": conversation_repair.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
    }
