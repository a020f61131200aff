"""Queries of this folder's operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, huffman, langid, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": huffman.op1_token_ids,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_mixing": mixing.op3_mixing,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_language_id": langid.op9_language_id,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
}
