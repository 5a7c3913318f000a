"""The queries of this package by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, exact_dedup, filter_audit, line_dedup, lm_scoring, mixing, ngram_join, pieces, quality, substring_dedup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
        "op3_lm_scoring": lm_scoring.op3_lm_scoring,
        "op4_mixing": mixing.op4_mixing,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_bpe": bpe.op8_bpe,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_quality": quality.op10_quality,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_pieces": pieces.op12_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "op2_embedding_dedup": embedding_dedup.OP2_SQL,
        "op4_mixing": mixing.OP4_SQL,
        "op5_ngram_join": ngram_join.OP5_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op9_substring_dedup": substring_dedup.OP9_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
    }
