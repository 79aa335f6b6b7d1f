"""Queries opN_<name> of the operators here, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_extract, langid, line_dedup, mixing, ngram_join, quality, warc, webp


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1,
        "op2_exact_dedup": exact_dedup.op2,
        "op3_line_dedup": line_dedup.op3,
        "op4_quality": quality.op4,
        "op5_language_id": langid.op5,
        "op6_mixing": mixing.op6,
        "op7_html_extraction": html_extract.op7,
        "op8_ngram_join": ngram_join.op8,
        "op9_webp": webp.op9,
        "op10_bpe": bpe.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.op1_sql(), "op2_exact_dedup": exact_dedup.op2_sql(), "op3_line_dedup": line_dedup.op3_sql(), "op6_mixing": mixing.op6_sql(), "op9_webp": webp.op9_sql()}
