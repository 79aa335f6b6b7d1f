"""A corpus pipeline: documents are filtered, deduplicated twice, mixed and turned into tokens.

Each stage is a function of (spark, docs, sf_dir). It works on all rows its predecessor
kept and returns the columns of documents; the last returns doc_id, lang, source, n_chars,
token_ids and n_tokens. Further columns pass through all stages, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecframe.llm import bpe, exact_dedup, mixing, ngram_join, quality
from vecframe.llm.common import forget, scratch, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns.

    A null text is rejected, an empty one judged like any other. Rows with the same text
    share their fate, so repeated rows all stay or all go; a score of exactly 0 is a
    rejection. Ids don't matter and may be null. Without a trusted positive all stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, with all its columns.

    The least doc_id stays, null ids last; of rows that tie, the one with the least hash of
    the other columns. Empty texts are copies of one another; rows without a text all stay.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity connects, the one with the least doc_id.

    Rows without a doc_id, a text or a word are in no group and stay. Rows that share a
    doc_id are one document: they stay or go together.
    """
    return ngram_join.keep_one(docs, ngram_join.links(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to the budget, in proportion to the sources' weights, with all their columns.

    A null source is a source of its own. A null or empty text has no tokens and is in if
    its time is. Rows tied by source and doc_id, null ones too, are in or out together.
    """
    return mixing.mix_documents(docs, mixing.WEIGHTS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number in place of texts; every row stays.

    A null text has null ids and a null number, an empty one no ids and 0.
    """
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]

#: SQL can express neither the classifier nor the LSH forest.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage, function in STAGES[:-1]:
        before, out = docs, None
        with scratch(lambda: out):
            out = written(function(spark, docs, sf_dir), f"pipeline-{stage}")
        docs = out
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
