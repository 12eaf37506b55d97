"""Corpus pipeline: classify, deduplicate, redact, mix and pack `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before, which are written as Parquet and
read again. All but the last return the columns of `documents`, and further columns too, whatever they are called.
Null doc_ids, texts and sources are allowed everywhere, a null text counts as an empty one, and an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebar.llm import jaccard_join, mixing, packing, quality_classifier, secrets
from tidebar.llm.common import forget, keep, table, workers_find_us
from tidebar.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Each row is judged by its text alone, repeated rows alike."""
    workers_find_us(spark)
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, null last; of repeated rows one stays.

    Texts without words are no duplicates: all of them stay.
    """
    workers_find_us(spark)
    return jaccard_join.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the secrets in their texts; null and empty texts stay as they are."""
    workers_find_us(spark)
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: rows one by one, repeated or not; those without words go."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; an empty text is its end mark alone."""
    workers_find_us(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("redact", redact), ("mix", mix), ("pack", pack)]

#: Hash-based rounding and tokenisation are beyond SQL; tests hold the stages against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, keep(stage(spark, docs, sf_dir))
        forget(before)  # nothing but the last stage's rows stays
    return docs
