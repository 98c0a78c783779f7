"""From raw documents to packed sequences: language, near-duplicates, benchmarks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontamination, language_id, minhash_dedup, packing
from tidelog.llm.common import keep, lean, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without text or without a letter go.

    Rows whose ``lang`` is null teach nothing and are judged like others. If no
    row has one, all documents with a letter stay.
    """
    lean(spark, "4m")
    taught = docs.where(~F.coalesce(language_id.held_out(), F.lit(False)))
    return language_id.accepted(docs, language_id.learn(taught))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more link; documents without words, and those without an id, stay."""
    lean(spark, "4m")
    return minhash_dedup.one_of_each(docs, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its text."""
    lean(spark, "4m")
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents left, with their sequences."""
    lean(spark, "4m")
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("minhash_dedup", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]

#: Tokenizing, fingerprints and learned profiles are beyond SQL; a test holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
