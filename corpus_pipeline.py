"""From raw documents to packed training sequences, in stages that each read what the last one wrote.

Defined results: null and empty texts have no words and fall to the quality rules. Null languages are only left out of
learning, null ids only out of near-duplicates (such rows stay). Repeated rows of one id and text stay or go
together until near-duplicates, which keep the rows of the first id. Long texts are read whole in every stage. Empty
tables give empty tables. All stages but the last keep the columns of their input, whatever their names; the last
gives pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagia.llm import language_id, near_dedup, packing, pii, quality
from pelagia.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rules or repeat themselves."""
    return quality.keep(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from this stage's own labelled documents and drops texts without a recognisable language."""
    return language_id.keep(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates."""
    return near_dedup.keep(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind in brackets."""
    return pii.redact(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their ids, sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", known_language),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

#: No SQL form: trained models, tokenisation and packing are checked against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
