"""The corpus pipeline: quality rules, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. :func:`run` writes each stage's rows as
Parquet in the shared folder and hands what is read back to the next stage. All stages but the last
return the columns of ``documents``; the last returns the places of every document's pieces.

Defined results, for every stage: null and empty texts fail the quality rules; given to a later stage by itself,
they have no language and go, are in no group and stay, have no personal data, and are one piece, the end token.
Very long texts are whole throughout. Repeated rows count each, but of rows with one doc_id and equal shingles one
stays. Rows with a null doc_id lose no lines, are in no group, and are packed. Ties go to the smaller doc_id. Extra
columns pass through all stages but the last, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import language, minhash, packing, pii, quality
from millrace.plans.shared import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; lines that too many documents of a host share are cut out."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not known well enough go."""
    return language.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at similarity 0.8, the one with the smallest doc_id stays."""
    return minhash.keep(docs, k=5, threshold=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's tokens in sequences of 4096."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("pack_sequences", pack_sequences),
]

#: Trained and tokenised stages cannot be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
