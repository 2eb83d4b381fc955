"""From raw documents to packed sequences: each stage works on what the one before kept.

Language identification drops documents without a known language, exact and near deduplication keep
one document of each group, personal data is replaced by its kind, and the texts that are left are
packed into sequences. A stage's result is written as Parquet and read again by the next; each frees first
what the plans before it left.

Defined results: documents with NULL or empty text have no language and go first; of rows that repeat an
id and text, or a text, one stays; rows with a NULL id take part in every stage, behind those with an id
where one of a group stays; an empty table gives an empty table; other columns stay as they are until the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebars.llm import exact_dedup, language, near_dup, packing, pii
from tidebars.llm.queries import tokenizer
from tidebars.session import materialize, tidy


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return language.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return near_dup.thinned(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Trained models and a tokenizer are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that every stage keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
