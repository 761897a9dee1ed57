"""From raw documents to packed training sequences, in five stages.

Each stage reads what the stage before it wrote and keeps the columns of ``documents`` (the last returns pieces).
Columns that the stages don't name pass through; rows with null or letterless text leave at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netspark.llm import exact_dedup, language, packing, pii
from netspark.llm import near as near_copies
from netspark.llm.common import stored
from netspark.llm.tokens import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those in none (null, or without a letter) go."""
    return language.known_only(docs, language.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest doc_id."""
    return exact_dedup.exact_dedup(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more over five-word shingles, the document with the smallest doc_id."""
    return near_copies.one_of_each(docs, k=5, similarity=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that give it away replaced."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: its place in sequences of at most 4096 ids."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash", near),
    ("pii", private),
    ("packing", packed),
]

#: SQL can express neither the mixture model, nor fingerprints' components, nor packing; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
