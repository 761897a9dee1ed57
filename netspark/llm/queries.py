"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.llm import exact_dedup, language, media, packing, pii, roundtrip, simhash, substrings, token_output, toxicity
from netspark.llm.tokens import tokenizer_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_output.write_shards(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_output.read_places(shards)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_docs(spark, sf_dir), length=400)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_held_out(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), cut=0.7)
    return scored.select("doc_id", "held_out", "score", "predicted", "n_passages")


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip.digests(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(_docs(spark, sf_dir)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_groups(_docs(spark, sf_dir), keep="max")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_docs(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_docs(spark, sf_dir), k=4, radius=4)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_docs(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output, op2_suffix_dedup, op3_toxicity, op4_bpe_roundtrip, op5_packing,
        op6_pii, op7_exact_dedup, op8_language, op9_simhash, op10_media,
    )
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op7_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents),
             g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id,
                          count(*) OVER (PARTITION BY t) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
