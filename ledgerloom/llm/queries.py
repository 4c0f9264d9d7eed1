"""The subpackage's entries for ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, knn, langid, merkle, packing, pii, simhash, spm, substrings, toxicity, urlfilter
from .common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the operators take any such path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.code_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.label_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label_languages(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, floor_scale=256.0)
    return found.withColumn("score", F.col("score").cast("long"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_packing": op2_packing,
        "op3_simhash": op3_simhash,
        "op4_toxicity": op4_toxicity,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_nearest": op6_nearest,
        "op7_language_id": op7_language_id,
        "op8_url_filter": op8_url_filter,
        "op9_top_k": op9_top_k,
        "op10_token_counts": op10_token_counts,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_alignment": op12_alignment,
        "op13_pii": op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": urlfilter.oracle(), "op9_top_k": knn.oracle(), "op11_merkle_manifest": merkle.oracle()}
