"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import fingerprints, hilbert, licenses, lm, mixing, neardup, pieces, pii, quality, urls
from lexweave.llm.common import table


#: Shares of the tokens that the mix should have.
MIX = {"good": 0.85, "low": 0.12, "toxic": 0.03}


def op1_soft_membership_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX)


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("n_extra")


def op3_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("class").alias("class_id"), "n_links", "n_copies")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = hilbert.assign(docs, "doc_id", ["source", "lang", "n_chars", "doc_id"])
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.versions(table(spark, sf_dir, "documents")).drop("n_removed", "n_added")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.line_first(docs, clean=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict:
    found = (op1_soft_membership_mix, op2_weak_supervision_pii, op3_lsh_forest_join, op4_hilbert_shards, op5_prefix_table, op6_masked_likelihood, op7_lookup_sketch, op8_license_scan, op9_url_filter, op10_line_first)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_first": quality.ORACLE}
