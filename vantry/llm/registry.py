"""The training-data operators as queries over the driver's tables, with SQL answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bit_sliced, hilbert, itq, merge_path, mixing, notices, pieces, quality_rules, simhash, site_templates, suffix_dedup, toxicity, url_rules
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.toxicity(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(read(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids", "n_pieces", "n_bytes", "round_trip")


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return itq.near_duplicates(read(spark, folder, "embeddings"))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = site_templates.extract(read(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(read(spark, folder, "pages"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = suffix_dedup.dedup(read(spark, folder, "documents").select("doc_id", "text"), passage=suffix_dedup.PASSAGE)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(read(spark, folder, "documents"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.shard(read(spark, folder, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"))


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return notices.digest(notices.scan(read(spark, folder, "documents").select("doc_id", "text")))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return bit_sliced.resample(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return merge_path.link_counts(read(spark, folder, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    found = [
        op1_toxicity, op2_sentencepiece, op3_embedding_dedup, op4_html_extraction, op5_url_filters, op6_simhash, op7_suffix_dedup, op8_quality_rules,
        op9_sharding, op10_mixing, op11_license_scan, op12_importance_resampling, op13_tokenizer_alignment]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op5_url_filters": url_rules.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op10_mixing": mixing.ORACLE}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
