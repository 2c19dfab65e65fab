"""One query per training-data operator, over whole tables, with production parameters."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (divergence, exact_dedup, exact_topk, html_text, language_id, mixing, multi_index, near_dedup, oracles, packing,
                         quality, secret_scan, spelling, substring_dedup)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(oracles.SQL)


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup.decide(_table(spark, sf_dir, "documents"))
    return decided.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                          F.lower(F.hex("digest")).alias("text_sha256"))


@_query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@_query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digest(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


@_query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=80, shingle=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.withColumnRenamed("id", "doc_id")


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_takes(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query
def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))
