"""From raw documents to packed training sequences, as five stages.

Each stage takes the documents that its predecessor kept and decides on them; ``run`` writes
what a stage returns as Parquet and reads it again for the next one.  A stage's scratch tables are removed when the
next stage starts, as its documents have been written by then.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, language_id, mixing, near_dedup, packing
from lectern.llm.queries import tokenizer_path
from lectern.session import release, scratch_owner, scratch_table

OWNER = "corpus-pipeline"


def _stage(fn):
    """``fn`` as a stage that first removes what the stage before left behind."""
    @functools.wraps(fn)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER)
        with scratch_owner(OWNER):
            return fn(spark, docs, sf_dir)

    return stage


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go."""
    return language_id.accepted(docs)


@_stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.exact_dedup(docs)


@_stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 80 %) the smallest id stays."""
    return near_dedup.near_dedup(docs)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated or cut so that each source comes to its target."""
    return mixing.mix_documents(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their token ids and places in training sequences; ``copy`` tells
    the mixed texts of one document apart."""
    return packing.pack(docs, tokenizer_path(), keep_ids=True, keep_copy=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    release(spark, OWNER)
    return docs


#: Language identification is no SQL; the stages are tested one by one.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
