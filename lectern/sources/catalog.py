"""Dataset catalog from folders of dataset files (SRC8, SRC9, SRC10, AGG6).

Files are listed with the ``binaryFile`` source selecting only path, size and
modification time: the ``content`` column is pruned, so no file body is read.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import relational as rel


def list_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """``(path, name, stem, length, modified)`` for the files of a folder."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
                        "length", "modified")


def catalog_folders(spark: SparkSession, folders: Sequence[str], glob: str = "*") -> DataFrame:
    """SRC8/SRC9: files of several folders, numbered across folders in display
    order (folder, name case-insensitively), with size text, class and folder."""
    parts = [list_files(spark, f, glob).withColumn("folder_ord", F.lit(i)).withColumn("folder", F.lit(f))
             for i, f in enumerate(folders)]
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    entries = entries.withColumn("is_file", F.lit(1))
    out = rel.catalog(entries, name="name")
    return out.select("idx", "folder", "name", "stem", "length", tx.human_bytes("length").alias("size"),
                      rel.dataset_class("stem").alias("class"))


def folder_sizes(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """AGG6: total bytes per folder (files found recursively; Spark skips hidden
    names starting with ``.`` or ``_``)."""
    parts = [list_files(spark, f, recursive=True).withColumn("folder", F.lit(f)) for f in folders]
    allf = parts[0]
    for p in parts[1:]:
        allf = allf.unionByName(p)
    return (allf.groupBy("folder").agg(F.sum("length").cast("long").alias("bytes"))
            .withColumn("size", tx.human_bytes("bytes")))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: a one-word-per-line file -> distinct words (as a broadcastable table)."""
    return spark.read.text(path).select(F.col("value").alias("word")).filter(F.col("word") != "").distinct()
