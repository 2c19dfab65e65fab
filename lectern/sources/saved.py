"""Saved searches as datasets (SNK2, SIM11).

A folder of saved searches is a registry: each search is a folder ``dataset=<name>`` of JSON lines, one keyed paper a
line.  Saving a search again replaces that folder alone (dynamic partition overwrite); the others stay.  Names
and sizes come from the files themselves, so nothing else has to be kept in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx
from lectern.sources.sinks import JSON_OPTIONS, format_timestamps

#: What a search adds to its papers (fixed values).
METRICS = "metric_match double, metric_thres double, conference string"


def save_as_dataset(results: DataFrame, folder: str, model: str, field: str, query: str) -> None:
    """Write the hits of a search as the dataset that is named after it; each task writes its own part."""
    name = tx.search_name(F.lit(model), F.lit(field), F.lit(query))
    rows = format_timestamps(results.withColumn("dataset", name))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**JSON_OPTIONS)
     .partitionBy("dataset").json(folder))


def _dataset(path: Column) -> Column:
    """The dataset of a file, from its folder (Spark escapes some characters of folder names, files of ``_metadata`` once more)."""
    return F.url_decode(F.url_decode(F.regexp_extract(path, r"/dataset=([^/]+)/[^/]*$", 1)))


def saved_papers(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """Papers of all saved searches in ``folder``: dataset (from the file's path), then ``schema``, which is the paper
    columns (without dataset) and, if wanted, METRICS."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    read = spark.read.schema(fields).option("recursiveFileLookup", "true").json(folder)
    return read.select(_dataset(F.col("_metadata.file_path")).alias("dataset"), *fields.names)


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """One row per saved search: dataset, files, bytes, saved (time of its last file); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    return (files.select(_dataset(F.col("path")).alias("dataset"), "length", "modificationTime")
            .groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("saved")))


def with_saved(papers: DataFrame, folder: str) -> DataFrame:
    """The papers and those of the saved searches, as further datasets next to the loaded ones."""
    kept = [f for f in papers.schema.fields if f.name != "dataset"]
    return papers.unionByName(saved_papers(papers.sparkSession, folder, T.StructType(kept)))
