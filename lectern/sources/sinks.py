"""Writing datasets and search results (SNK1-SNK3).

The scalable layout is JSON lines partitioned by dataset (one task writes its
own part files; nothing is gathered).  The single-object layout ``{key: paper}``
per dataset file exists for exchange with the original file format; it gathers
one dataset into one row, so use it for datasets of bounded size only.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.session import ensure_checkpoint_dir

JSON_OPTIONS = {"ignoreNullFields": "false"}


def to_json_row(cols: Sequence[str | Column]) -> Column:
    """SNK3: one JSON object per row; timestamps as ``MM-dd-yyyy-HH-mm-ss``,
    NULL fields kept."""
    return F.to_json(F.struct(*cols), JSON_OPTIONS)


def format_timestamps(df: DataFrame) -> DataFrame:
    """Timestamp columns -> text in the saved format (SNK3, DAT1)."""
    return df.select(*[tx.format_ts(c).alias(c) if t.startswith("timestamp") else F.col(c)
                       for c, t in df.dtypes])


def write_papers(df: DataFrame, path: str, partition_by: Sequence[str] = ("dataset",),
                 mode: str = "overwrite") -> None:
    """SNK1/SNK2 scalable layout: JSON lines under ``dataset=<name>/`` folders."""
    format_timestamps(df).write.mode(mode).partitionBy(*partition_by).option("ignoreNullFields", "false").json(path)


def write_dataset_objects(df: DataFrame, path: str, key: str = "paper_key", order: str = "pos",
                          dataset: str = "dataset") -> None:
    """Compat layout: one ``{key: paper}`` JSON object per dataset, keys in ``order``."""
    fields = [c for c in df.columns if c not in (dataset, key, order)]
    rows = format_timestamps(df).select(dataset, order, F.col(key).cast("string").alias("_k"),
                                        F.struct(*fields).alias("_v"))
    obj = (rows.groupBy(dataset)
           .agg(F.array_sort(F.collect_list(F.struct(order, "_k", "_v"))).alias("_e"))
           .select(dataset, F.to_json(F.map_from_entries(
               F.transform("_e", lambda e: F.struct(e["_k"], e["_v"]))), JSON_OPTIONS).alias("value")))
    obj.write.mode("overwrite").partitionBy(dataset).text(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/lectern-{name}-{uuid.uuid4().hex[:12]}"


def save_search(results: DataFrame, folder: str, model: str, field: str, query: str) -> str:
    """SNK2: write a search result under ``{folder}/{model}_{field}_{words-joined-by-dash}``
    (JSON lines by dataset) and return that path."""
    spark = results.sparkSession
    name = spark.range(1).select(tx.search_name(F.lit(model), F.lit(field), F.lit(query))).first()[0]
    path = f"{folder.rstrip('/')}/{name}"
    write_papers(results, path)
    return path
