"""Paper datasets as DataFrames.

Two ways in:

* ``papers_from_documents`` adapts a flat document table (one row per text) to
  the paper columns used by search and profiling.
* ``read_datasets`` reads dataset files, each one JSON object mapping a paper
  key to a paper, into the same columns (SRC1/SRC2).

Every paper row carries ``dataset`` (the dataset name) and ``paper_key``; the
pair is unique.  File order is kept in ``pos`` for dataset files; for the
document adapter the order key is ``paper_key`` itself (``doc_id``), which
avoids a skew-prone window over each dataset.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files are split.  ``lectern.read.partitions``, if the caller has set it
    on the session, deals the rows of every table over that many partitions (for
    files of few row groups); column pruning and filter pushdown pass through."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    partitions = spark.conf.get("lectern.read.partitions", None)
    return df.repartition(int(partitions)) if partitions else df


def papers_from_documents(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text, lang, source, n_chars)`` -> paper columns.

    dataset=source, paper_key=doc_id, topic=lang, abstract=text,
    title=first line of text, n_chars kept for size reports.
    """
    return documents.select(
        F.col("source").alias("dataset"),
        F.col("doc_id").alias("paper_key"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.col("lang").alias("topic"),
        F.col("n_chars"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers view of ``documents``."""
    return papers_from_documents(read_table(spark, sf_dir, "documents"))


# SRC1 / SRC2 --------------------------------------------------------------------
def dataset_name(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def _last_wins(m: Column) -> Column:
    """A map without repeated keys (``from_json`` keeps them all); independent of the session's policy for them."""
    keys = F.map_keys(m)
    ends = F.transform(F.array_distinct(keys), lambda k: F.struct(k, F.element_at(F.map_values(m), -F.array_position(F.reverse(keys), k).cast("int"))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), m).otherwise(F.map_from_entries(ends))


def read_dataset_objects(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Dataset files -> ``(dataset, pos, paper_key, paper_json)``, file order kept.

    Each file is one JSON object; ``from_json`` to a map keeps keys in file order
    (``posexplode`` gives the position).  A repeated key counts once, at the place of the first with the value of the last.
    A file is one row here; ``objects.read_large_objects`` cuts large ones.
    """
    plist = [paths] if isinstance(paths, str) else list(paths)
    raw = (spark.read.text(plist, wholetext=True)
           .select(dataset_name(F.col("_metadata.file_path")).alias("dataset"),
                   F.from_json("value", "map<string,string>").alias("m"))
           .where(F.col("m").isNotNull()).select("dataset", _last_wins(F.col("m")).alias("m")))
    return raw.select("dataset", F.posexplode("m").alias("pos", "paper_key", "paper_json"))


def author_rows(paper: Column) -> Column:
    """Normalise both author-map forms to ``ARRAY<STRUCT<ord, name, institution>>``."""
    feed = F.transform(F.map_values(paper["authors"]),
                       lambda v, i: F.struct(i.alias("ord"), v.alias("name"),
                                             F.lit(None).cast("string").alias("institution")))
    api = F.transform(F.map_values(paper["author"]),
                      lambda v, i: F.struct(i.alias("ord"), v["fullname"].alias("name"),
                                            v["institution"].alias("institution")))
    return F.coalesce(api, feed)


def read_datasets(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Dataset files -> typed paper rows in one scan (one task per file)."""
    objs = read_dataset_objects(spark, paths)
    p = F.from_json("paper_json", schemas.PAPER)
    return (objs.select("dataset", "pos", "paper_key", p.alias("p"))
            .select("dataset", "pos", "paper_key",
                    F.coalesce(F.col("p.title"), F.col("p.name")).alias("title"),
                    "p.abstract", "p.url", "p.id", "p.pdf", "p.keywords", "p.topic",
                    "p.session", "p.event_type", "p.pmlr_pdf", "p.github_url", "p.conf_info",
                    "p.supplemental", "p.virtualsite_url", "p.paper_url", "p.paper_pdf_url",
                    "p.sourceurl", "p.metric_match", "p.metric_thres", "p.conference",
                    author_rows(F.col("p")).alias("authors")))


def split_dataset_name(dataset: str | Column) -> tuple[Column, Column]:
    """``{YEAR}_{CONF}`` -> (year INT, conference STRING) (TXT12)."""
    d = F.col(dataset) if isinstance(dataset, str) else dataset
    return (F.element_at(F.split(d, "_"), 1).try_cast("int"),
            F.try_element_at(F.split(d, "_"), F.lit(2)))
