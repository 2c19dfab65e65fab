"""Structured Streaming re-aim of "add datasets while running, search again" (STR1).

New document files landing in a folder are turned into papers, de-duplicated on
(dataset, paper_key) and either appended to a paper table or searched batch by
batch.  A per-batch top-k per dataset keeps every row that can be in the global
top-k, so re-applying the top-k when reading the results gives exactly the
result of a batch search over everything ingested so far.

``dropDuplicates`` keeps its keys for the life of the query; ``topk.stream_topk`` works in bounded
state on streams with an event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import search as srch
from lectern.operators.ranking import top_k_per_group
from lectern.sources.papers import papers_from_documents

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, folder: str, glob: str | None = None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Document files landing in ``folder`` (optionally only names matching ``glob``)."""
    reader = spark.readStream.schema(DOCUMENT_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(folder)


def paper_stream(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Streaming papers, each (dataset, paper_key) once."""
    return papers_from_documents(document_stream(spark, path, **kw)).dropDuplicates(["dataset", "paper_key"])


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, glob: str | None = None) -> None:
    """Append every new paper to a parquet table (``availableNow``: process what is
    there, then stop; restart-safe through the checkpoint)."""
    q = (paper_stream(spark, source, glob=glob).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
    q.awaitTermination()


def search_stream(spark: SparkSession, source: str, out: str, checkpoint: str, query: str,
                  model: str = "Cosine", field: str = "abstract", limit: int = 10,
                  threshold: float = 0.4, glob: str | None = None) -> None:
    """Search each micro-batch and append its per-dataset top-k (``foreachBatch``)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        res = srch.search(batch, query, model, field, limit, threshold)
        # a folder per batch: a batch that is run again replaces its own rows
        res.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (paper_stream(spark, source, glob=glob).writeStream.foreachBatch(run)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_search_results(spark: SparkSession, out: str, limit: int) -> DataFrame:
    """Merged results: the top-k per dataset over all batches."""
    res = spark.read.parquet(out)
    return top_k_per_group(res, "dataset", [F.col("metric_match").desc(), F.col("paper_key")], limit)
