"""Streaming queries (STR1): the documents file is the landing folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans import q_search
from lectern.plans.registry import ORACLE, query
from lectern.sources.papers import read_table
from lectern.sources.sinks import scratch_path
from lectern.streaming import ingest as st
from lectern.streaming import topk


def _landing(sf_dir: str) -> str:
    """The documents as a glob, which streams read whether it meets a file or a folder of parts."""
    return f"{sf_dir.rstrip('/')}/{{documents.parquet}}"


@query("stream_ingest", sql="""
SELECT DISTINCT source AS dataset, doc_id AS paper_key, split_part(text, chr(10), 1) AS title, lang AS topic, n_chars
FROM documents
""")
def stream_ingest(spark, sf_dir):
    """Streamed papers (de-duplicated) appended to a table, read back."""
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    st.ingest(spark, _landing(sf_dir), out, ckpt)
    return spark.read.parquet(out).select("dataset", "paper_key", "title", "topic", "n_chars")


@query("stream_search", sql=ORACLE["search_papers"])
def stream_search(spark, sf_dir):
    """Streamed search: per-batch top-k appended, merged on read; equals the batch flagship."""
    out, ckpt = scratch_path(spark, "stream-search"), scratch_path(spark, "stream-search-ckpt")
    st.search_stream(spark, _landing(sf_dir), out, ckpt, q_search.QUERY, "Cosine", "abstract",
                     q_search.LIMIT, q_search.THRESHOLD)
    res = st.read_search_results(spark, out, q_search.LIMIT)
    return res.select("dataset", "paper_key", "title", "metric_match", "metric_thres", "conference")


@query("stream_topk", sql="""
SELECT event_type, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d') AS until,
       row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY value DESC, event_id)::INTEGER AS rank,
       event_id, value
FROM events WHERE value IS NOT NULL QUALIFY rank <= 3
""")
def stream_topk(spark, sf_dir):
    """STR1 in bounded state: events land in four deliveries in the order of their time, a tenth of them one delivery late;
    the three greatest values of each type and day, as a batch job over all events finds them."""
    landing, out, checkpoint = (scratch_path(spark, f"stream-topk-{x}") for x in ("in", "out", "ckpt"))
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    first, last = events.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    part = (last - first) / 4 + 1
    delivered = F.floor((F.col("ts").cast("double") - first) / part) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    for i in range(4):  # the last delivery holds what is late by then
        some = events.where((F.least(delivered, F.lit(3)) == i)).repartition(2)
        some.write.mode("append").parquet(landing)
    schema = "event_id long, ts timestamp, event_type string, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "2").parquet(landing)
    topk.stream_topk(spark, stream, out, checkpoint, "event_type", "event_id", "value", "ts", 3, "1 day", f"{int(2 * part) + 1} seconds",
                     partitions=16)  # a few types, and the days within the delay
    return topk.read_topk(spark, out).select(F.col("group").alias("event_type"), F.date_format("until", "yyyy-MM-dd").alias("until"), "rank",
                                             F.col("key").alias("event_id"), F.col("score").alias("value"))
