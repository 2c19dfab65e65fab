"""Best rows of each group and event-time window over a stream, in bounded state (STR1).

The state of a group and window is its k best rows, however many arrive.  A row that is delivered again changes nothing.  When
the watermark passes the end of a window its state is dropped (rows that come later still are dropped by Spark); so
state grows with the open windows, not with the stream.  Each micro-batch emits the ranking of the groups that it changed; the last
one emitted counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Best(StatefulProcessor):
    """State: up to k rows (key, score), best first; ties go to the smaller key.  A key that comes again keeps its better score."""

    def __init__(self, k: int, key_type: str):
        self.k, self.key_type = k, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", f"key {self.key_type}, score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(k, s) for k, s in self.best.get()] if self.best.exists() else []
        if not held:
            self.handle.registerTimer(int(pd.Timestamp(key[1]).timestamp() * 1000))
        before = list(held)
        for part in rows:
            part = part[part["score"].notna()]  # no NaN, no null
            new = [*held, *zip(part["key"].tolist(), part["score"].tolist())]
            seen: set = set()
            held = []
            for k, s in sorted(new, key=lambda r: (-r[1], r[0])):
                if k not in seen and len(held) < self.k:
                    seen.add(k)
                    held.append((k, s))
        if held != before:
            self.best.put(held)
            yield pd.DataFrame({"group": key[0], "until": key[1], "rank": pd.Series(range(1, len(held) + 1), dtype="int32"),
                                "key": [k for k, _ in held], "score": [s for _, s in held]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_topk(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, group: str, key: str, score: str, event_time: str,
                k: int = 10, window: str = "1 day", delay: str = "1 day", partitions: int | None = None) -> None:
    """Read what there is of ``stream`` (``availableNow``; restart-safe through the checkpoint) and write the rankings that each micro-batch
    changed to ``out``, in a folder a batch, so that a batch that runs again replaces its own rows.  ``partitions`` of the state, kept for the
    life of the checkpoint, suit the groups and windows open at once (default: the session's shuffle partitions)."""
    key_type = dict(stream.dtypes)[key]
    rows = stream.withWatermark(event_time, delay).select(
        F.col(group).cast("string").alias("group"), F.window(event_time, window)["end"].alias("until"), F.col(key).alias("key"),
        F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")).alias("score"), event_time)
    best = rows.groupBy("group", "until").transformWithStateInPandas(
        _Best(k, key_type), f"group string, until timestamp, rank int, key {key_type}, score double", "Update", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    # Lists in state need this provider; the session's own settings come back afterwards.
    wanted = {PROVIDER: ROCKSDB} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    old = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        query = (best.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for name, value in old.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def read_topk(spark: SparkSession, out: str, key_type: str = "bigint") -> DataFrame:
    """group, until, rank, key, score: of each group and window the ranking emitted last."""
    rows = spark.read.schema(f"group string, until timestamp, rank int, key {key_type}, score double, batch_id bigint").parquet(out)
    last = rows.groupBy("group", "until").agg(F.max("batch_id").alias("last"))
    last = last.select(F.col("group").alias("_group"), F.col("until").alias("_until"), "last")
    same = F.col("group").eqNullSafe(F.col("_group")) & (F.col("until") == F.col("_until")) & (F.col("batch_id") == F.col("last"))
    return rows.join(last, same).select("group", "until", "rank", "key", "score")
