"""The streaming top-k in bounded state: late rows, repeated rows, restarts, closed windows."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.streaming import topk

SCHEMA = "id long, ts timestamp, kind string, value double"


def _land(spark, rows, folder):
    at = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), k, v) for i, h, k, v in rows]
    spark.createDataFrame(at, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, base, k=2):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{base}/in")
    topk.stream_topk(spark, stream, f"{base}/out", f"{base}/ckpt", "kind", "id", "value", "ts", k, "1 day", "12 hours")
    rows = topk.read_topk(spark, f"{base}/out").withColumn("day", F.dayofmonth("until")).collect()
    assert len(rows) == len({(r.group, r.day, r["rank"]) for r in rows})
    return {(r.group, r.day, r["rank"], r.key, r.score) for r in rows}


def test_rows_late_repeated_and_too_late(spark, tmp_path):
    base = str(tmp_path)
    _land(spark, [(1, 1, "a", 5.0), (2, 2, "a", 7.0), (3, 3, "b", 1.0), (4, 4, "a", None), (5, 5, "a", float("nan")), (6, 23, None, 2.0)], f"{base}/in")
    _land(spark, [(7, 30, "a", 4.0), (2, 2, "a", 7.0), (8, 20, "a", 6.0)], f"{base}/in")  # 8 is late, within the delay
    want = {("a", 2, 1, 2, 7.0), ("a", 2, 2, 8, 6.0), ("b", 2, 1, 3, 1.0), ("a", 3, 1, 7, 4.0), (None, 2, 1, 6, 2.0)}
    assert _run(spark, base) == want
    assert _run(spark, base) == want  # nothing new: the same result, from the checkpoint
    _land(spark, [(9, 100, "c", 1.0)], f"{base}/in")  # moves the watermark past the first two days
    _land(spark, [(10, 1, "a", 99.0), (11, 95, "c", 3.0)], f"{base}/in")  # 10 is too late
    assert _run(spark, base) == want | {("c", 6, 1, 9, 1.0), ("c", 5, 1, 11, 3.0)}


def test_state_holds_k_rows(spark, tmp_path):
    base = str(tmp_path)
    for part in range(3):
        _land(spark, [(part * 100 + i, part, "a", float((i * 37 + part) % 101)) for i in range(100)], f"{base}/in")
    got = _run(spark, base, k=4)
    every = sorted(((-float((i * 37 + p) % 101), p * 100 + i) for p in range(3) for i in range(100)))[:4]
    assert {(r[2], r[3], r[4]) for r in got} == {(i + 1, key, -v) for i, (v, key) in enumerate(every)}
    # What a micro-batch emits of a group is never more than k rows.
    out = spark.read.schema("group string, until timestamp, rank int, key bigint, score double, batch_id bigint").parquet(f"{base}/out")
    assert out.groupBy("group", "until", "batch_id").count().agg(F.max("count")).first()[0] == 4
