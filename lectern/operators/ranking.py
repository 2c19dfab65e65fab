"""Thresholds, per-group top-k, last-wins merges and skew-safe positions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_filter(df: DataFrame, score: str, threshold: float, strict: bool = False,
                     as_float: bool = True) -> DataFrame:
    """FLT3: keep rows whose score passes the threshold.

    NULL and NaN never pass (Spark orders NaN above every number, so it is
    removed explicitly).  Vector scorers compare in float32 with ``>=``; the
    fuzzy scorer compares the double score with a strict ``>``.
    """
    s = F.nanvl(F.col(score), F.lit(None).cast("double"))  # one reference: NaN -> NULL
    if as_float:
        s = s.cast("float")
        t = F.lit(float(threshold)).cast("float")
    else:
        t = F.lit(float(threshold))
    return df.filter((s > t) if strict else (s >= t))


def top_k_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column],
                    k: int, rank_col: str | None = None, fan_in: int | None = None) -> DataFrame:
    """WIN2: at most ``k`` rows per group by ``order``.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the
    shuffle, so each map task sends at most k rows per group.  With ``fan_in``
    the limit becomes a two-level tree: first per (group, bucket of map tasks),
    then per group, so the last task of a group holding a third of a very large
    input reads at most ``k * fan_in`` rows instead of k rows from every map
    task.  The top-k of a union equals the top-k of the parts' top-k's, so the
    result is exact whatever the bucket assignment.
    """
    if k < 0:
        raise ValueError("limit must be >= 0")
    groups = [group] if isinstance(group, str) else list(group)
    if fan_in:
        bucket = F.pmod(F.spark_partition_id(), F.lit(int(fan_in)))
        w1 = Window.partitionBy(*groups, "_bucket").orderBy(*order)
        df = (df.withColumn("_bucket", bucket).withColumn("_r1", F.row_number().over(w1))
              .filter(F.col("_r1") <= k).drop("_r1", "_bucket"))
    w = Window.partitionBy(*groups).orderBy(*order)
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)


def last_wins(df: DataFrame, key: str | Sequence[str], order_col: str) -> DataFrame:
    """WIN3: one row per key, the one with the greatest ``order_col``.

    Written as an aggregate (``max_by`` over a struct) so Spark combines map-side:
    a hot key costs one partial row per map task instead of all its rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys)
            .agg(F.max_by(packed, F.struct(F.col(order_col).isNotNull(), F.col(order_col))).alias("_w"))
            .select(*keys, *[F.col("_w")[c].alias(c) for c in others]))


def dense_position(df: DataFrame, group: str, order: str | Sequence[str | Column], out: str = "pos",
                   num_partitions: int | None = None) -> DataFrame:
    """WIN1 without a per-group window: 0-based position of each row within its
    group by ``order`` (one or more columns, unique inside a group).

    ``row_number().over(partitionBy(group))`` puts a whole group in one task; a
    group holding a third of the data would then hold a third of the job.  Here
    rows are range-partitioned on (group, order) so a hot group spreads over many
    tasks.  After a sort inside each partition, ``monotonically_increasing_id``
    numbers rows locally (partition id in the high bits).  Those ids are only
    stable for one materialisation, so the tagged rows are written once with a
    reliable ``checkpoint`` (into ``spark.checkpoint.dir``, surviving executor
    loss) and both the per-(group, partition) count table and the rows read that
    copy.  The count table has at most (#partitions + #groups) rows; AQE
    broadcasts it when its measured size allows and shuffles otherwise.
    """
    from lectern.session import cut_lineage
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    low_bits = (1 << 33) - 1
    keys = [order] if isinstance(order, (str, Column)) else list(order)
    tagged = (df.repartitionByRange(n, group, *keys).sortWithinPartitions(group, *keys)
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged).withColumns({
        "_pid": F.shiftright("_mid", 33), "_loc": F.col("_mid").bitwiseAND(F.lit(low_bits))})
    counts = tagged.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                               F.min("_loc").alias("_first"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_pid", "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    offsets = offsets.withColumnsRenamed({group: "_group", "_pid": "_part"})
    return (tagged.join(offsets, tagged[group].eqNullSafe(offsets["_group"]) & (tagged["_pid"] == offsets["_part"]))
            .withColumn(out, (F.col("_off") + F.col("_loc") - F.col("_first")).cast("long"))
            .drop("_mid", "_pid", "_loc", "_first", "_off", "_group", "_part"))


def first_wins(df: DataFrame, key: str | Sequence[str], order_col: str) -> DataFrame:
    """WIN4: one row per key, the one with the smallest ``order_col`` (e.g. the
    first occurrence in file order).  Aggregate form, combined map-side."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys)
            .agg(F.min_by(packed, F.col(order_col)).alias("_w"))
            .select(*keys, *[F.col("_w")[c].alias(c) for c in others]))
