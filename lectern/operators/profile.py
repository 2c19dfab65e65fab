"""Corpus profiling: frequency tables, alias merges, counter merges, rankings.

All counts are aggregates with map-side partial aggregation, so a hot value
(one keyword holding a third of the rows) costs one partial row per map task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency(df: DataFrame, value: str | Column, name: str = "value", count: str = "n") -> DataFrame:
    """AGG2: count of rows per value (NULL and ``""`` are values too)."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(v.alias(name)).agg(F.count(F.lit(1)).alias(count))


def flattened_frequency(df: DataFrame, values: str | Column, name: str = "value", count: str = "n") -> DataFrame:
    """AGG1: flatten a list column and count its elements (empty lists add nothing)."""
    v = F.col(values) if isinstance(values, str) else values
    return frequency(df.select(F.explode(v).alias(name)), name, name, count)


def first_seen_frequency(df: DataFrame, key: str, values: str | Column, name: str = "value",
                         count: str = "n") -> DataFrame:
    """AGG1 + the first appearance of each value as (key, position), for ties."""
    v = F.col(values) if isinstance(values, str) else values
    flat = df.select(key, F.posexplode(v).alias("_pos", name))
    return (flat.groupBy(name)
            .agg(F.count(F.lit(1)).alias(count),
                 F.min(F.struct(F.col(key).alias("key"), F.col("_pos").alias("pos"))).alias("_first"))
            .select(name, count, F.col("_first.key").alias("first_key"),
                    F.col("_first.pos").cast("long").alias("first_pos")))


def distinct_item_frequency(df: DataFrame, item: str | Sequence[str], value: str, count: str = "n") -> DataFrame:
    """AGG3: number of distinct items per value (an item with the value twice counts once)."""
    items = [item] if isinstance(item, str) else list(item)
    return (df.select(*items, value).dropDuplicates(items + [value])
            .groupBy(value).agg(F.count(F.lit(1)).alias(count)))


def alias_merge(counts: DataFrame, aliases: DataFrame, name: str = "value", count: str = "n",
                alias_col: str = "alias", canonical_col: str = "canonical") -> DataFrame:
    """JN8/AGG4: rename aliased values to their canonical name and add the counts.

    The alias table is small and user-given; a missing alias is a no-op (the
    reference raises KeyError).
    """
    a = aliases.select(F.col(alias_col).alias("_alias"), F.col(canonical_col).alias("_canon"))
    joined = counts.join(a, counts[name] == a["_alias"], "left")
    return (joined.groupBy(F.coalesce(F.col("_canon"), F.col(name)).alias(name))
            .agg(F.sum(count).cast("long").alias(count)))


def merge_counters(left: DataFrame, right: DataFrame, key: str = "value", count: str = "n") -> DataFrame:
    """JN10: dict.update semantics: every key of both; the right value overrides."""
    l = left.select(F.col(key).alias("_k"), F.col(count).alias("_l"))
    r = right.select(F.col(key).alias("_k2"), F.col(count).alias("_r"))
    return (l.join(r, F.col("_k").eqNullSafe(F.col("_k2")), "full_outer")
            .select(F.coalesce("_k", "_k2").alias(key), F.coalesce(F.col("_r"), F.col("_l")).alias(count)))


def top_n(counts: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """SRT1/SRT2: best n rows (planned as TakeOrderedAndProject: a per-task top-n
    then one merge of n rows per task)."""
    return counts.orderBy(*order).limit(n)


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """FLT9 value form: remove NULL and blank categories."""
    return df.filter(F.col(col).isNotNull() & (F.trim(F.col(col)) != ""))


def with_share(counts: DataFrame, count: str = "n") -> DataFrame:
    """WIN6: share of the total and the progress-style percent ``min(100, int(100*n/total))``.

    The total is a scalar subquery (one aggregate job), not a global window that
    would pull every row into one task.
    """
    total = counts.select(F.sum(count)).scalar()
    share = F.col(count).cast("double") / total.cast("double")
    return counts.withColumns({
        "share": share,
        "pct": F.least(F.lit(100), (share * 100).cast("int")),
    })
