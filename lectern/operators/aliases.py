"""Aliases of names found in the data (OPT1 for JN8): an edit-distance join by deletion neighbourhoods.

Two names within ``distance`` insertions, deletions and replacements of characters become equal when at most that many characters are
deleted from each.  So every name gives its deletions (about length ** distance of them, made natively), equal ones meet
in a shuffled equi-join, and the pairs that meet are checked with the exact distance.  No name is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import scratch_table


def _deletions(words: Column) -> Column:
    """All strings of an array, and each with one character deleted."""
    shorter = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 0, F.transform(
        F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(words, shorter))


def _meetings(left: DataFrame, right: DataFrame, a: str, b: str, distance: int, fits: Column) -> DataFrame:
    """The pairs of a name ``a`` of ``left`` and another ``b`` of ``right`` that fit and are at most ``distance`` apart, with all columns
    of both; a pair comes once for each variant that both reach.  Variants meet by their hashes, and the distance decides."""
    def shown(names: DataFrame, name: str) -> DataFrame:
        reached = F.array(name)
        for _ in range(distance):
            reached = _deletions(reached)
        return names.select("*", F.explode(F.transform(reached, lambda w: F.xxhash64(w))).alias("variant"))

    # A size estimated from the names' files knows nothing of their variants: both sides are shuffled, never broadcast.
    met = shown(left, a).hint("merge").join(shown(right, b).hint("merge"), "variant").where(fits & (F.col(a) != F.col(b)))
    return met.withColumn("distance", F.levenshtein(a, b, distance)).where(F.col("distance") >= 0).drop("variant")


def near_names(names: DataFrame, name: str = "name", distance: int = 1) -> DataFrame:
    """a, b (a < b), distance: the pairs of different names at most ``distance`` apart; null names take no part."""
    if distance < 1:
        raise ValueError("distance must be at least 1")
    distinct = scratch_table(names.select(F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct(), "alias-names")
    return _meetings(distinct.select(F.col("name").alias("a")), distinct.select(F.col("name").alias("b")), "a", "b", distance, F.col("a") < F.col("b")).distinct()


def find_aliases(counts: DataFrame, name: str = "name", count: str = "n", distance: int = 1, ratio: float = 2.0) -> DataFrame:
    """alias, canonical, n, canonical_n: each name that has a near name at least ``ratio`` times as frequent; its canonical is the
    most frequent of these (ties: the smallest).  A canonical name may be an alias itself; ``alias_merge`` renames once."""
    if distance < 1:
        raise ValueError("distance must be at least 1")
    known = counts.select(F.col(name).alias("name"), F.col(count).alias("n")).where(F.col("name").isNotNull()).groupBy("name").agg(F.sum("n").alias("n"))
    known = scratch_table(known, "alias-counts")
    # Counts travel with the names, so that pairs of like frequency end in the join; a pair that meets twice changes no minimum.
    met = _meetings(known.select(F.col("name").alias("alias"), "n"), known.select(F.col("name").alias("near"), F.col("n").alias("near_n")),
                    "alias", "near", distance, F.col("near_n") >= ratio * F.col("n"))
    best = met.groupBy("alias").agg(F.first("n").alias("n"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    return best.select("alias", F.col("best.near").alias("canonical"), "n", (-F.col("best.less")).alias("canonical_n"))
