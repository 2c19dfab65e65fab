"""Exact cosine neighbours over an inverted file of centroids (SIM7, OPT5).

``build_vector_index`` fits centroids on a bounded sample (at most SAMPLE vectors of unit length), assigns every row to
its nearest centroid and writes two tables under a folder:

* ``lists``: the rows (key, unit vector, distance ``r`` to the centroid), in one folder a list, cut into pieces of about PIECE rows;
* ``centroids``: one row a list: its centroid, the greatest ``r`` (its ball) and its pieces; at most MAX_LISTS rows.

``exact_neighbours`` is certain of its k best rows: for vectors of unit length the cosine falls with the distance, and by the triangle
inequality a member of a list is no closer to a query than the query is to the list's ball.  A first round reads the PROBED nearest
lists of each query; its k-th best score bounds the distance, and a second round reads every other list whose ball reaches
inside that bound, and of each list only the rows whose ``r`` does.  No list is left out that could hold a neighbour.

In a task, the rows of a piece are held (PIECE of them) and the queries stream past in batches; each (query, piece) gives k rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import vectors as vx
from lectern.session import scratch_table

SAMPLE, SAMPLE_BYTES, MAX_LISTS = 8192, 32 << 20, 1024
PIECE, PROBED, ROUNDS, BATCH = 1 << 13, 4, 12, 256
#: Scores count as equal when they agree in so many digits; bounds allow for rounding by SLACK.
DIGITS, SLACK = 9, 1e-7


def _units(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v (unit length) of the rows whose vector has a direction; the others have no cosine."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & whole & F.exists(vector, lambda x: x != 0))
    return some.select(F.col(key).alias("key"), vx.normalize(F.col(vector)).alias("v"))


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Centroids of sample vectors by Lloyd's rounds; an empty list keeps its centroid."""
    lists = max(1, min(lists, len(sample)))
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _distances(sample, centres).argmin(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=lists)
        np.add.at(sums, near, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (x ** 2).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres ** 2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squared, 0))


def _placed(vector: Column, shared) -> Column:
    """struct(list, r): the nearest centroid and the distance to it."""
    @F.pandas_udf("list int, r double")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for batch in batches:
            lists, far = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch))
            for at in range(0, len(batch), BATCH):
                d = _distances(np.stack(batch.iloc[at:at + BATCH]), centres)
                near = d.argmin(axis=1)
                lists[at:at + BATCH], far[at:at + BATCH] = near, d[np.arange(len(d)), near]
            yield pd.DataFrame({"list": lists, "r": far})

    return placed(vector)


def build_vector_index(df: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None,
                       piece: int = PIECE) -> None:
    """Write the index of all rows of ``df`` under ``path``; all vectors must have the same number of components."""
    spark, root = df.sparkSession, path.rstrip("/")
    units = scratch_table(_units(df, key, vector), "vector-units")
    total, low, high = units.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components")
    wanted = lists or round(math.sqrt(total))
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (high or 1))))
    teach = units.select("v").orderBy(F.xxhash64("v"), "v").limit(most)
    sample = np.array([r["v"] for r in teach.toLocalIterator()], dtype=float).reshape(-1, high or 1)
    centres = fit_centroids(sample, max(1, min(wanted, MAX_LISTS)))
    shared = spark.sparkContext.broadcast(centres)
    rows = units.select("key", "v", _placed(F.col("v"), shared).alias("p")).select("key", "v", "p.*")
    rows = scratch_table(rows, "vector-lists")
    sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("ball"))
    sizes = sizes.select("list", "n", "ball", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    made = spark.createDataFrame(list(enumerate(centres.tolist())), "list int, centre array<double>")
    made.join(sizes, "list").write.mode("overwrite").parquet(f"{root}/centroids")
    dealt = rows.join(sizes.select("list", "pieces"), "list")
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")).drop("pieces")
    dealt.repartition("list", "piece").sortWithinPartitions("list", "piece").write.mode("overwrite").partitionBy("list").parquet(f"{root}/lists")


class _Directory:
    """Centroids, balls and pieces of the lists; at most MAX_LISTS rows, so it is read by the driver and broadcast."""

    def __init__(self, spark: SparkSession, root: str):
        rows = spark.read.parquet(f"{root}/centroids").orderBy("list").collect()
        self.lists = np.array([r["list"] for r in rows], dtype=np.int32)
        self.centres = np.array([r["centre"] for r in rows], dtype=float)
        self.balls = np.array([r["ball"] for r in rows], dtype=float)
        self.pieces = np.array([r["pieces"] for r in rows], dtype=np.int32)
        self.rows = int(sum(r["n"] for r in rows))


def _lists_of(vector: Column, reach: Column, probed: Column, shared) -> Column:
    """array<struct(list, piece, d)> of the lists whose balls lie within ``reach`` of the query but were not ``probed`` before: the
    nearest PROBED if ``reach`` is null."""
    @F.pandas_udf("array<struct<list: int, piece: int, d: double>>")
    def chosen(vectors: pd.Series, reaches: pd.Series, before: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for v, reach_, old in zip(vectors, reaches, before):
            d = _distances(np.asarray(v)[None, :], m.centres)[0] if len(m.lists) else np.zeros(0)
            if reach_ is None or np.isnan(reach_):
                at = np.argsort(d, kind="stable")[:PROBED]
            else:
                at = np.flatnonzero((d - m.balls <= reach_) & ~np.isin(m.lists, [] if old is None else old))
            out.append([{"list": int(m.lists[i]), "piece": p, "d": float(d[i])} for i in at for p in range(m.pieces[i])])
        return pd.Series(out, dtype=object)

    return chosen(vector, reach, probed)


def _best(k: int):
    """Rows come sorted: of each piece first its rows, then the queries (q)."""
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, keys, far = None, [], [], []
        for batch in batches:
            places = batch[["list", "piece"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(axis=1)])
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                if here is None or (places[a] != here).any():
                    here, held, keys, far = places[a].copy(), [], [], []
                middle = a + int((~batch["asks"].iloc[a:b]).sum())
                if middle > a:
                    held.append(np.stack(batch["v"].iloc[a:middle]))
                    keys.append(batch["key"].iloc[a:middle].to_numpy())
                    far.append(batch["r"].iloc[a:middle].to_numpy(dtype=float))
                if middle < b and held:
                    held, keys, far = [np.concatenate(held)], [np.concatenate(keys)], [np.concatenate(far)]
                    for at in range(middle, b, BATCH):
                        yield from compared(held[0], keys[0], far[0], batch.iloc[at:min(at + BATCH, b)])

    def compared(rows: np.ndarray, keys: np.ndarray, far: np.ndarray, asked: pd.DataFrame) -> Iterator[pd.DataFrame]:
        scores = np.round(np.stack(asked["v"]) @ rows.T, DIGITS)
        # The query lies d from the centroid and a row r: they are at least |d - r| apart.
        apart = np.abs(asked["r"].to_numpy(dtype=float)[:, None] - far[None, :])
        reach = asked["reach"].to_numpy(dtype=float)
        scores[apart > np.where(np.isnan(reach), np.inf, reach)[:, None]] = -np.inf
        # A score below the bound that the first round gave is of no use; nor is one below the piece's own k-th best.
        scores[scores < (1 - np.where(np.isnan(reach), 2.0, reach) ** 2 / 2)[:, None] - SLACK] = -np.inf
        scores[asked["key"].to_numpy()[:, None] == keys[None, :]] = -np.inf
        order = np.argsort(keys, kind="stable")
        lines = scores[:, order]
        some = np.flatnonzero(np.isfinite(lines).any(axis=1))
        if not len(some):
            return
        lines = lines[some]
        least = np.partition(lines, -k, axis=1)[:, -k] if lines.shape[1] > k else np.full(len(lines), -np.inf)
        take = np.isfinite(lines) & (lines >= least[:, None])
        for i in np.flatnonzero(take.sum(axis=1) > k):  # ties of the k-th best: those of the smallest keys
            take[i] = False
            take[i, np.argsort(-lines[i], kind="stable")[:k]] = True
        i, j = np.nonzero(take)
        yield pd.DataFrame({"q": asked["q"].to_numpy()[some[i]], "key": keys[order[j]], "score": lines[i, j]})

    return best


def exact_neighbours(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, rank, key, score, lists (those read for the query): the k rows of greatest cosine to each row of ``queries``, its own key left out,
    ties by key; scores are rounded to nine digits."""
    root = path.rstrip("/")
    directory = _Directory(spark, root)
    shared = spark.sparkContext.broadcast(directory)
    kind = dict(queries.dtypes)[key]
    # With its schema given, an index without rows can be read too.
    rows = spark.read.schema(f"key {kind}, v array<double>, r double, piece int, list int").parquet(f"{root}/lists")
    asked = scratch_table(_units(queries, key, vector).select(F.monotonically_increasing_id().alias("q"), "key", "v"), "vector-queries")

    def looked_up(some: DataFrame, read: DataFrame) -> DataFrame:
        """some: q, key, v, reach, places."""
        probes = some.select("q", "key", "v", "reach", F.inline("places"))
        both = (read.select("list", "piece", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("q"), "key", "v", "r", F.lit(None).cast("double").alias("reach"))
                .unionByName(probes.select("list", "piece", F.lit(True).alias("asks"), "q", "key", "v", F.col("d").alias("r"), "reach")))
        place = ("list", "piece")
        # A number is given, since the work of a task is no matter of its bytes: partitions must not be put together by size.
        met = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place, "asks")
        return met.mapInPandas(_best(k), f"q long, key {kind}, score double")

    none = F.lit(None).cast("array<int>")
    first = asked.withColumn("reach", F.lit(None).cast("double"))
    first = scratch_table(first.withColumn("places", _lists_of(F.col("v"), F.col("reach"), none, shared)), "vector-probes")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "key")
    found = looked_up(first, rows).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
    found = scratch_table(found, "vector-found")
    reached = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    # For unit vectors the squared distance is 2 - 2 cos; a query without k neighbours reaches every list.
    reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0)) + SLACK)).otherwise(3.0)
    before = F.array_distinct(F.transform("places", lambda p: p["list"]))
    again = first.drop("reach").join(reached, "q", "left").select("q", "key", "v", F.coalesce(reach, F.lit(3.0)).alias("reach"), before.alias("before"))
    again = scratch_table(again.withColumn("places", _lists_of(F.col("v"), F.col("reach"), F.col("before"), shared)), "vector-probes")
    found = found.unionByName(looked_up(again.where(F.size("places") > 0), rows))
    rank = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    lists = F.size("before") + F.size(F.array_distinct(F.transform("places", lambda p: p["list"])))
    named = again.select("q", F.col("key").alias("query"), lists.alias("lists"))
    return rank.join(named, "q").select("query", "rank", F.col("key").alias(key), "score", "lists")


def index_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Lists and rows of an index."""
    directory = _Directory(spark, path.rstrip("/"))
    return len(directory.lists), directory.rows
