"""Exact top-k search by inner product with a vector-approximation file.

Vectors become integers, floor(scale * x).  The approximation of a vector is one byte a
component, the cell of equal width that it lies in.  With q a query and L the lower corner of a vector's
cells, the score lies in [q.L + low(q), q.L + high(q)], where low and high depend on the query and
the cell width alone.

1. Queries and approximations are dealt into blocks of bounded size, and every pair of blocks is one
   task's work: one matrix product bounds all scores.  Kept are, of a block, the vectors whose upper
   bound reaches the (k + 1)-th best lower bound there.
2. Over all blocks, the (k + 1)-th best lower bound of a query excludes most of these.
3. The exact vectors of the rest are read and scored: no other vector can be among the first k,
   the query's own left out.

Equal vectors are searched once and stand for their k + 1 first rows (by id), which are all that can
be in a result, so that many copies of a vector do not make many candidates.

Defined cases: vectors that are null, empty or hold nulls or values that are not finite take no part, nor do rows
without an id; rows that repeat an id are separate rows, and a query leaves out its own row only; vectors of
another number of components than the query's are no candidates; ties go to the smaller id, then the first row; fewer
than k candidates are all returned; an empty table gives an empty result; extra columns are ignored.
Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import scratch_table

CELLS = 256
QUERY_BLOCK = 1 << 10
DATA_BLOCK = 1 << 13


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False)) & (F.size(vector) > 0)


def cells(vector: Column, low: int, width: int) -> Column:
    """The approximation: one byte a component."""
    @F.pandas_udf("binary")
    def coded(batch: pd.Series) -> pd.Series:
        return pd.Series([((np.asarray(v, dtype=np.int64) - low) // width).astype(np.uint8).tobytes() for v in batch], dtype=object)

    return coded(vector)


def bounds_search(k: int, low: int, width: int):
    """For a block of queries and a block of approximations: candidates with the product of
    query and lower corner, and the query's span between lower and upper bound."""
    def search(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "rep": [], "corner": [], "span": []})
        if not len(queries) or not len(data):
            return none
        q = np.stack([np.asarray(v, dtype=np.float64) for v in queries["v"]])
        codes = np.frombuffer(b"".join(data["cells"]), dtype=np.uint8).reshape(len(data), -1)
        corners = low + codes.astype(np.float64) * width
        product = q @ corners.T
        # The last term covers rounding in the product.
        span = (width - 1) * np.abs(q).sum(axis=1) + 1e-9 * (np.abs(q).sum(axis=1) * np.abs(corners).max())
        nth = min(k + 1, product.shape[1])
        least = np.partition(product, -nth, axis=1)[:, -nth]
        i, j = np.nonzero(product >= (least - span)[:, None])
        return pd.DataFrame({"query_id": queries["id"].to_numpy()[i], "rep": data["rep"].to_numpy()[j],
                             "corner": product[i, j], "span": span[i]})

    return lambda _, queries, data: search(queries, data)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows."""
    rows = (vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"),
                    F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row")))
    rows = scratch_table(rows, "topk-rows")
    order = Window.partitionBy("v").orderBy("id", "row")
    members = scratch_table(rows.select("id", "v", "row", F.row_number().over(order).alias("n"), F.first("row").over(order).alias("rep"))
                            .where(F.col("n") <= k + 1), "topk-members")
    distinct = members.where("n = 1")
    lowest, highest, count, asked = (
        distinct.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.count(F.lit(1))).first()
        + rows.where("q").agg(F.count(F.lit(1))).first())
    low = lowest or 0
    width = max(1, -(-((highest or 0) - low + 1) // CELLS))
    n_data, n_query = -(-max(count, 1) // DATA_BLOCK), -(-max(asked, 1) // QUERY_BLOCK)
    approximations = distinct.select("rep", F.size("v").alias("dim"), cells(F.col("v"), low, width).alias("cells"))
    approximations = scratch_table(approximations, "topk-cells")
    # A block of one side meets every block of the other side in a task of its own.
    data = (approximations.withColumn("db", F.pmod(F.xxhash64("rep"), F.lit(n_data)))
            .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long")))))
    # Inside, a query is known by its row.
    queries = rows.where("q").select(F.col("row").alias("id"), F.col("id").alias("asked_id"), "v", F.size("v").alias("dim"))
    blocks = (queries.drop("asked_id").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_query)))
              .withColumn("db", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_data - 1).cast("long")))))
    key = ["dim", "qb", "db"]
    near = blocks.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(
        bounds_search(k, low, width), "query_id long, rep long, corner double, span double")
    near = scratch_table(near, "topk-near")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("corner").desc()))
    least = (near.select("query_id", "corner").withColumn("n", place).where(F.col("n") <= k + 1)
             .groupBy(F.col("query_id").alias("l_id")).agg(F.min("corner").alias("least")))
    sure = near.join(least, F.col("query_id") == F.col("l_id")).where(F.col("corner") >= F.col("least") - F.col("span"))
    exact = (sure.select("query_id", "rep").join(distinct.select("rep", F.col("v").alias("x")), "rep")
             .join(queries.select(F.col("id").alias("query_id"), "asked_id", "v"), "query_id"))
    score = F.aggregate(F.zip_with("x", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    scored = (exact.select("query_id", "asked_id", "rep", score.alias("score"))
              .join(members.select("rep", "row", F.col("id").alias("vec_id")), "rep"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "row"))
    return (scored.where("row != query_id").withColumn("rank", rank).where(F.col("rank") <= k)
            .select(F.col("asked_id").alias("query_id"), "rank", "vec_id", "score"))
