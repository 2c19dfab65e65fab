"""Approximate nearest neighbours (Euclidean) by multi-index hashing.

* **Codes.**  A vector becomes BITS signs.  The planes are learned on a bounded sample (at most SAMPLE
  distinct vectors and SAMPLE_BYTES): centring, principal directions, then rotations that bring the sample
  close to the corners of a cube (iterative quantisation), as many rotations as it takes for BITS.
* **Index.**  A code is split into TABLES substrings; a row for each (table, substring).  Every distinct
  vector of the input is indexed.
* **Probing.**  A code within ``radius`` of the query's is within ``threshold(radius)[t]`` in the substring
  of at least one table t (pigeonhole).  Index rows and the queries that can reach them meet by the leading bits of
  the substring; there the substrings are compared, then the whole codes, and a pair comes out of the first
  table that retrieves it, once.  All codes within the radius are retrieved, no others.
* **Radius.**  Two vectors at an angle a differ in BITS * a / pi bits on average; SPREAD standard deviations more (as measured on
  pairs of the sample) make a radius that misses such a pair rarely.  A query's first radius is a guess from its distances to the sample's codes
  (about CANDIDATES codes).  The k-th best vector found, scored exactly, bounds the angles that matter; queries whose first radius
  falls short of that, or that found fewer than k, are probed once more for the rest, with a radius that
  k sample vectors already satisfy (all bits if the sample has fewer).
* **Rerank.**  Distances come from the original vectors, in double precision.

Equal vectors are indexed and searched once and stand for their k + 1 first rows (by id), which are all that a result can
hold.  A part of the index that many codes share is split into pieces of about UNIT codes, and
queries stream past the codes of a piece, so a task holds UNIT codes and one batch of queries.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; rows that repeat an id are separate rows, and a query leaves out its own row only; vectors of another
number of components than the query's are no candidates; ties go to the smaller id, then the first row; fewer than k candidates are all
returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import scratch_table

BITS = 512
TABLES = 16
WIDTH = BITS // TABLES  # bits of a substring: numpy's uint32
#: Leading bits of a substring by which the index is dealt out, at most.
LEAD = 16
SAMPLE, SAMPLE_BYTES = 4096, 32 << 20
#: Codes that a first radius is meant to retrieve, and standard deviations added to a mean Hamming distance: one
#: in twenty vectors as far off as the k-th best may be missed, of nearer ones fewer.
CANDIDATES, SPREAD = 400, 1.64
UNIT = 1 << 14
#: Queries compared with a piece of the index at once, and pairs whose whole codes are compared at once.
ASKED, PAIRS = 128, 1 << 17
ROUNDS = 30


# --- codes -----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    scale: float
    mean: np.ndarray  # of the scaled vectors
    planes: np.ndarray  # components by BITS
    sample: np.ndarray  # centred vectors of the sample
    codes: np.ndarray  # and their codes
    noise: float = 1.0  # standard deviation of Hamming distances, against that of independent bits

    def needed(self, angle):
        """The radius that vectors at this angle are within, nearly always."""
        p = np.clip(angle / math.pi, 0, 1)
        return np.minimum(BITS, np.ceil(BITS * p + SPREAD * self.noise * np.sqrt(BITS * p * (1 - p))))

    def centred(self, vectors: list) -> np.ndarray:
        """Scaled and centred, with the model's number of components (padded or cut, for odd vectors)."""
        out = np.zeros((len(vectors), len(self.mean)))
        for i, v in enumerate(vectors):
            out[i, :len(v)] = v[:len(self.mean)]
        return out / self.scale - self.mean

    def code(self, centred: np.ndarray) -> np.ndarray:
        return np.packbits(centred @ self.planes > 0, axis=1).view(np.uint64)


def rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """An orthogonal matrix that brings the rows of ``x`` close to corners of a cube."""
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1],) * 2))
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(x.T @ np.where(x @ turn > 0, 1.0, -1.0))
        turn = left @ right
    return turn


def fit(vectors: list) -> Model:
    """A model of sample vectors; those of the most frequent number of components teach."""
    size = Counter(map(len, vectors)).most_common(1)[0][0] if vectors else 1
    x = np.array([v for v in vectors if len(v) == size], dtype=float).reshape(-1, size)
    scale = float(np.abs(x).max(initial=0)) or 1.0
    x = x / scale
    mean = x.mean(axis=0) if len(x) else np.zeros(size)
    x = x - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :min(size, BITS)]
    turned = [axes @ rotation(x @ axes, seed) for seed in range(-(-BITS // axes.shape[1]))]
    planes = np.hstack(turned)[:, :BITS]
    codes = Model(scale, mean, planes, x, np.zeros((0, BITS // 64), dtype=np.uint64)).code(x)
    return Model(scale, mean, planes, x, codes, noise_of(x, codes))


def noise_of(x: np.ndarray, codes: np.ndarray) -> float:
    lengths = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    off, own = 0.0, 0.0
    for i in range(0, len(x), max(1, len(x) // 256)):
        p = np.arccos(np.clip(x @ x[i] / lengths / lengths[i], -1, 1)) / math.pi
        off += float(((np.bitwise_count(codes ^ codes[i]).sum(axis=1, dtype=np.int64) - BITS * p) ** 2).sum())
        own += float((BITS * p * (1 - p)).sum())
    return max(0.25, math.sqrt(off / own)) if own > 0 else 1.0


def thresholds(radius: int) -> np.ndarray:
    """By table: bits by which a substring may differ; -1 if the table need not be probed."""
    if radius >= BITS:
        return np.array([WIDTH] + [-1] * (TABLES - 1))
    each, more = divmod(radius + 1, TABLES)
    return each - 1 + (np.arange(TABLES) < more)


def coded(vector: Column, shared) -> Column:
    """struct(code, norm): the code, and the length of the centred vector."""
    @F.pandas_udf("code binary, norm double")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = shared.value.centred(batch.tolist())
            yield pd.DataFrame({"code": [c.tobytes() for c in shared.value.code(x)], "norm": np.linalg.norm(x, axis=1)})

    return made(vector)


def radii(vector: Column, shared, k: int, total: int) -> Column:
    """struct(first, sure): the first radius of a query, and one within which the sample alone has k vectors."""
    share = CANDIDATES / max(total, 1)

    @F.pandas_udf("first int, sure int")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        lengths = np.linalg.norm(m.sample, axis=1)
        for batch in batches:
            out = []
            for v in batch:
                if len(v) != len(m.mean) or len(m.sample) < k:
                    out.append((BITS, BITS))
                    continue
                x = m.centred([v])
                bits = np.bitwise_count(m.codes ^ m.code(x)).sum(axis=1, dtype=np.int64)
                near = np.argpartition(((m.sample - x) ** 2).sum(axis=1), k - 1)[:k]
                cos = m.sample[near] @ x[0] / np.maximum(lengths[near] * np.linalg.norm(x), 1e-300)
                sure = int(max(bits[near].max(), m.needed(np.arccos(np.clip(cos, -1, 1)).max())))
                first = bits.mean() + bits.std() * NormalDist().inv_cdf(share) if share < 0.5 else BITS
                out.append((min(sure, max(0, math.ceil(first))), sure))
            yield pd.DataFrame(out, columns=["first", "sure"], dtype=np.int32)

    return made(vector)


# --- probing ---------------------------------------------------------------------------------
def _places(lead: int):
    """Two UDFs: the units (table and leading ``lead`` bits of its substring) of a code, and those that a query must probe."""
    masks = sorted(range(1 << lead), key=lambda x: (x.bit_count(), x))
    reach = np.searchsorted([x.bit_count() for x in masks], np.arange(-1, WIDTH + 1), side="right")
    masks = np.array(masks, dtype=np.int64)
    first = np.arange(TABLES, dtype=np.int64) << LEAD

    def leading(code: bytes) -> np.ndarray:
        return np.frombuffer(code, dtype=np.uint32).astype(np.int64) >> (WIDTH - lead)

    @F.pandas_udf("array<int>")
    def own(codes: pd.Series) -> pd.Series:
        return pd.Series([(first | leading(c)).astype(np.int32) for c in codes], dtype=object)

    @F.pandas_udf("array<int>")
    def probed(codes: pd.Series, radius: pd.Series) -> pd.Series:
        out = []
        for c, r in zip(codes, radius):
            at = leading(c)
            out.append(np.concatenate([first[t] | (at[t] ^ masks[:reach[d + 1]]) for t, d in enumerate(thresholds(r))]).astype(np.int32))
        return pd.Series(out, dtype=object)

    return own, probed


def _compared(table: int, codes: np.ndarray, reps: np.ndarray, asked: pd.DataFrame, questions: np.ndarray) -> Iterator[pd.DataFrame]:
    """Pairs that this table is the first to retrieve and that are within the radius."""
    parts, ours = codes.view(np.uint32), questions.view(np.uint32)
    ids, low, radius = (asked[c].to_numpy() for c in ("q", "low", "radius"))
    limit = np.array([thresholds(r) for r in radius])
    for at in range(0, len(ids), ASKED):
        apart = np.bitwise_count(ours[at:at + ASKED, table][:, None] ^ parts[:, table][None, :])
        i, j = np.nonzero(apart <= limit[at:at + ASKED, table][:, None])
        for part in range(0, len(i), PAIRS):
            x, y = i[part:part + PAIRS] + at, j[part:part + PAIRS]
            bits = np.bitwise_count(questions[x] ^ codes[y]).sum(axis=1, dtype=np.int64)
            keep = (bits > low[x]) & (bits <= radius[x])
            x, y = x[keep], y[keep]
            before = np.bitwise_count(ours[x, :table] ^ parts[y, :table]) <= limit[x, :table]
            new = ~before.any(axis=1)
            if new.any():
                yield pd.DataFrame({"q": ids[x[new]], "rep": reps[y[new]]})


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted: of each piece of the index first its codes (rep), then the queries (q)."""
    here, codes, reps = None, [], []
    for batch in batches:
        places = batch[["dim", "unit", "piece"]].to_numpy()
        every = np.frombuffer(b"".join(batch["code"]), dtype=np.uint64).reshape(-1, BITS // 64)
        starts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(axis=1)])
        for a, b in zip(starts, [*starts[1:], len(batch)]):
            if here is None or (places[a] != here).any():
                here, codes, reps = places[a].copy(), [], []
            middle = a + int(batch["q"].iloc[a:b].isna().sum())
            if middle > a:
                codes.append(every[a:middle])
                reps.append(batch["rep"].iloc[a:middle].to_numpy(dtype=np.int64))
            if middle < b and codes:
                codes, reps = [np.concatenate(codes)], [np.concatenate(reps)]
                yield from _compared(int(here[1]) >> LEAD, codes[0], reps[0], batch.iloc[middle:b], every[middle:b].copy())


class Index:
    """Codes of distinct vectors (rep, dim, code, ...: a written table), by substrings."""

    def __init__(self, distinct: DataFrame, total: int, unit: int = UNIT):
        self.unit = unit
        lead = min(LEAD, max(0, math.ceil(math.log2(max(total, 1) / unit))))
        own, self.probed = _places(lead)
        self.rows = distinct.select("dim", F.explode(own("code")).alias("unit"), "rep", "code")
        counts = self.rows.groupBy("dim", "unit").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > unit)
        self.pieces = scratch_table(counts.select("dim", "unit", F.ceil(F.col("c") / unit).cast("int").alias("pieces")), "ann-pieces")

    def within(self, queries: DataFrame) -> DataFrame:
        """(q, rep) of all codes with low < Hamming distance <= radius; queries: q, dim, code, low, radius."""
        key = ["dim", "unit"]
        pieces = F.coalesce("pieces", F.lit(1))
        data = (self.rows.join(self.pieces, key, "left")
                .select(*key, F.pmod(F.xxhash64("rep"), pieces).cast("int").alias("piece"), F.lit(None).cast("long").alias("q"),
                        "rep", "code", F.lit(0).alias("low"), F.lit(0).alias("radius")))
        probes = queries.withColumn("unit", F.explode(self.probed("code", "radius"))).join(self.pieces, key, "left")
        probes = probes.select(*key, F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "q",
                               F.lit(None).cast("long").alias("rep"), "code", "low", "radius")
        place = [*key, "piece"]
        both = data.unionByName(probes).repartition(*place).sortWithinPartitions(*place, F.col("q").asc_nulls_first())
        return both.mapInPandas(_met, "q long, rep long")


# --- search ----------------------------------------------------------------------------------
def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other rows found."""
    spark = vectors.sparkSession
    rows = scratch_table(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                       F.coalesce(is_query, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row"))
        .where(F.col("id").isNotNull() & usable(F.col("v"))), "ann-rows")
    order = Window.partitionBy("v").orderBy("id", "row")
    members = scratch_table(rows.select("id", "v", "row", F.row_number().over(order).alias("n"), F.first("row").over(order).alias("rep"))
                            .where(F.col("n") <= k + 1), "ann-members")
    bare = members.where("n = 1").select("rep", "v")
    total, widest = bare.agg(F.count(F.lit(1)), F.coalesce(F.percentile_approx(F.size("v"), 0.5), F.lit(1))).first()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))
    teach = bare.select(F.slice("v", 1, SAMPLE_BYTES // 8).alias("v")).where(F.size("v") <= widest).orderBy(F.xxhash64("v"), "v").limit(most)
    shared = spark.sparkContext.broadcast(fit([r["v"] for r in teach.toLocalIterator()]))
    distinct = scratch_table(bare.select("rep", "v", F.size("v").alias("dim"), coded(F.col("v"), shared).alias("c"))
                             .select("rep", "v", "dim", "c.*"), "ann-codes")
    index = Index(distinct, total)
    # A vector that several rows ask for is searched once.
    askers = scratch_table(rows.where("asked").select(F.col("id").alias("query_id"), F.col("row").alias("own"), "v")
                           .join(bare, "v").select("query_id", "own", F.col("rep").alias("q")), "ann-askers")
    asked = distinct.join(askers.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi")
    asked = scratch_table(asked.select(F.col("rep").alias("q"), "dim", "code", radii(F.col("v"), shared, k + 1, total).alias("r"))
                          .select("q", "dim", "code", "r.*"), "ann-queries")

    def scored(queries: DataFrame) -> DataFrame:
        ends = distinct.select(F.col("rep").alias("q"), F.col("v").alias("w"), F.col("norm").alias("m"))
        pairs = index.within(queries).join(distinct.select("rep", "v", "norm"), "rep").join(ends, "q")
        d = distance("v", "w")
        cos = F.try_divide(F.pow("m", 2) + F.pow("norm", 2) - F.pow(d / shared.value.scale, 2), 2 * F.col("m") * F.col("norm"))
        return scratch_table(pairs.select("q", "rep", d.alias("d"), F.coalesce(cos, F.lit(0.0)).alias("cos")), "ann-scored")

    found = scored(asked.select("q", "dim", "code", F.lit(-1).alias("low"), F.col("first").alias("radius")))
    best = Window.partitionBy("q").orderBy("d", "rep")
    reached = (found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
               .groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("cos")))
    p = F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0))) / math.pi
    enough = F.least(F.lit(BITS), F.ceil(BITS * p + SPREAD * shared.value.noise * F.sqrt(BITS * p * (1 - p))))
    radius = F.when(F.col("n") > k, enough).otherwise(F.col("sure")).cast("int")
    again = scratch_table(asked.join(reached, "q", "left").select("q", "dim", "code", F.col("first").alias("low"), radius.alias("radius"))
                          .where("radius > low"), "ann-again")
    found = found.unionByName(scored(again))
    places = (found.join(members.select("rep", "id", "row"), "rep")
              .withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "id", "row"))).where(F.col("n") <= k + 1))
    out = askers.join(places, "q").where("row != own")
    rank = F.row_number().over(Window.partitionBy("own").orderBy("d", "id", "row"))
    return (out.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), F.col("d").alias("score")))
