"""Dense-vector search (SIM4-SIM7, AGG9, WIN5, OPT5, OPT9) and the encoder plug-in.

Vectors are ``ARRAY<FLOAT>`` columns.  A query vector is either a literal, or a
row of the data pulled in as a scalar subquery (evaluated once, no join).
Cosine is computed in-row, so scoring needs no shuffle; global top-k is a
TakeOrderedAndProject (per-task top-k, then a merge of k rows per task).
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators.ranking import top_k_per_group
from lectern.session import lean_writes, scratch_table


def vector_of(df: DataFrame, key_col: str, key, vec_col: str) -> Column:
    """The vector of one row as a scalar-subquery Column (one row, one value)."""
    return df.filter(F.col(key_col) == F.lit(key)).select(vec_col).scalar()


def score_against(df: DataFrame, vec_col: str, query: Column | Sequence[float], out: str = "score") -> DataFrame:
    """SIM4/SIM6: ``out`` = cosine(vector, query vector); NULL for a zero vector."""
    q = query if isinstance(query, Column) else vx.vector_literal(query)
    return df.withColumn("_q", q).withColumn(out, vx.cosine(F.col(vec_col), F.col("_q"))).drop("_q")


def nearest(df: DataFrame, vec_col: str, query: Column | Sequence[float], key_col: str, k: int = 10,
            drop_first: bool = False) -> DataFrame:
    """SIM7/WIN5/SRT5: the k most similar rows, best first, ties by key, with a
    1-based ``rank``.  ``drop_first`` reproduces the semantic-search slice that
    discards the best hit (normally the query itself).  The global top-k is a
    two-level tree (per bucket of map tasks, then overall), so the last task
    reads at most k x 256 rows however large the corpus."""
    scored = score_against(df, vec_col, query).filter(F.col("score").isNotNull())
    top = top_k_per_group(scored.withColumn("_all", F.lit(0)), "_all",
                          [F.col("score").desc(), F.col(key_col)], k, rank_col="rank", fan_in=256).drop("_all")
    top = top.withColumn("rank", F.col("rank").cast("long"))
    return top.filter(F.col("rank") > 1) if drop_first else top


def centroids(df: DataFrame, group: str, vec_col: str, out: str = "centroid") -> DataFrame:
    """AGG9: element-wise mean vector per group, with the JVM ``Summarizer``
    (one typed aggregate buffer per group and task; no explode of dimensions)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    agg = df.groupBy(group).agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_m"))
    return agg.select(group, vector_to_array("_m", "float64").alias(out))


def cosine_to_centroid(df: DataFrame, group: str, vec_col: str, salts: int = 64) -> DataFrame:
    """Each vector's cosine to its group's centroid (NULL is a group too).  The centroid
    table has one row per group; each is repeated for ``salts`` hash classes of
    vectors, so that no task gets all vectors of a group when the join shuffles."""
    c = centroids(df, group, vec_col).select(F.col(group).alias("_group"), "centroid",
                                             F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = df.withColumn("_vsalt", F.pmod(F.hash(vec_col), F.lit(salts)))
    return (salted.join(c, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_vsalt") == F.col("_salt")))
            .withColumn("score", vx.cosine(F.col(vec_col), F.col("centroid")))
            .drop("centroid", "_group", "_salt", "_vsalt"))


def kmeans(df: DataFrame, vec_col: str, k: int = 10, seed: int = 1, max_iter: int = 20) -> DataFrame:
    """OPT9: k-means cluster id per row (Spark ML; iterations are distributed)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    feats = df.withColumn("_features", array_to_vector(F.col(vec_col)))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cluster").fit(feats)
    return model.transform(feats).drop("_features")


def assign_nearest(df: DataFrame, vec_col: str, centres: DataFrame, key: str, centre_col: str = "centroid", most: int = 4096) -> DataFrame:
    """OPT9, the assignment step: ``cluster`` (key of the centre at the smallest squared distance, ties to the smaller key) and
    ``distance``.  The centres travel as one literal array in the plan, so there may be ``most`` of them at most (an error otherwise)."""
    rows = centres.select(key, centre_col).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centres")
    if not rows:
        return df.withColumns({"cluster": F.lit(None).cast(centres.schema[key].dataType), "distance": F.lit(None).cast("double")})
    table = F.array(*[F.struct(F.lit(r[key]).alias("k"), vx.vector_literal(r[centre_col]).alias("c")) for r in rows])
    apart = F.transform(table, lambda s: F.struct(F.aggregate(
        F.zip_with(F.col(vec_col), s["c"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, b: a + b).alias("d"), s["k"].alias("k")))
    out = df.select("*", F.inline(F.array(F.struct(F.array_min(apart).alias("_best")))))
    return out.withColumns({"cluster": F.col("_best.k"), "distance": F.col("_best.d")}).drop("_best")


def pca_2d(df: DataFrame, vec_col: str) -> DataFrame:
    """OPT9: first two principal components of each vector."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    feats = df.withColumn("_features", array_to_vector(F.col(vec_col)))
    model = PCA(k=2, inputCol="_features", outputCol="_pc").fit(feats)
    out = model.transform(feats).withColumn("_pc", vector_to_array("_pc"))
    return out.withColumns({"pc1": F.col("_pc")[0], "pc2": F.col("_pc")[1]}).drop("_features", "_pc")


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the vectors of a paper's terms, and their number, for papers with a known term.  Rows come sorted by part, of each part
    first its terms' vectors, then its papers; columns: part, paper, term, vector, tokens, keys."""
    here, terms, rows, index = None, [], [], None
    for batch in batches:
        part, paper = batch.column("part").to_numpy(), np.asarray(batch.column("paper").to_pylist(), dtype=bool)
        starts = np.flatnonzero(np.r_[len(part) > 0, (part[1:] != part[:-1]) | (paper[1:] != paper[:-1])])
        for a, b in zip(starts, [*starts[1:], len(part)]):
            if part[a] != here:
                here, terms, rows, index = part[a], [], [], None
            if not paper[a]:
                terms += batch.column("term").slice(a, b - a).to_pylist()
                rows.append(np.array(batch.column("vector").slice(a, b - a).to_pylist(), dtype=float))
                continue
            if not terms:
                continue
            if index is None:  # a term with several vectors counts once for each
                codes, names = pd.factorize(np.array(terms, dtype=object))
                index, known = pd.Index(names), np.bincount(codes)
                sums = np.zeros((len(names), rows[0].shape[1]))
                np.add.at(sums, codes, np.concatenate(rows))
                rows = []
            for at in range(a, b, 128):
                some = batch.slice(at, min(128, b - at))
                said = some.column("tokens")
                size = np.diff(said.offsets.to_numpy())
                found = index.get_indexer(said.flatten().to_numpy(zero_copy_only=False))
                owner = np.repeat(np.arange(len(size)), size)[found >= 0]
                found = found[found >= 0]
                if len(found):
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    total, weight = np.add.reduceat(sums[found], first, axis=0), np.add.reduceat(known[found], first)
                    kept = some.take(pa.array(owner[first]))
                    keys = [c for c in some.schema.names if c not in ("part", "paper", "term", "vector", "tokens")]
                    means = pa.array(list(total / weight[:, None]), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keys), means, pa.array(weight.astype(float))], [*keys, "_mean", "_weight"])


def word_vector_scores(papers: DataFrame, vectors: DataFrame, query: str, field: str, keys: Sequence[str], stopwords=None, rounds: int = 1) -> DataFrame:
    """``keys`` and ``score`` = cosine(mean word vector of the query, of the cleaned field).

    ``vectors``: (term, vector), one row per term.  Papers are dealt into as many parts as there are shuffle partitions; a part gets the vector
    of each of its terms once, however many of its papers hold the term, and its papers are averaged there.  With ``rounds``, the parts are
    worked on in so many rounds at most, at least six parts in each, so that the disk holds the vectors of one round's parts; each round reads
    ``vectors``, which should be a table then.  The query is tokenised, not cleaned.  Papers without a known term are left out; a query without one gives NULL scores."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    keys, spark = list(keys), papers.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_key{i}" for i in range(len(keys))]
    # Texts travel as one string each: no token has a space.
    docs = papers.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.pmod(F.hash(*keys), F.lit(parts)).alias("part"),
                         tx.clean_text(F.col(field), stopwords).alias("said"))
    docs = docs.where("said <> ''").repartitionById(parts, "part").select("part", F.split("said", " ").alias("tokens"), *names)
    with lean_writes(spark):
        docs = scratch_table(docs, "vectors-papers")
    kinds = [docs.schema[n].dataType for n in names]
    out = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)]
                       + [T.StructField("_mean", T.ArrayType(T.DoubleType())), T.StructField("_weight", T.DoubleType())])

    def sums(docs: DataFrame) -> DataFrame:
        # The terms are many times the rows that hold them, so their size must not be guessed from the file: both sides are shuffled.
        needed = docs.select("part", F.explode("tokens").alias("term")).distinct().hint("merge").join(vectors.where("vector IS NOT NULL"), "term")
        terms = needed.select("part", F.lit(False).alias("paper"), "term", "vector", F.lit(None).cast("string").alias("said"),
                              *(F.lit(None).cast(t).alias(n) for n, t in zip(names, kinds)))
        said = docs.select("part", F.lit(True).alias("paper"), F.lit(None).cast("string").alias("term"),
                           F.lit(None).cast(vectors.schema["vector"].dataType).alias("vector"), F.array_join("tokens", " ").alias("said"), *names)
        dealt = terms.unionByName(said).repartitionById(parts, "part").sortWithinPartitions("part", "paper")
        return dealt.select("part", "paper", "term", "vector", F.split("said", " ").alias("tokens"), *names).mapInArrow(_weighted, out)

    rounds = max(1, min(rounds, parts // 6))
    if rounds == 1:
        summed = sums(docs)
    else:
        with lean_writes(spark):
            ends = [parts * i // rounds for i in range(rounds + 1)]
            found = [scratch_table(sums(docs.where(F.col("part").between(a, b - 1))), "vectors-means") for a, b in zip(ends, ends[1:])]
        summed = reduce(DataFrame.unionByName, found)
    mean = vector_to_array(Summarizer.metrics("mean").summary(array_to_vector("_mean"), F.col("_weight"))["mean"])
    scored = summed.groupBy(*names).agg(mean.alias("_v")).select(*(F.col(n).alias(k) for k, n in zip(keys, names)), "_v")  # keys may repeat
    asked = (spark.range(1).select(F.explode(tx.word_tokens(F.lit(query))).alias("term"))
             .join(vectors, "term")
             .groupBy(F.lit(0).alias("_all"))  # no row, and so a NULL, for a query without a known term
             .agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")))).alias("q")).select("q"))
    return score_against(scored, "_v", asked.scalar()).drop("_v")


# Encoder plug-in (SIM5-SIM7 with a pretrained model) -----------------------------------
Encoder = Callable[[list], np.ndarray]


def encode_column(texts: Column, encoder_factory: Callable[[], Encoder], dim: int | None = None) -> Column:
    """Encode a text column with an Iterator pandas UDF; ``encoder_factory`` is
    called once per Python worker (model load), then batches stream through."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder_factory()
        for s in batches:
            vecs = np.asarray(enc(s.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(vecs))

    return _encode(texts)


def score_with_encoder(papers: DataFrame, query: str, text: Column, encoder_factory: Callable[[], Encoder],
                       clean_corpus: bool = True, stopwords=None) -> DataFrame:
    """Encoder search: corpus (cleaned) and raw query encoded by the same model."""
    enc = encoder_factory()
    qvec = np.asarray(enc([query]), dtype=np.float64)[0]
    corpus = tx.clean_text(text, stopwords) if clean_corpus else text
    vecs = papers.withColumn("_v", encode_column(corpus, encoder_factory))
    return score_against(vecs, "_v", [float(x) for x in qvec]).drop("_v")
