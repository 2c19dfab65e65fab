"""Dense-vector queries over ``embeddings`` (SIM4-SIM7, AGG9, WIN5, FLT3, OPT5, OPT9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import neighbours as nb
from lectern.operators import semantic as sem
from lectern.operators import wordvectors
from lectern.operators.ranking import threshold_filter, top_k_per_group
from lectern.plans.q_search import QUERY
from lectern.plans.registry import query
from lectern.plans.sqlfrag import PAPERS, clean, sql_str, words
from lectern.sources import sinks
from lectern.sources.papers import papers, read_table

# The query vector is the embedding of vec_id 0 (a row of the data).
QUERY_ID = 0


def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE), lambda x, y: x + y)"


def _norm(a: str) -> str:
    return f"sqrt(list_reduce(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE), lambda x, y: x + y))"


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / ({_norm(a)} * {_norm(b)}))"


_Q = f"(SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID})"
_SCORED = f"(SELECT e.vec_id, e.label, {_cos('e.embedding', 'q.embedding')} AS score FROM embeddings e, {_Q} q)"


_CENTROIDS = """(SELECT label, list(avg_v ORDER BY i) AS centroid FROM (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS avg_v FROM embeddings, generate_series(1, len(embedding)) g(i)
  GROUP BY label, i) GROUP BY label)"""


def _emb(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _scored(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return sem.score_against(e.select("vec_id", "label", "embedding"), "embedding",
                             sem.vector_of(e, "vec_id", QUERY_ID, "embedding"))


@query("semantic_search", sql=f"SELECT vec_id, label, round(score, 6) AS score FROM {_SCORED}")
def semantic_search(spark, sf_dir):
    """SIM6: every vector scored against the query vector."""
    return _scored(spark, sf_dir).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("embedding_cosine", sql=f"""
SELECT e.vec_id, e.label, round({_cos('e.embedding', 'c.centroid')}, 6) AS score
FROM embeddings e JOIN {_CENTROIDS} c ON c.label = e.label
""")
def embedding_cosine(spark, sf_dir):
    """SIM4: each vector's cosine to its label's mean vector (centroids joined on label)."""
    s = sem.cosine_to_centroid(_emb(spark, sf_dir).select("vec_id", "label", "embedding"), "label", "embedding")
    return s.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("threshold_filter", sql=f"""
SELECT vec_id, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 4) AS metric_match FROM {_SCORED}
WHERE CAST(score AS FLOAT) >= CAST(0.2 AS FLOAT)
""")
def threshold_filter_q(spark, sf_dir):
    """FLT3: float32 comparison with ``>=``; NULL/NaN never pass."""
    kept = threshold_filter(_scored(spark, sf_dir), "score", 0.2)
    return kept.select("vec_id", tx.round_score("score").alias("metric_match"))


@query("semantic_topk", sql=f"""
SELECT vec_id, rank, round(score, 6) AS score FROM (
  SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM {_SCORED} WHERE score IS NOT NULL)
WHERE rank <= 10 AND rank > 1
""")
def semantic_topk(spark, sf_dir):
    """SIM7/WIN5: ten best neighbours of the query vector with the best hit dropped."""
    e = _emb(spark, sf_dir)
    top = sem.nearest(e.select("vec_id", "embedding"), "embedding",
                      sem.vector_of(e, "vec_id", QUERY_ID, "embedding"), "vec_id", 10, drop_first=True)
    return top.select("vec_id", "rank", F.round("score", 6).alias("score"))


@query("similar_papers", sql=f"""
SELECT vec_id, round(score, 6) AS score FROM {_SCORED} WHERE vec_id <> {QUERY_ID} AND score IS NOT NULL
ORDER BY score DESC, vec_id LIMIT 10
""")
def similar_papers(spark, sf_dir):
    """OPT5: ten most similar rows to a selected row, the row itself excluded."""
    s = _scored(spark, sf_dir).filter((F.col("vec_id") != QUERY_ID) & F.col("score").isNotNull())
    return (s.orderBy(F.col("score").desc(), F.col("vec_id")).limit(10)
            .select("vec_id", F.round("score", 6).alias("score")))


@query("topk_per_label", sql=f"""
SELECT vec_id, label, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM {_SCORED}
  WHERE score IS NOT NULL) WHERE rn <= 3
""")
def topk_per_label(spark, sf_dir):
    """WIN2 on vectors: three best per label."""
    s = _scored(spark, sf_dir).filter(F.col("score").isNotNull())
    top = top_k_per_group(s, "label", [F.col("score").desc(), F.col("vec_id")], 3)
    return top.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("mean_pool", sql=f"""
SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(embedding[i]::DOUBLE), 6) AS value
FROM embeddings, generate_series(1, len(embedding)) g(i) GROUP BY label, i
""")
def mean_pool(spark, sf_dir):
    """AGG9: mean vector per label, shown one dimension per row."""
    c = sem.centroids(_emb(spark, sf_dir), "label", "embedding")
    return (c.select("label", F.posexplode("centroid").alias("dim", "value"))
            .select("label", "dim", F.round("value", 6).alias("value")))


@query("mean_pool_cosine", sql=f"""
SELECT c.label, round({_cos('c.centroid', 'q.centroid')}, 6) AS score
FROM {_CENTROIDS} c, (SELECT centroid FROM {_CENTROIDS} WHERE label = 0) q
""")
def mean_pool_cosine(spark, sf_dir):
    """SIM5 (mean-vector form): cosine of each label's mean vector with label 0's."""
    c = sem.centroids(_emb(spark, sf_dir), "label", "embedding")
    s = sem.score_against(c, "centroid", sem.vector_of(c, "label", 0, "centroid"))
    return s.select("label", F.round("score", 6).alias("score"))


@query("kmeans")
def kmeans_q(spark, sf_dir):
    """OPT9: k-means clusters (k=10) and the first two principal components."""
    e = _emb(spark, sf_dir).select("vec_id", "label", "embedding")
    clustered = sem.kmeans(e, "embedding", k=10)
    return sem.pca_2d(clustered, "embedding").select("vec_id", "label", "cluster", "pc1", "pc2")


@query("nearest_centres", sql=f"""
WITH d AS (SELECT e.vec_id, c.label, list_reduce(list_transform(list_zip(e.embedding, c.centroid), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])),
                                                 lambda a, b: a + b) AS d FROM embeddings e, {_CENTROIDS} c)
SELECT vec_id, arg_min(label, (round(d, 9), label)) AS cluster, round(min(d), 6) AS distance FROM d GROUP BY vec_id
""")
def nearest_centres(spark, sf_dir):
    """OPT9: each vector's nearest label centroid (the assignment step of k-means)."""
    e = _emb(spark, sf_dir).select("vec_id", "label", "embedding")
    found = sem.assign_nearest(e, "embedding", sem.centroids(e, "label", "embedding"), "label")
    return found.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("exact_neighbours", sql=f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v),
s AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_sum(list_transform(list_zip(q.u, x.u), lambda p: p[1] * p[2])), 9) AS score
      FROM u q JOIN u x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10
""")
def exact_neighbours(spark, sf_dir):
    """SIM7/OPT5 at scale: all vectors are indexed; the ten nearest of each vector whose id 50 divides, certain for every one."""
    e = _emb(spark, sf_dir).select("vec_id", "embedding")
    path = sinks.scratch_path(spark, "vectors")
    nb.build_vector_index(e, path)
    found = nb.exact_neighbours(spark, path, e.where(F.col("vec_id") % 50 == 0), 10)
    return found.select(F.col("query").alias("query_id"), "rank", "vec_id", F.round("score", 6).alias("score"))


# A term's vector is the embedding at its hash modulo the number of embeddings.
_TERM_ID = "('0x' || substr(md5(term), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)"


@query("word_vector_search", sql=f"""
WITH c AS (SELECT dataset, paper_key, term, count(*) AS n
           FROM (SELECT dataset, paper_key, unnest({clean('abstract')}) AS term FROM {PAPERS}) GROUP BY ALL),
q AS (SELECT unnest({words(sql_str(QUERY))}) AS term),
tv AS (SELECT t.term, i, e.embedding[i]::DOUBLE AS x
       FROM (SELECT term FROM c UNION SELECT term FROM q) t JOIN embeddings e ON e.vec_id = {_TERM_ID},
            generate_series(1, len(e.embedding)) g(i)),
d AS (SELECT dataset, paper_key, i, sum(n * x) / sum(n) AS x FROM c JOIN tv USING (term) GROUP BY ALL),
m AS (SELECT i, avg(x) AS y FROM q JOIN tv USING (term) GROUP BY i)
SELECT dataset, paper_key, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS score
FROM d JOIN m USING (i) GROUP BY dataset, paper_key
""")
def word_vector_search(spark, sf_dir):
    """SIM5/AGG9: mean word vector of every text against the query's, vectors given as a table."""
    p = papers(spark, sf_dir)
    e = read_table(spark, sf_dir, "embeddings")
    n = e.select(F.count(F.lit(1))).scalar()
    terms = (p.select(F.explode(tx.clean_tokens("abstract")).alias("term")).distinct()
             .union(spark.range(1).select(F.explode(tx.word_tokens(F.lit(QUERY))))).distinct())
    placed = terms.withColumn("vec_id", F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % n)
    vectors = placed.join(e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("term", "vector")
    scored = sem.word_vector_scores(p, vectors, QUERY, "abstract", ["dataset", "paper_key"])
    return scored.select("dataset", "paper_key", F.round("score", 6).alias("score"))


@query("learned_vector_search")
def learned_vector_search(spark, sf_dir):
    """SIM5 with vectors learned from the texts themselves (co-occurrences, PPMI, SVD): mean word vector of every text
    against the query's."""
    p = papers(spark, sf_dir)
    vectors = wordvectors.learn(p, tx.clean_tokens("abstract"), dim=32, contexts=4000)
    scored = sem.word_vector_scores(p, vectors, QUERY, "abstract", ["dataset", "paper_key"], rounds=4)
    return scored.select("dataset", "paper_key", F.round("score", 6).alias("score"))
