"""Ranking papers against a free-text query (SIM1-SIM3, SIM8-SIM12).

The whole search over every dataset is one DataFrame plan:

    scan -> field text -> score (in-row) -> threshold -> annotate -> top-k per dataset

Scoring is row-local (a document's term counts live in its row), so the only
shuffle is the per-dataset top-k, and Spark's partial WindowGroupLimit sends
at most ``limit`` rows per dataset per map task into it.
"""

from __future__ import annotations

from collections import Counter
from typing import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators.ranking import threshold_filter, top_k_per_group
from lectern.schemas import SEARCH_MODELS

KEY = ("dataset", "paper_key")
# Map-task buckets of the two-level per-dataset top-k (bounds the final task's input).
TOPK_FAN_IN = 256


def field_text(df: DataFrame, field: str) -> Column:
    """FLT1: the searched field as text; list fields are joined with spaces (D7)."""
    if field not in df.columns:
        raise ValueError(f"field {field!r} not in {df.columns}")
    dtype = df.schema[field].dataType
    if isinstance(dtype, T.ArrayType):
        return F.array_join(F.col(field), " ")
    if isinstance(dtype, T.StringType):
        return F.col(field)
    return F.col(field).cast("string")


def query_terms(spark: SparkSession, query: str, stopwords: Sequence[str] | None = None,
                extra_stopwords: Iterable[str] = ()) -> list[str]:
    """Vectoriser tokens of the query text, cleaned by the same Spark expression
    as the documents.  One short string in, one short array out."""
    row = spark.range(1).select(
        tx.vector_tokens(F.lit(query), stopwords, extra_stopwords).alias("t")).first()
    return list(row["t"]) if row is not None else []


# SIM1-SIM3 ---------------------------------------------------------------------
def materialize(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns through a one-row ``inline`` so a later filter on them is not
    pushed below and re-evaluated inside the scan (Catalyst substitutes
    projected aliases into pushed predicates; a Generate output it cannot)."""
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def score_tf_cosine(papers: DataFrame, query: str, field: str = "abstract",
                    stopwords: Sequence[str] | None = None, extra_stopwords: Iterable[str] = (),
                    zero_as: float | None = None, prune_below: float | None = None) -> DataFrame:
    """Adds ``score``: cosine of L1-normalised term-frequency vectors (no IDF).

    ``zero_as=None`` gives NULL for a zero vector (scipy form, never passes a
    threshold); ``zero_as=0.0`` gives 0 (sklearn form).  The document is
    tokenised once; the dot product is one pass over its tokens and the norm
    (a sort) is only computed for documents sharing a term with the query.

    ``prune_below``: documents that provably score below this value get NULL
    without computing the norm.  Since every term count is >= 1, |d|^2 >= n (the
    token count), so cos <= dot / (sqrt(n) |q|); the bound is relaxed by 1e-6 so
    a later float32 comparison can never lose a row.
    """
    spark = papers.sparkSession
    q_counts = Counter(query_terms(spark, query, stopwords, extra_stopwords))
    q_ss = sum(c * c for c in q_counts.values())
    toks = tx.vector_tokens(field_text(papers, field), stopwords, extra_stopwords)
    df = papers.withColumn("_tok", toks)
    tok = F.col("_tok")
    dot = vx.weighted_term_dot(tok, q_counts)
    zero = F.when((F.size(tok) > 0) & F.lit(q_ss > 0), F.lit(0.0))
    if zero_as is not None:
        zero = F.lit(float(zero_as))
    full = vx.tf_cosine(dot, vx.sum_squared_counts(tok), q_ss)
    if prune_below is not None and prune_below > 0 and q_ss > 0:
        bound = F.try_divide(dot.cast("double"), F.sqrt(F.size(tok).cast("double") * F.lit(float(q_ss))))
        score = (F.when(dot <= 0, zero)
                 .when(bound < F.lit(float(prune_below) * (1 - 1e-6)), F.lit(None).cast("double"))
                 .otherwise(full))
    else:
        score = F.when(dot > 0, full).otherwise(zero)
    return materialize(df, score=score).drop("_tok")


# SIM4-SIM7 ---------------------------------------------------------------------
def score_dense(df: DataFrame, vector_col: str, query_vector: Sequence[float] | Column) -> DataFrame:
    """Adds ``score`` = cosine(vector, query vector) (NULL for a zero vector)."""
    q = query_vector if isinstance(query_vector, Column) else vx.vector_literal(query_vector)
    return df.withColumn("score", vx.cosine(F.col(vector_col), q))


# SIM9 --------------------------------------------------------------------------
def annotate(df: DataFrame, threshold: float, digits: int) -> DataFrame:
    """metric_match (rounded float32 score), metric_thres, conference."""
    return df.withColumns({
        "metric_match": tx.round_score("score", digits) if digits == 4
        else F.round(F.col("score"), digits),
        "metric_thres": F.lit(float(threshold)),
        "conference": F.col("dataset"),
    })


def tie_order(df: DataFrame) -> list[Column]:
    """Ties keep file order: ``pos`` when the papers carry it, then the key."""
    return ([F.col("pos").asc()] if "pos" in df.columns else []) + [F.col("paper_key").asc()]


def rank_and_limit(scored: DataFrame, model: str, limit: int, threshold: float) -> DataFrame:
    """Threshold -> annotate -> top-k per dataset by metric_match, ties in file order."""
    fuzzy = model == "Fuzzy"
    kept = threshold_filter(scored, "score", threshold, strict=fuzzy, as_float=not fuzzy)
    annotated = annotate(kept, threshold, 3 if fuzzy else 4).drop("score")
    return top_k_per_group(annotated, "dataset", [F.col("metric_match").desc(), *tie_order(annotated)], limit,
                           fan_in=TOPK_FAN_IN)


Scorer = Callable[..., DataFrame]


def _fuzzy(papers: DataFrame, query: str, field: str, threshold: float = 0.0, **kw) -> DataFrame:
    from lectern.functions.fuzzy import score_fuzzy
    return score_fuzzy(papers, query, field_text(papers, field), keep_zero=threshold < 0)


def _cosine(papers: DataFrame, query: str, field: str, threshold: float = 0.0, **kw) -> DataFrame:
    return score_tf_cosine(papers, query, field, stopwords=kw.get("stopwords"),
                           extra_stopwords=kw.get("extra_stopwords", ()),
                           prune_below=threshold if threshold > 0 else None)


def _encoder_search(papers: DataFrame, query: str, field: str, **kw) -> DataFrame:
    from lectern.operators.semantic import score_with_encoder
    encoder = kw.get("encoder")
    if encoder is None:
        raise ValueError("this model needs an encoder (see lectern.operators.semantic)")
    scored = score_with_encoder(papers, query, field_text(papers, field), encoder,
                                clean_corpus=True, stopwords=kw.get("stopwords"))
    if kw.get("neighbours"):
        # Paper-similarity form: only the best ``neighbours`` per dataset are
        # candidates; ``drop_best`` also discards the first of them (compat).
        ranked = top_k_per_group(scored.filter(F.col("score").isNotNull()), "dataset",
                                 [F.col("score").desc(), *tie_order(scored)],
                                 int(kw["neighbours"]), rank_col="_nb")
        if kw.get("drop_best"):
            ranked = ranked.filter(F.col("_nb") > 1)
        scored = ranked.drop("_nb")
    return scored


SCORERS: dict[str, Scorer] = {
    "Fuzzy": _fuzzy,
    "Cosine": _cosine,
    "Word2Vec": _encoder_search,
    "Marco": _encoder_search,
    "Specter": _encoder_search,
}


def search(papers: DataFrame, query: str, model: str = "Cosine", field: str = "abstract",
           limit: int = 10, threshold: float = 0.4, **kw) -> DataFrame:
    """SIM9/SIM10: one search over every dataset in ``papers``.

    Returns the paper columns plus metric_match, metric_thres, conference; at most
    ``limit`` rows per dataset, best first, ties by paper key.

    Keyword options: ``stopwords``, ``extra_stopwords`` (text models);
    ``encoder`` (a zero-argument factory returning ``texts -> vectors``) for
    Word2Vec/Marco/Specter; ``neighbours=10, drop_best=True`` reproduces the
    paper-similarity model's candidate set (ten neighbours, best one dropped).
    """
    if model not in SCORERS:  # SIM12
        raise ValueError(f"{model} search currently not available; choose one of {SEARCH_MODELS}")
    if not query or not query.strip():
        return papers.limit(0).withColumns({
            "metric_match": F.lit(None).cast("double"),
            "metric_thres": F.lit(None).cast("double"),
            "conference": F.lit(None).cast("string")})
    scored = SCORERS[model](papers, query, field, threshold=threshold, **kw)
    return rank_and_limit(scored, model, limit, threshold)


def search_many(papers: DataFrame, queries: Sequence[str], field: str = "abstract", limit: int = 10,
                threshold: float = 0.4, stopwords: Sequence[str] | None = None,
                extra_stopwords: Iterable[str] = ()) -> DataFrame:
    """Several TF-cosine searches in one pass: the field is tokenised once, each
    query's score is computed in-row, and one Generate emits ``(run, score)``
    pairs (run = 1-based query index) that go through one threshold and one
    per-(run, dataset) top-k.  Equal to the union of the single searches."""
    spark = papers.sparkSession
    df = papers.withColumn("_tok", tx.vector_tokens(field_text(papers, field), stopwords, extra_stopwords))
    tok, asked = F.col("_tok"), []
    for q in queries:
        q_counts = Counter(query_terms(spark, q, stopwords, extra_stopwords))
        asked.append((q_counts, sum(c * c for c in q_counts.values())))
    # Dot products first; the norm (a sort) once, for papers that any query can still want.
    df = materialize(df, **{f"_dot{i}": vx.weighted_term_dot(tok, q_counts) for i, (q_counts, _) in enumerate(asked)})
    wanted = F.lit(False)
    for i, (_, q_ss) in enumerate(asked):
        dot = F.col(f"_dot{i}")
        if q_ss > 0:
            bound = F.try_divide(dot.cast("double"), F.sqrt(F.size(tok).cast("double") * F.lit(float(q_ss))))
            wanted = wanted | ((dot > 0) & (bound >= F.lit(max(float(threshold), 0.0) * (1 - 1e-6))))
    df = materialize(df, _ss=F.when(wanted, vx.sum_squared_counts(tok)))
    pairs = []
    for run, (_, q_ss) in enumerate(asked, start=1):
        dot = F.col(f"_dot{run - 1}")
        zero = F.lit(None).cast("double") if threshold > 0 else F.when((F.size(tok) > 0) & F.lit(q_ss > 0), F.lit(0.0))
        score = F.when(dot > 0, vx.tf_cosine(dot, F.col("_ss"), q_ss)).otherwise(zero)
        pairs.append(F.struct(F.lit(run).alias("run"), score.alias("score")))
    scored = df.select(*[c for c in papers.columns], F.inline(F.array(*pairs)))
    kept = threshold_filter(scored, "score", threshold)
    annotated = annotate(kept, threshold, 4).drop("score")
    return top_k_per_group(annotated, ["run", "dataset"],
                           [F.col("metric_match").desc(), *tie_order(annotated)], limit, fan_in=TOPK_FAN_IN)


def join_scores(scores: DataFrame, papers: DataFrame, order_col: str | None = None) -> DataFrame:
    """JN1 + WIN4: scores computed apart joined back to their papers on
    (dataset, paper_key); when a key occurs twice in ``papers`` the first one
    (smallest ``order_col``) wins."""
    if order_col is not None:
        from lectern.operators.ranking import first_wins
        papers = first_wins(papers, list(KEY), order_col)
    return scores.join(papers, list(KEY), "inner")


def search_summary(results: DataFrame) -> DataFrame:
    """AGG11: number of hits and of datasets that produced them."""
    return results.agg(F.count_distinct(*KEY).alias("hits"),
                       F.count_distinct("dataset").alias("datasets"))
