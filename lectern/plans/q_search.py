"""Search queries over the papers view of ``documents`` (SIM1-SIM3, SIM9-SIM11, JN1/JN2, WIN2/WIN3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import index
from lectern.operators import search as srch
from lectern.operators.ranking import last_wins, top_k_per_group
from lectern.plans.registry import ORACLE, query
from lectern.plans.sqlfrag import PAPERS, round_score, sql_str, tf_scores, vec
from lectern.sources import saved, sinks
from lectern.sources.papers import papers

# Query texts are mid-frequency words of the generated corpus (fixed values).
QUERY = "ones reed anhe heat"
QUERY_B = "anat reon annd enen"
QUERY_C = "heat anat ones"
LIMIT, THRESHOLD = 5, 0.05


@query("search_papers", sql=f"""
WITH s AS ({tf_scores(QUERY)}),
k AS (SELECT dataset, paper_key, {round_score('score')} AS metric_match FROM s
      WHERE CAST(score AS FLOAT) >= CAST({THRESHOLD} AS FLOAT)),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY metric_match DESC, paper_key) AS rn FROM k)
SELECT r.dataset, r.paper_key, p.title, r.metric_match, CAST({THRESHOLD} AS DOUBLE) AS metric_thres,
       r.dataset AS conference
FROM r JOIN {PAPERS} p ON p.dataset = r.dataset AND p.paper_key = r.paper_key WHERE rn <= {LIMIT}
""")
def search_papers(spark, sf_dir):
    """Flagship (SIM9): TF cosine on abstracts, threshold, top-k per dataset."""
    res = srch.search(papers(spark, sf_dir), QUERY, "Cosine", "abstract", LIMIT, THRESHOLD)
    return res.select("dataset", "paper_key", "title", "metric_match", "metric_thres", "conference")


@query("tf_cosine_search", sql=f"""
SELECT dataset, paper_key, round(score, 6) AS score FROM ({tf_scores(QUERY)}) WHERE score IS NOT NULL
""")
def tf_cosine_search(spark, sf_dir):
    """SIM2 + JN4: cosine of every paper with the query (NULL rows = zero vectors dropped)."""
    s = srch.score_tf_cosine(papers(spark, sf_dir), QUERY, "abstract")
    return s.filter(F.col("score").isNotNull()).select(
        "dataset", "paper_key", F.round("score", 6).alias("score"))


@query("tf_cosine_zero", sql=f"""
SELECT dataset, paper_key, round(score, 6) AS score FROM ({tf_scores(QUERY, zero_as_zero=True)})
""")
def tf_cosine_zero(spark, sf_dir):
    """SIM3: sklearn form, a zero vector scores 0 instead of NULL."""
    s = srch.score_tf_cosine(papers(spark, sf_dir), QUERY, "abstract", zero_as=0.0)
    return s.select("dataset", "paper_key", F.round("score", 6).alias("score"))


@query("search_all", sql=f"""
WITH s AS ({tf_scores(QUERY_B, field='abstract')}),
k AS (SELECT dataset, paper_key, {round_score('score')} AS metric_match FROM s
      WHERE CAST(score AS FLOAT) >= CAST(0.01 AS FLOAT)),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY metric_match DESC, paper_key) AS rn FROM k)
SELECT dataset, paper_key, metric_match, CAST(0.01 AS DOUBLE) AS metric_thres, dataset AS conference
FROM r WHERE rn <= 3
""")
def search_all(spark, sf_dir):
    """SIM10: one search over all datasets on the whole text."""
    res = srch.search(papers(spark, sf_dir), QUERY_B, "Cosine", "abstract", 3, 0.01)
    return res.select("dataset", "paper_key", "metric_match", "metric_thres", "conference")


def _two_searches(spark, sf_dir):
    """Two searches over the same papers in one pass (``run`` 1 and 2)."""
    p = papers(spark, sf_dir).select("dataset", "paper_key", "abstract")
    res = srch.search_many(p, [QUERY, QUERY_B], "abstract", LIMIT, THRESHOLD)
    return res.select("dataset", "paper_key", "metric_match", "metric_thres", "run")


def _two_searches_sql() -> str:
    def one(q, run):
        return f"""SELECT dataset, paper_key, metric_match, CAST({THRESHOLD} AS DOUBLE) AS metric_thres, {run} AS run FROM (
          SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY metric_match DESC, paper_key) AS rn FROM (
            SELECT dataset, paper_key, {round_score('score')} AS metric_match FROM ({tf_scores(q)})
            WHERE CAST(score AS FLOAT) >= CAST({THRESHOLD} AS FLOAT))) WHERE rn <= {LIMIT}"""
    return f"({one(QUERY, 1)} UNION ALL {one(QUERY_B, 2)})"


@query("merge_last_wins", sql=f"""
SELECT dataset, paper_key, arg_max(metric_match, run) AS metric_match, arg_max(metric_thres, run) AS metric_thres,
       max(run) AS run
FROM {_two_searches_sql()} GROUP BY dataset, paper_key
""")
def merge_last_wins(spark, sf_dir):
    """WIN3/SET2: upsert-union of two search results, the later run wins per paper."""
    return last_wins(_two_searches(spark, sf_dir), ["dataset", "paper_key"], "run")


@query("search_summary", sql=f"""
SELECT count(DISTINCT (dataset, paper_key)) AS hits, count(DISTINCT dataset) AS datasets
FROM {_two_searches_sql()}
""")
def search_summary(spark, sf_dir):
    """AGG11: hits and datasets of the merged result."""
    return srch.search_summary(_two_searches(spark, sf_dir))


_SAVED_SQL = f"""(SELECT 'cosine_abstract_' || array_to_string(string_split(lower(trim({sql_str(QUERY)})), ' '), '-') AS dataset,
                    paper_key FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY metric_match DESC, paper_key) AS rn FROM (
      SELECT dataset, paper_key, {round_score('score')} AS metric_match FROM ({tf_scores(QUERY)})
      WHERE CAST(score AS FLOAT) >= CAST({THRESHOLD} AS FLOAT))) WHERE rn <= {LIMIT})"""


def _with_saved_search(spark, sf_dir):
    """The papers and, read back from its folder, a saved search over them; (both, folder)."""
    p = papers(spark, sf_dir)
    folder = sinks.scratch_path(spark, "searches")
    saved.save_as_dataset(srch.search(p, QUERY, "Cosine", "abstract", LIMIT, THRESHOLD), folder, "Cosine", "abstract", QUERY)
    return saved.with_saved(p, folder), folder


@query("search_as_dataset", sql=f"""
WITH res AS {_SAVED_SQL},
allp AS (SELECT dataset, paper_key FROM {PAPERS} UNION ALL SELECT dataset, paper_key FROM res)
SELECT dataset, count(*) AS papers FROM allp GROUP BY dataset
""")
def search_as_dataset(spark, sf_dir):
    """SIM11/SNK2: a search is saved under its name, read back and counted as one more dataset next to the loaded ones."""
    both, _ = _with_saved_search(spark, sf_dir)
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("papers"))


@query("search_saved_again", sql=f"""
WITH found AS ({tf_scores(QUERY_C)}),
res AS {_SAVED_SQL},
every AS (SELECT dataset, paper_key, score FROM found
          UNION ALL SELECT res.dataset, paper_key, score FROM res JOIN (SELECT paper_key, score FROM found) USING (paper_key)),
k AS (SELECT dataset, paper_key, {round_score('score')} AS metric_match FROM every
      WHERE CAST(score AS FLOAT) >= CAST({THRESHOLD} AS FLOAT))
SELECT dataset, paper_key, metric_match, CAST({THRESHOLD} AS DOUBLE) AS metric_thres, dataset AS conference FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY metric_match DESC, paper_key) AS rn FROM k) WHERE rn <= {LIMIT}
""")
def search_saved_again(spark, sf_dir):
    """SIM11 + SIM10: a second search over the loaded datasets and the saved one, which is a dataset like the others."""
    both, _ = _with_saved_search(spark, sf_dir)
    res = srch.search(both, QUERY_C, "Cosine", "abstract", LIMIT, THRESHOLD)
    return res.select("dataset", "paper_key", "metric_match", "metric_thres", "conference")


@query("saved_registry", sql=f"""
SELECT dataset, count(*) AS papers, round(sum(metric_match), 6) AS total FROM (
  SELECT 'cosine_abstract_' || array_to_string(string_split({sql_str(QUERY)}, ' '), '-') AS dataset, metric_match, run FROM {{both}} WHERE run = 1
  UNION ALL SELECT 'cosine_abstract_' || array_to_string(string_split({sql_str(QUERY_B)}, ' '), '-'), metric_match, run FROM {{both}} WHERE run = 2)
GROUP BY dataset
""".format(both=_two_searches_sql()))
def saved_registry(spark, sf_dir):
    """SNK2/SRC8: two searches are saved, the first one twice; the registry of the folder, joined with what the datasets hold."""
    p = papers(spark, sf_dir)
    folder = sinks.scratch_path(spark, "searches")
    for text in (QUERY, QUERY_B, QUERY):
        saved.save_as_dataset(srch.search(p, text, "Cosine", "abstract", LIMIT, THRESHOLD), folder, "Cosine", "abstract", text)
    held = saved.saved_papers(spark, folder, f"paper_key bigint, {saved.METRICS}")
    sums = held.groupBy("dataset").agg(F.count(F.lit(1)).alias("papers"), F.round(F.sum("metric_match"), 6).alias("total"))
    return saved.registry(spark, folder).where("bytes > 0").select("dataset").join(sums, "dataset")


def _indexed(spark, sf_dir):
    """The folder of an inverted index over the abstracts."""
    path = sinks.scratch_path(spark, "index")
    index.build_index(papers(spark, sf_dir), path, "abstract")
    return path


@query("index_search", sql=ORACLE["search_papers"])
def index_search(spark, sf_dir):
    """SIM2/SIM9 on a persisted index: the texts are indexed, then the flagship search reads the query's terms only."""
    res = index.search_index(spark, _indexed(spark, sf_dir), QUERY, LIMIT, THRESHOLD)
    return res.select("dataset", "paper_key", "title", "metric_match", "metric_thres", "conference")


@query("index_search_many", sql=f"SELECT * FROM {_two_searches_sql()}")
def index_search_many(spark, sf_dir):
    """SIM10 on a persisted index: two searches in one plan."""
    res = index.search_index(spark, _indexed(spark, sf_dir), [QUERY, QUERY_B], LIMIT, THRESHOLD)
    return res.select("dataset", "paper_key", "metric_match", "metric_thres", "run")


@query("topk_per_dataset", sql=f"""
SELECT dataset, paper_key, metric_match, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY metric_match DESC, paper_key) AS rn FROM (
    SELECT dataset, paper_key, {round_score('score')} AS metric_match FROM ({tf_scores(QUERY)})
    WHERE score IS NOT NULL)) WHERE rn <= 3
""")
def topk_per_dataset(spark, sf_dir):
    """WIN2: best 3 per dataset with their rank, ties broken by paper key."""
    s = srch.score_tf_cosine(papers(spark, sf_dir), QUERY, "abstract").filter(F.col("score").isNotNull())
    s = s.select("dataset", "paper_key", tx.round_score("score").alias("metric_match"))
    out = top_k_per_group(s, "dataset", [F.col("metric_match").desc(), F.col("paper_key")], 3, rank_col="rn")
    return out.withColumn("rn", F.col("rn").cast("long"))


def _query_term_hits(spark, sf_dir):
    """Long form: (dataset, paper_key, hits) = count of query-term tokens per paper."""
    p = papers(spark, sf_dir)
    terms = srch.query_terms(spark, QUERY)
    toks = p.select("dataset", "paper_key", F.explode(tx.vector_tokens("abstract")).alias("term"))
    return (toks.filter(F.col("term").isin(terms))
            .groupBy("dataset", "paper_key").agg(F.count(F.lit(1)).alias("hits")))


_HITS_SQL = f"""(SELECT dataset, paper_key, count(*) AS hits FROM (
    SELECT dataset, paper_key, unnest({vec('abstract')}) AS term FROM {PAPERS})
  WHERE list_contains({vec(sql_str(QUERY))}, term) GROUP BY ALL)"""


@query("scores_join_papers", sql=f"""
SELECT h.dataset, h.paper_key, p.title, h.hits FROM {_HITS_SQL} h
JOIN {PAPERS} p ON p.dataset = h.dataset AND p.paper_key = h.paper_key
""")
def scores_join_papers(spark, sf_dir):
    """JN1/WIN4: scores computed apart (long form) joined back to the papers on the composite key; of a key that
    occurs twice the shortest paper counts."""
    hits = _query_term_hits(spark, sf_dir)
    p = papers(spark, sf_dir).select("dataset", "paper_key", "title", "n_chars")
    return srch.join_scores(hits, p, order_col="n_chars").select("dataset", "paper_key", "title", "hits")


@query("papers_with_hits", sql=f"""
SELECT p.dataset, p.paper_key, p.topic FROM {PAPERS} p
WHERE EXISTS (SELECT 1 FROM {_HITS_SQL} h WHERE h.dataset = p.dataset AND h.paper_key = p.paper_key)
""")
def papers_with_hits(spark, sf_dir):
    """JN2: papers having at least one qualifying hit (left semi join)."""
    return (papers(spark, sf_dir).select("dataset", "paper_key", "topic")
            .join(_query_term_hits(spark, sf_dir), ["dataset", "paper_key"], "left_semi"))
