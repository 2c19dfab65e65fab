"""Fuzzy search, edit-distance style metrics and dataset-management queries
(SIM8, OPT1-OPT6, OPT8, FLT5, FLT6, FLT10, SRC3, SRC8, SRC9, SRC11, JN5-JN7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import fuzzy as fz
from lectern.functions import text as tx
from lectern.operators import relational as rel
from lectern.operators import search as srch
from lectern.operators import setjoin
from lectern.plans.registry import query
from lectern.plans.sqlfrag import PAPERS, clean, sql_str, vec
from lectern.sources.papers import papers, read_table

_P = PAPERS
# Fuzzy queries (fixed values): one substring-rich, one needing the dynamic programme.
FUZZY_SUB = "re"
FUZZY_TITLE = "anhe"
FUZZY_PARTS = "rdg"


@query("fuzzy_substring", sql=rf"""
WITH c AS (SELECT p_partkey, p_name, lower(p_name) AS low FROM part WHERE strpos(lower(p_name), '{FUZZY_SUB}') > 0),
s AS (SELECT *, length(low) - strpos(reverse(low), reverse('{FUZZY_SUB}')) - {len(FUZZY_SUB)} + 2 AS st FROM c)
SELECT p_partkey, p_name, round(({len(FUZZY_SUB)} + len(regexp_extract_all(
         (CASE WHEN st = 1 THEN ' ' ELSE substr(low, st - 1, 1) END) || substr(low, st, {len(FUZZY_SUB)}),
         '[^\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_]')))::DOUBLE * 2.0 * (CASE WHEN low = '{FUZZY_SUB}' THEN 2.0 ELSE 1.5 END), 3) AS score
FROM s
""")
def fuzzy_substring(spark, sf_dir):
    """SIM8 native path: candidates containing the query, scored without Python."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    low = F.lower(F.col("p_name"))
    return (part.filter(F.instr(low, FUZZY_SUB) > 0)
            .select("p_partkey", "p_name", F.round(fz._substring_score(low, FUZZY_SUB), 3).alias("score")))


@query("fuzzy_search")
def fuzzy_search(spark, sf_dir):
    """SIM8 + SIM9: fuzzy search on whole texts, strict threshold, top 10 per dataset."""
    res = srch.search(papers(spark, sf_dir), FUZZY_TITLE, "Fuzzy", "abstract", 10, 5.0)
    return res.select("dataset", "paper_key", "title", "metric_match", "metric_thres", "conference")


@query("fuzzy_part_names")
def fuzzy_part_names(spark, sf_dir):
    """SIM8: fuzzy scores of every part name containing the query as a subsequence."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return fz.score_fuzzy(part, FUZZY_PARTS, F.col("p_name")).select(
        "p_partkey", "p_name", F.round("score", 3).alias("score"))


@query("lcs")
def lcs(spark, sf_dir):
    """OPT4: longest common subsequence of each text with the query (pandas UDF)."""
    from lectern.plans.q_search import QUERY
    return papers(spark, sf_dir).select("dataset", "paper_key", fz.lcs_column(F.col("abstract"), QUERY).alias("lcs"))


@query("levenshtein_search", sql="""
SELECT p_partkey, p_name, levenshtein(p_name, 'red bolt') AS dist FROM part WHERE levenshtein(p_name, 'red bolt') <= 5
""")
def levenshtein_search(spark, sf_dir):
    """OPT1: edit distance to a query, within a bound."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    d = F.levenshtein("p_name", F.lit("red bolt")).cast("long")
    return part.select("p_partkey", "p_name", d.alias("dist")).filter(F.col("dist") <= 5)


@query("hamming", sql="""
SELECT p_partkey, p_brand, CAST(list_sum(list_transform(range(1, length(p_brand) + 1),
       lambda i: CASE WHEN substr(p_brand, i, 1) <> substr('Brand#13', i, 1) THEN 1 ELSE 0 END)) AS INTEGER) AS dist
FROM part WHERE length(p_brand) = length('Brand#13')
""")
def hamming(spark, sf_dir):
    """OPT2: Hamming distance to a same-length query."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    q = "Brand#13"
    pairs = F.zip_with(F.split("p_brand", ""), F.split(F.lit(q), ""),
                       lambda x, y: F.when(x != y, 1).otherwise(0))
    dist = F.aggregate(pairs, F.lit(0), lambda a, v: a + v)
    return part.filter(F.length("p_brand") == len(q)).select("p_partkey", "p_brand", dist.alias("dist"))


JACCARD_QUERY = "ones reed anhe heat"
_JACCARD = f"""
SELECT dataset, paper_key, len(list_intersect(a, q))::DOUBLE / len(list_distinct(list_concat(a, q))) AS jaccard
FROM (SELECT dataset, paper_key, list_distinct({clean('abstract')}) AS a, list_distinct({clean(sql_str(JACCARD_QUERY))}) AS q FROM {_P})
WHERE len(list_intersect(a, q)) > 0
"""


def _jaccard(spark, sf_dir):
    p = papers(spark, sf_dir)
    a = F.array_distinct(tx.clean_tokens("abstract"))
    q = F.array_distinct(tx.clean_tokens(F.lit(JACCARD_QUERY)))
    both = p.select("dataset", "paper_key", F.size(F.array_intersect(a, q)).alias("i"), F.size(F.array_union(a, q)).alias("u"))
    return both.filter(F.col("i") > 0).select("dataset", "paper_key", (F.col("i") / F.col("u")).alias("jaccard"))


@query("jaccard_search", sql=f"SELECT dataset, paper_key, round(jaccard, 6) AS jaccard FROM ({_JACCARD})")
def jaccard_search(spark, sf_dir):
    """OPT3: Jaccard similarity of the word sets of whole texts with the query's."""
    return _jaccard(spark, sf_dir).withColumn("jaccard", F.round("jaccard", 6))


@query("similar_sets", sql=f"""
WITH p AS (SELECT paper_key, list_sort(list_distinct({vec('abstract')})) AS s FROM {PAPERS}),
c AS (SELECT s, min(paper_key) AS match, count(*) AS members FROM p WHERE len(s) > 0 GROUP BY s),
t AS (SELECT match, len(s) AS n, unnest(s) AS token FROM c),
q AS (SELECT DISTINCT c.match AS own FROM p JOIN c USING (s) WHERE p.paper_key % 50 = 0),
i AS (SELECT a.match AS own, b.match, count(*) AS common, any_value(a.n) + any_value(b.n) - count(*) AS u
      FROM t a JOIN q ON a.match = q.own JOIN t b USING (token) GROUP BY a.match, b.match)
SELECT p.paper_key AS query, i.match, c.members, i.common, CAST(i.u AS INTEGER) AS "union"
FROM p JOIN c AS own ON own.s = p.s JOIN i ON i.own = own.match JOIN c ON c.match = i.match
WHERE p.paper_key % 50 = 0 AND i.common * 100 >= i.u * 60 AND (i.match <> own.match OR c.members > 1)
""")
def similar_sets_q(spark, sf_dir):
    """OPT3 for all papers: papers whose id 50 divides against all, Jaccard of their cleaned terms at least 0.6, exact."""
    p = papers(spark, sf_dir)
    found = setjoin.similar_sets(p, F.col("paper_key") % 50 == 0, tx.vector_tokens("abstract"), 60)
    return found.withColumn("common", F.col("common").cast("long"))


@query("jaccard_topk", sql=f"""
SELECT dataset, paper_key, round(jaccard, 6) AS jaccard FROM ({_JACCARD}) ORDER BY jaccard DESC, paper_key, dataset LIMIT 10
""")
def jaccard_topk(spark, sf_dir):
    """OPT3: the ten most similar papers, exact (the scores are in-row, so one scan finds them)."""
    best = _jaccard(spark, sf_dir).orderBy(F.col("jaccard").desc(), "paper_key", "dataset").limit(10)
    return best.withColumn("jaccard", F.round("jaccard", 6))


@query("paper_lookup", sql=f"SELECT dataset, paper_key, title, n_chars FROM {_P} WHERE dataset = 'src3' AND paper_key = 3")
def paper_lookup(spark, sf_dir):
    """FLT5: point lookup (filters reach the parquet scan)."""
    return rel.lookup(papers(spark, sf_dir), "src3", 3).select("dataset", "paper_key", "title", "n_chars")


@query("remove_datasets", sql=f"""
SELECT dataset, count(*) AS n FROM {_P} WHERE NOT contains(dataset, 'src1') AND dataset NOT IN ('src2', 'src5') GROUP BY dataset
""")
def remove_datasets(spark, sf_dir):
    """FLT6/SET4: datasets removed by substring and by list."""
    kept = rel.remove_datasets(papers(spark, sf_dir), "src1", ["src2", "src5"])
    return kept.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


_NAMES_SQL = "(SELECT DISTINCT strftime(o_orderdate, '%Y') || '_' || o_orderpriority AS name FROM orders)"


def _names(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("_"), "o_orderpriority").alias("name")).distinct()


@query("repair_scope", sql=f"""
SELECT name FROM {_NAMES_SQL}
WHERE CAST(split_part(name, '_', 1) AS INTEGER) BETWEEN 1996 AND 1998 AND split_part(name, '_', 2) IN ('1-URGENT', '2-HIGH')
""")
def repair_scope(spark, sf_dir):
    """FLT10: datasets in a year range and conference list."""
    from lectern.sources.papers import split_dataset_name
    y, c = split_dataset_name("name")
    return _names(spark, sf_dir).filter(y.between(1996, 1998) & c.isin("1-URGENT", "2-HIGH"))


@query("dataset_route", sql=rf"""
SELECT name, CASE WHEN regexp_matches(name, '\d{{4}}') THEN 'conferences' ELSE 'searches' END AS folder
FROM (SELECT name FROM {_NAMES_SQL} UNION SELECT DISTINCT source FROM documents)
""")
def dataset_route(spark, sf_dir):
    """SRC3: folder of each dataset name."""
    names = _names(spark, sf_dir).unionByName(
        read_table(spark, sf_dir, "documents").select(F.col("source").alias("name"))).distinct()
    return names.select("name", rel.route_folder("name").alias("folder"))


def _catalog(spark, sf_dir):
    confs = _names(spark, sf_dir).select("name", F.lit(0).alias("folder_ord"))
    searches = read_table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct() \
        .select("name", F.lit(1).alias("folder_ord"))
    entries = confs.unionByName(searches).withColumn("is_file", F.lit(1))
    return rel.catalog(entries)


_CATALOG_SQL = f"""(SELECT name, folder_ord, row_number() OVER (ORDER BY folder_ord, lower(name), name) - 1 AS idx FROM (
  SELECT name, 0 AS folder_ord FROM {_NAMES_SQL} UNION ALL SELECT DISTINCT source, 1 FROM documents)
  WHERE NOT starts_with(name, '.'))"""


@query("dataset_catalog", sql=f"SELECT name, folder_ord, idx FROM {_CATALOG_SQL}")
def dataset_catalog(spark, sf_dir):
    """SRC8/SRT4: dataset list over two folders, numbered in display order."""
    return _catalog(spark, sf_dir).select("name", "folder_ord", "idx")


@query("dataset_class", sql=f"""
SELECT name, CASE WHEN split_part(name, '_', 2) IN ('ICML', 'ICLR', 'NEURIPS') THEN 'main'
  WHEN split_part(name, '_', 2) IN ('COLT', 'AISTATS', 'AAAI', 'CHIL', 'ML4H', 'ICCV', 'ECCV') THEN 'sub' ELSE 'other' END AS class
FROM (SELECT name FROM {_NAMES_SQL} UNION SELECT strftime(o_orderdate, '%Y') || '_' || upper(o_orderstatus) FROM orders)
""")
def dataset_class(spark, sf_dir):
    """SRC9: main / sub / other class from the name."""
    o = read_table(spark, sf_dir, "orders")
    names = _names(spark, sf_dir).unionByName(
        o.select(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("_"), F.upper("o_orderstatus")).alias("name"))
    ).distinct()
    return names.select("name", rel.dataset_class("name").alias("class"))


@query("selection_lookup", sql=f"""
WITH c AS {_CATALOG_SQL}, s AS (SELECT DISTINCT user_id AS idx FROM events)
SELECT s.idx, c.name, c.folder_ord, CASE WHEN c.idx IS NULL THEN 'invalid' ELSE 'ok' END AS status
FROM s LEFT JOIN c ON c.idx = s.idx
""")
def selection_lookup(spark, sf_dir):
    """JN7: selected indices (the user ids of events) looked up in the catalog."""
    cat = _catalog(spark, sf_dir).select("idx", "name", "folder_ord")
    sel = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("idx"))
    return rel.select_by_index(cat, sel).select("idx", "name", "folder_ord", "status")


@query("year_conf_grid", sql="""
WITH b AS (SELECT min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1 FROM orders),
g AS (SELECT r.r_name AS conference, CAST(y AS INTEGER) AS year FROM region r, b, generate_series(b.y0, b.y1) t(y)),
landed AS (SELECT DISTINCT year(o.o_orderdate) AS year, r.r_name AS conference FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey)
SELECT g.year, g.conference, l.year IS NOT NULL AS landed FROM g LEFT JOIN landed l ON l.year = g.year AND l.conference = g.conference
""")
def year_conf_grid(spark, sf_dir):
    """SRC11/JN11: every year x region, flagged when orders exist for it."""
    o = read_table(spark, sf_dir, "orders")
    reg = read_table(spark, sf_dir, "region")
    y0 = o.select(F.min(F.year("o_orderdate"))).scalar()
    y1 = o.select(F.max(F.year("o_orderdate"))).scalar()
    grid = rel.expected_grid(reg, "r_name", y0, y1)
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    landed = (o.select("o_custkey", F.year("o_orderdate").alias("year"))
              .join(cust, F.col("o_custkey") == F.col("c_custkey"))
              .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
              .select("year", F.col("r_name").alias("conference")).distinct()
              .withColumn("landed", F.lit(True)))
    return (grid.join(landed, ["year", "conference"], "left")
            .select("year", "conference", F.coalesce("landed", F.lit(False)).alias("landed")))


@query("add_if_absent", sql=f"""
WITH loaded AS (SELECT dataset, paper_key FROM {_P}),
new AS (SELECT topic AS dataset, paper_key FROM {_P} UNION ALL SELECT dataset, paper_key FROM {_P}),
allp AS (SELECT * FROM loaded UNION ALL SELECT * FROM new WHERE dataset NOT IN (SELECT dataset FROM loaded))
SELECT dataset, count(*) AS n FROM allp GROUP BY dataset
""")
def add_if_absent(spark, sf_dir):
    """JN6: datasets keyed by language are added; those already loaded are skipped."""
    p = papers(spark, sf_dir)
    loaded = p.select("dataset", "paper_key")
    new = p.select(F.col("topic").alias("dataset"), "paper_key").unionByName(loaded)
    return rel.add_if_absent(loaded, new).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("enrich_left_join", sql=f"""
SELECT p.paper_key, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, p.topic
FROM {_P} p LEFT JOIN labels l ON l.doc_id = p.paper_key
""")
def enrich_left_join(spark, sf_dir):
    """JN5: papers enriched by extracted extras; a missing extra keeps the defaults."""
    p = papers(spark, sf_dir).select("paper_key", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"), "topic")
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_key"), "quality", "toxic")
    return rel.enrich(p, lab, "paper_key")


@query("year_filter", sql="""
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE year(o_orderdate) = 1997 GROUP BY 1
""")
def year_filter(spark, sf_dir):
    """OPT6: one year's orders by priority."""
    o = read_table(spark, sf_dir, "orders")
    return (o.filter((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
                     & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")))
            .groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"),
                                            F.round(F.sum("o_totalprice"), 2).alias("total")))


@query("date_scope", sql="""
WITH m AS (SELECT max(o_orderdate) AS mx FROM orders)
SELECT 'All Dates' AS scope, count(*) AS n FROM orders
UNION ALL SELECT 'Past 12 Months', count(*) FROM orders, m WHERE o_orderdate > mx - INTERVAL 12 MONTH
UNION ALL SELECT 'Specific Year', count(*) FROM orders WHERE year(o_orderdate) = 1998
UNION ALL SELECT 'Date Range', count(*) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-06-30'
""")
def date_scope(spark, sf_dir):
    """OPT8: counts under the four date scopes; 'Past 12 Months' is relative to the
    latest order (a scalar subquery), the others are range filters on the scan."""
    o = read_table(spark, sf_dir, "orders").select("o_orderdate")
    mx = o.select(F.max("o_orderdate")).scalar()
    d = F.col("o_orderdate")
    scopes = {
        "All Dates": F.lit(True),
        "Past 12 Months": d > mx - F.expr("INTERVAL 12 MONTHS"),
        "Specific Year": (d >= F.lit("1998-01-01").cast("timestamp")) & (d < F.lit("1999-01-01").cast("timestamp")),
        "Date Range": d.between(F.lit("1996-03-01").cast("timestamp"), F.lit("1997-06-30").cast("timestamp")),
    }
    # one scan, one aggregate: each scope is a conditional count
    counts = o.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in scopes.items()])
    return counts.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(k) for k in scopes]), F.array(*[F.col(f"`{k}`") for k in scopes]))).alias("scope", "n"))
