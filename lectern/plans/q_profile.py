"""Profiling queries (AGG1-AGG6, JN8, JN10, SRT1, SRT2, FLT2, FLT9, WIN6, SET1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import aliases
from lectern.operators import profile as pf
from lectern.operators.ranking import last_wins
from lectern.plans.registry import query
from lectern.plans.sqlfrag import PAPERS, clean
from lectern.sources.papers import papers, read_table

_P = PAPERS


@query("keyword_counts", sql=f"""
SELECT keyword, count(*) AS n FROM (SELECT unnest({clean('abstract')}) AS keyword FROM {_P}) GROUP BY keyword
""")
def keyword_counts(spark, sf_dir):
    """AGG1: keyword frequency; keywords = cleaned words of the text."""
    return pf.flattened_frequency(papers(spark, sf_dir), tx.clean_tokens("abstract"), "keyword")


@query("keyword_top10", sql=f"""
WITH t AS (SELECT paper_key, unnest({clean('abstract')}) AS keyword,
                  unnest(generate_series(0, len({clean('abstract')}) - 1)) AS pos FROM {_P}),
g AS (SELECT keyword, count(*) AS n, min(paper_key) AS first_key FROM t GROUP BY keyword),
f AS (SELECT g.keyword, g.n, g.first_key, min(t.pos) AS first_pos FROM g JOIN t
      ON t.keyword = g.keyword AND t.paper_key = g.first_key GROUP BY ALL)
SELECT keyword, n, first_key, first_pos FROM f ORDER BY n DESC, first_key, first_pos LIMIT 10
""")
def keyword_top10(spark, sf_dir):
    """SRT1: ten most frequent keywords, ties by first appearance."""
    counts = pf.first_seen_frequency(papers(spark, sf_dir), "paper_key", tx.clean_tokens("abstract"), "keyword")
    return pf.top_n(counts, 10, [F.col("n").desc(), F.col("first_key"), F.col("first_pos")])


@query("topic_counts", sql=f"SELECT topic, count(*) AS n FROM {_P} GROUP BY topic")
def topic_counts(spark, sf_dir):
    """AGG2: papers per topic."""
    return pf.frequency(papers(spark, sf_dir), "topic", "topic")


@query("institution_paper_counts", sql="""
SELECT n_name, count(*) AS n FROM (
  SELECT DISTINCT l.l_orderkey, n.n_name FROM lineitem l
  LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey)
GROUP BY n_name
""")
def institution_paper_counts(spark, sf_dir):
    """AGG3: per 'institution' (supplier nation) the number of distinct 'papers'
    (orders) with at least one 'author' (line supplier) from it; NULL counted."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = (li.join(sup, li.l_suppkey == sup.s_suppkey, "left")
            .join(nat, F.col("s_nationkey") == nat.n_nationkey, "left"))
    return pf.distinct_item_frequency(rows, "l_orderkey", "n_name")


@query("alias_merge_counts", sql="""
WITH c AS (SELECT n.n_name AS name, count(*) AS n FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1),
a AS (SELECT n.n_name AS alias, r.r_name AS canonical FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey)
SELECT coalesce(a.canonical, c.name) AS name, CAST(sum(c.n) AS BIGINT) AS n FROM c LEFT JOIN a ON a.alias = c.name GROUP BY 1
""")
def alias_merge_counts(spark, sf_dir):
    """JN8/AGG4: customer counts per nation, nation names aliased to their region."""
    cust = read_table(spark, sf_dir, "customer")
    nat = read_table(spark, sf_dir, "nation")
    reg = read_table(spark, sf_dir, "region")
    counts = pf.frequency(cust.join(nat, cust.c_nationkey == nat.n_nationkey), "n_name", "name")
    aliases = nat.join(reg, nat.n_regionkey == reg.r_regionkey).select(
        F.col("n_name").alias("alias"), F.col("r_name").alias("canonical"))
    return pf.alias_merge(counts, aliases, "name")


_CUSTOMER_ORDERS = "SELECT c_name AS name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_name"
_FOUND_ALIASES = f"""(SELECT alias, canonical, n, canonical_n FROM (
  SELECT x.name AS alias, y.name AS canonical, x.n, y.n AS canonical_n,
         row_number() OVER (PARTITION BY x.name ORDER BY y.n DESC, y.name) AS rn
  FROM ({_CUSTOMER_ORDERS}) x JOIN ({_CUSTOMER_ORDERS}) y ON x.name <> y.name AND levenshtein(x.name, y.name) <= 1 AND y.n >= 2 * x.n)
  WHERE rn = 1)"""


def _customer_orders(spark, sf_dir):
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    # Both are large: a small file of many customers must not be broadcast.
    return pf.frequency(o.join(c.hint("merge"), o.o_custkey == c.c_custkey), "c_name", "name")


@query("found_aliases", sql=f"SELECT * FROM {_FOUND_ALIASES}")
def found_aliases(spark, sf_dir):
    """OPT1: names at edit distance 1 of a name at least twice as frequent (customers by their orders), found without comparing all."""
    return aliases.find_aliases(_customer_orders(spark, sf_dir))


@query("alias_merge_found", sql=f"""
SELECT coalesce(a.canonical, c.name) AS name, CAST(sum(c.n) AS BIGINT) AS n FROM ({_CUSTOMER_ORDERS}) c LEFT JOIN {_FOUND_ALIASES} a ON a.alias = c.name GROUP BY 1
""")
def alias_merge_found(spark, sf_dir):
    """JN8/AGG4 with an alias table that was found in the data."""
    counts = _customer_orders(spark, sf_dir)
    return pf.alias_merge(counts, aliases.find_aliases(counts), "name")


@query("papers_per_dataset", sql=f"SELECT dataset, count(*) AS n FROM {_P} GROUP BY dataset")
def papers_per_dataset(spark, sf_dir):
    """AGG5."""
    return pf.frequency(papers(spark, sf_dir), "dataset", "dataset")


@query("bytes_per_dataset", sql=f"""
SELECT dataset, b AS bytes, CASE WHEN b < 1024 THEN printf('%4.1f B', b::DOUBLE)
  WHEN b < 1024^2 THEN printf('%4.1f KB', b / 1024) WHEN b < 1024^3 THEN printf('%4.1f MB', b / 1024^2)
  WHEN b < 1024^4 THEN printf('%4.1f GB', b / 1024^3) ELSE printf('%.1f PB', b / 1024^4) END AS size
FROM (SELECT dataset, CAST(sum(n_chars) AS BIGINT) AS b FROM {_P} GROUP BY dataset)
""")
def bytes_per_dataset(spark, sf_dir):
    """AGG6 + TXT15: size of each dataset."""
    b = papers(spark, sf_dir).groupBy("dataset").agg(F.sum("n_chars").cast("long").alias("bytes"))
    return b.withColumn("size", tx.human_bytes("bytes"))


@query("merge_counters", sql="""
WITH a AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1),
b AS (SELECT event_type AS k, count(*) AS n FROM events WHERE value > 50 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS event_type, coalesce(b.n, a.n) AS n FROM a FULL OUTER JOIN b ON a.k = b.k
""")
def merge_counters(spark, sf_dir):
    """JN10: counter of all events updated by the counter of large events (override, not sum)."""
    e = read_table(spark, sf_dir, "events")
    a = pf.frequency(e, "event_type", "event_type")
    b = pf.frequency(e.filter(F.col("value") > 50), "event_type", "event_type")
    return pf.merge_counters(a, b, "event_type")


@query("institution_top", sql="""
SELECT c.c_name, o.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o
JOIN customer c ON c.c_custkey = o.o_custkey
WHERE c.c_name IS NOT NULL AND trim(c.c_name) <> ''
ORDER BY o.n DESC, c.c_name LIMIT 40
""")
def institution_top(spark, sf_dir):
    """SRT2 + FLT9: top 40 customers by orders, blank names removed.  Orders are
    counted per key before the join, so the join sees one row per customer."""
    o = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    ranked = pf.drop_blank(o.join(c, o.o_custkey == c.c_custkey).select("c_name", "n"), "c_name")
    return pf.top_n(ranked, 40, [F.col("n").desc(), F.col("c_name")])


@query("share_pct", sql="""
SELECT event_type, n, n::DOUBLE / sum(n) OVER () AS share,
       least(100, CAST(trunc(n::DOUBLE / sum(n) OVER () * 100) AS INTEGER)) AS pct
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
""")
def share_pct(spark, sf_dir):
    """WIN6: share and percent of each event type."""
    return pf.with_share(pf.frequency(read_table(spark, sf_dir, "events"), "event_type", "event_type"))


@query("union_suffix_keys", sql="""
SELECT CAST(o_orderkey AS VARCHAR) || '_' || substr(o_orderpriority, 1, 1) || '_' || right(strftime(o_orderdate, '%Y'), 2) AS key,
       o_totalprice, o_orderstatus FROM orders
""")
def union_suffix_keys(spark, sf_dir):
    """SET1/TXT14: orders of every status form one dataset each; keys get a
    ``_{conference initial}_{yy}`` suffix, the datasets are unioned and merged
    with later datasets winning on a key clash."""
    o = read_table(spark, sf_dir, "orders")
    keyed = o.select(tx.key_suffix("o_orderkey", "o_orderpriority", F.year("o_orderdate")).alias("key"),
                     "o_totalprice", "o_orderstatus")
    parts = [keyed.filter(F.col("o_orderstatus") == s).withColumn("_ord", F.lit(i))
             for i, s in enumerate(("F", "O", "P"))]
    rest = keyed.filter(~F.col("o_orderstatus").isin("F", "O", "P") | F.col("o_orderstatus").isNull()) \
        .withColumn("_ord", F.lit(3))
    allp = parts[0]
    for p in parts[1:] + [rest]:
        allp = allp.unionByName(p)
    return last_wins(allp, "key", "_ord").drop("_ord")


@query("field_coverage", sql=f"""
SELECT p.dataset, count(*) AS papers,
  count(*) FILTER (WHERE p.title IS NOT NULL AND p.title <> '') AS titled,
  count(l.doc_id) AS labeled, count(*) FILTER (WHERE l.quality = 1) AS good
FROM {_P} p LEFT JOIN labels l ON l.doc_id = p.paper_key GROUP BY p.dataset
""")
def field_coverage(spark, sf_dir):
    """FLT2: per dataset, papers with a usable field and with labels."""
    p = papers(spark, sf_dir).select("dataset", "paper_key", "title")
    lab = read_table(spark, sf_dir, "labels")
    j = p.join(lab, p.paper_key == lab.doc_id, "left")
    return j.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("papers"),
        F.count(F.when(F.col("title").isNotNull() & (F.col("title") != ""), 1)).alias("titled"),
        F.count("doc_id").alias("labeled"),
        F.count(F.when(F.col("quality") == 1, 1)).alias("good"))
