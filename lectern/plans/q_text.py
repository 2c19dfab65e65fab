"""Text-function queries (TXT1-TXT16, DAT1, AGG7/AGG8/AGG13, JN3, SET3, FLT4).

Long text results are compared through ``md5`` plus length so that whole texts
are processed while the result stays small.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators.ranking import dense_position
from lectern.plans.registry import query
from lectern.plans.sqlfrag import PAPERS, STOPWORDS, clean, norm, vec, words
from lectern.sources.catalog import read_stopwords
from lectern.sources.papers import papers, read_table
from lectern.sources.sinks import scratch_path

_P = PAPERS


@query("normalize_text", sql=f"""
SELECT paper_key, md5({norm('abstract')}) AS norm_md5, length({norm('abstract')}) AS norm_len FROM {_P}
""")
def normalize_text(spark, sf_dir):
    """TXT1 over every abstract."""
    n = tx.normalize_text(F.coalesce(F.col("abstract"), F.lit("")))
    return papers(spark, sf_dir).select("paper_key", F.md5(n).alias("norm_md5"),
                                        F.length(n).cast("long").alias("norm_len"))


@query("tokenize", sql=f"""
SELECT paper_key, len({words('abstract')}) AS n_tokens,
       md5(array_to_string({words('abstract')}, ' ')) AS tokens_md5 FROM {_P}
""")
def tokenize(spark, sf_dir):
    """TXT2: lower-case word tokens."""
    t = F.col("t")
    return (papers(spark, sf_dir).select("paper_key", tx.word_tokens(F.coalesce("abstract", F.lit(""))).alias("t"))
            .select("paper_key", F.size(t).cast("long").alias("n_tokens"),
                    F.md5(F.array_join(t, " ")).alias("tokens_md5")))


@query("clean_tokens", sql=f"""
SELECT paper_key, len({clean('abstract')}) AS n_clean, md5(array_to_string({clean('abstract')}, ' ')) AS clean_md5
FROM {_P}
""")
def clean_tokens(spark, sf_dir):
    """TXT3: stop words and numeric tokens removed."""
    t = F.col("t")
    return (papers(spark, sf_dir).select("paper_key", tx.clean_tokens("abstract").alias("t"))
            .select("paper_key", F.size(t).cast("long").alias("n_clean"),
                    F.md5(F.array_join(t, " ")).alias("clean_md5")))


@query("clean_text", sql=f"""
SELECT paper_key, array_to_string({clean('title')}, ' ') AS clean_title,
       md5(array_to_string({clean('abstract')}, ' ')) AS clean_abstract_md5 FROM {_P}
""")
def clean_text(spark, sf_dir):
    """TXT4: cleaned title (shown) and abstract (hashed)."""
    return papers(spark, sf_dir).select(
        "paper_key", tx.clean_text("title").alias("clean_title"),
        F.md5(tx.clean_text("abstract")).alias("clean_abstract_md5"))


@query("term_counts", sql=f"""
SELECT dataset, paper_key, term, count(*) AS n FROM (
  SELECT dataset, paper_key, unnest({vec('abstract')}) AS term FROM {_P}) GROUP BY ALL
""")
def term_counts(spark, sf_dir):
    """AGG7: term counts per paper (long, sparse form), counted inside each row
    (sorted tokens, run lengths): a map-only job, no shuffle."""
    toks = papers(spark, sf_dir).select("dataset", "paper_key",
                                        F.sort_array(tx.vector_tokens("abstract")).alias("_s"))
    return (toks.select("dataset", "paper_key", F.inline(vx.term_count_pairs("_s")))
            .select("dataset", "paper_key", "term", "n"))


@query("tf_l1", sql=f"""
WITH t AS (SELECT dataset, paper_key, unnest({vec('abstract')}) AS term FROM {_P}),
c AS (SELECT dataset, paper_key, term, count(*) AS n FROM t GROUP BY ALL)
SELECT dataset, paper_key, term, n::DOUBLE / sum(n) OVER (PARTITION BY dataset, paper_key) AS tf FROM c
""")
def tf_l1(spark, sf_dir):
    """SIM1/AGG8: L1-normalised term frequencies: in-row counts divided by the
    paper's token count (map-only, no shuffle, no window)."""
    toks = papers(spark, sf_dir).select("dataset", "paper_key",
                                        F.sort_array(tx.vector_tokens("abstract")).alias("_s"))
    pairs = toks.select("dataset", "paper_key", F.size("_s").alias("total"), F.inline(vx.term_count_pairs("_s")))
    return pairs.select("dataset", "paper_key", "term",
                        (F.col("n").cast("double") / F.col("total").cast("double")).alias("tf"))


@query("vocabulary", sql=f"""
SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_index FROM (
  SELECT DISTINCT unnest({vec('abstract')}) AS term FROM {_P})
""")
def vocabulary(spark, sf_dir):
    """AGG13: sorted distinct terms with their index.  The index is assigned with a
    range-partitioned position, not a single-task global window."""
    terms = (papers(spark, sf_dir).select(F.explode(F.array_distinct(tx.vector_tokens("abstract"))).alias("term"))
             .distinct().withColumn("_all", F.lit(0)))
    return dense_position(terms, "_all", "term", out="term_index").select("term", "term_index")


@query("stopword_antijoin", sql=f"""
WITH t AS (SELECT paper_key, unnest({words('abstract')}) AS token,
                  unnest(generate_series(0, len({words('abstract')}) - 1)) AS pos FROM {_P})
SELECT paper_key, pos, token FROM t WHERE NOT list_contains({STOPWORDS}, token)
""")
def stopword_antijoin(spark, sf_dir):
    """JN3 long form: tokens with their position, minus stop words (broadcast anti join;
    the stop list is a fixed, small table)."""
    sw = spark.createDataFrame([(w,) for w in tx.default_stopwords()], "token string")
    toks = papers(spark, sf_dir).select(
        "paper_key", F.posexplode(tx.word_tokens(F.coalesce("abstract", F.lit("")))).alias("pos", "token"))
    return (toks.join(F.broadcast(sw), "token", "left_anti")
            .select("paper_key", F.col("pos").cast("long").alias("pos"), "token"))


STOP_FILE_WORDS = 50


@query("stopword_file", sql=f"""
WITH t AS (SELECT dataset, unnest({words('abstract')}) AS token FROM {_P}),
f AS (SELECT token FROM t GROUP BY token ORDER BY count(*) DESC, token LIMIT {STOP_FILE_WORDS})
SELECT dataset, count(*) AS kept FROM t WHERE token NOT IN (SELECT token FROM f) GROUP BY dataset
""")
def stopword_file(spark, sf_dir):
    """SRC10/JN3: the most frequent tokens are written as a stop-word file (each twice, with blank lines), which is read as a set and
    taken out of the tokens of every dataset."""
    toks = papers(spark, sf_dir).select("dataset", F.explode(tx.word_tokens(F.coalesce("abstract", F.lit("")))).alias("token"))
    often = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "token").limit(STOP_FILE_WORDS)
    path = scratch_path(spark, "stopwords")
    often.select(F.explode(F.array("token", F.lit(""), "token")).alias("value")).write.text(path)
    stop = read_stopwords(spark, path).withColumnRenamed("word", "token")
    return toks.join(F.broadcast(stop), "token", "left_anti").groupBy("dataset").agg(F.count(F.lit(1)).alias("kept"))


@query("distinct_terms", sql=f"""
SELECT paper_key, len(list_distinct({clean('abstract')})) AS n_distinct, len({clean('abstract')}) AS n_clean FROM {_P}
""")
def distinct_terms(spark, sf_dir):
    """SET3: distinct cleaned terms per paper."""
    return (papers(spark, sf_dir).select("paper_key", tx.clean_tokens("abstract").alias("t"))
            .select("paper_key", F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
                    F.size("t").cast("long").alias("n_clean")))


@query("title_key", sql=r"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\p{L}\p{N}\s]', '', 'g')) AS key
FROM pages
""")
def title_key(spark, sf_dir):
    """TXT7 on page titles."""
    t = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return read_table(spark, sf_dir, "pages").select("page_id", tx.title_key(t).alias("key"))


@query("paper_keys", sql=r"""
SELECT dataset, paper_key, (row_number() OVER (PARTITION BY dataset ORDER BY paper_key) - 1) || '_' ||
       trim(regexp_replace(title, '[^\p{L}\p{N}\s]', '', 'g')) AS key
FROM """ + _P)
def paper_keys(spark, sf_dir):
    """WIN1 + TXT7: ``{position in dataset}_{title}``; positions come from a
    skew-safe range-partitioned numbering, not a window per dataset."""
    p = papers(spark, sf_dir).select("dataset", "paper_key", "title")
    pos = dense_position(p, "dataset", "paper_key")
    return pos.select("dataset", "paper_key", tx.paper_key(F.col("pos"), "title").alias("key"))


@query("repair_key", sql=r"""
SELECT paper_key,
  regexp_replace(paper_key || '_ ' || trim(regexp_replace(title, '[^\p{L}\p{N}\s]', '', 'g')), '^([^_]*)_ ', '\1_') AS fixed_spaced,
  regexp_replace(paper_key || '_' || trim(regexp_replace(title, '[^\p{L}\p{N}\s]', '', 'g')), '^([^_]*)_ ', '\1_') AS fixed_plain
FROM """ + _P)
def repair_key(spark, sf_dir):
    """TXT8 on keys written with and without the stray space after the index."""
    p = papers(spark, sf_dir)
    k = tx.title_key("title")
    return p.select("paper_key",
                    tx.repair_key(F.concat(F.col("paper_key").cast("string"), F.lit("_ "), k)).alias("fixed_spaced"),
                    tx.repair_key(F.concat(F.col("paper_key").cast("string"), F.lit("_"), k)).alias("fixed_plain"))


_DESC = "o_orderpriority || ' ' || CAST(o_orderdate AS VARCHAR) || ' ' || o_orderstatus"


@query("extract_year", sql=rf"""
SELECT o_orderkey, TRY_CAST(nullif(regexp_extract({_DESC}, '\b(19[0-9]{{2}}|20[0-9]{{2}}|2100)\b', 1), '') AS INTEGER) AS year
FROM orders
""")
def extract_year(spark, sf_dir):
    """TXT9: first year 1900-2100 in a description built from each order."""
    o = read_table(spark, sf_dir, "orders")
    desc = F.concat_ws(" ", "o_orderpriority", F.col("o_orderdate").cast("string"), "o_orderstatus")
    return o.select("o_orderkey", tx.extract_year(desc).alias("year"))


@query("url_parts", sql=r"""
SELECT page_id, split_part(url, '/', 3) AS host, regexp_extract(url, '[^/]*$') AS last_segment,
       regexp_replace(url, '\.[^.]*$', '') AS stem FROM pages
""")
def url_parts(spark, sf_dir):
    """TXT10: host, last path segment, extension stripped."""
    pg = read_table(spark, sf_dir, "pages")
    return pg.select("page_id", tx.url_host("url").alias("host"),
                     tx.url_last_segment("url").alias("last_segment"), tx.strip_extension("url").alias("stem"))


@query("derive_pdf_url", sql=r"""
SELECT page_id, regexp_replace(url, '\.[^.]*$', '') || '/' || split_part(regexp_extract(url, '[^/]*$'), '.', 1) || '.pdf' AS pdf
FROM pages
""")
def derive_pdf_url(spark, sf_dir):
    """SRC5 pdf rule over page URLs."""
    return read_table(spark, sf_dir, "pages").select("page_id", tx.derive_pdf_url("url").alias("pdf"))


@query("split_authors", sql=r"""
WITH c AS (SELECT conv_id, turn, string_split(text, ',') AS parts FROM conversations)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS ord, (i - 1) || '_' || trim(parts[i]) AS key, trim(parts[i]) AS name
FROM c, generate_series(1, len(parts)) AS g(i)
""")
def split_authors(spark, sf_dir):
    """TXT11: comma list of each turn -> numbered entries."""
    c = read_table(spark, sf_dir, "conversations")
    return (c.select("conv_id", "turn", F.explode(tx.split_authors("text")).alias("a"))
            .select("conv_id", "turn", "a.ord", "a.key", "a.name"))


_NAMES = "(SELECT DISTINCT strftime(o_orderdate, '%Y') || '_' || o_orderpriority AS name FROM orders)"


@query("split_dataset_name", sql=f"""
SELECT name, TRY_CAST(split_part(name, '_', 1) AS INTEGER) AS year, split_part(name, '_', 2) AS conference
FROM {_NAMES}
""")
def split_dataset_name(spark, sf_dir):
    """TXT12: ``{YEAR}_{CONF}`` names -> year, conference."""
    from lectern.sources.papers import split_dataset_name as split_name
    o = read_table(spark, sf_dir, "orders")
    names = o.select(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("_"), "o_orderpriority").alias("name")).distinct()
    y, c = split_name("name")
    return names.select("name", y.alias("year"), c.alias("conference"))


@query("search_name", sql=r"""
SELECT item_id, 'cosine_abstract_' || array_to_string(regexp_split_to_array(lower(trim(text)), '\s+'), '-') AS name
FROM benchmark
""")
def search_name(spark, sf_dir):
    """TXT13/SNK2: saved-search names, one per benchmark passage used as a query."""
    b = read_table(spark, sf_dir, "benchmark")
    return b.select("item_id", tx.search_name(F.lit("Cosine"), F.lit("abstract"), "text").alias("name"))


@query("human_bytes", sql="""
SELECT doc_id, CASE WHEN b < 1024 THEN printf('%4.1f B', b)
  WHEN b < 1024^2 THEN printf('%4.1f KB', b / 1024) WHEN b < 1024^3 THEN printf('%4.1f MB', b / 1024^2)
  WHEN b < 1024^4 THEN printf('%4.1f GB', b / 1024^3) ELSE printf('%.1f PB', b / 1024^4) END AS size
FROM (SELECT doc_id, CAST(n_chars * n_chars * n_chars AS DOUBLE) AS b FROM documents)
""")
def human_bytes(spark, sf_dir):
    """TXT15 over byte counts spanning B..GB (n_chars cubed)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.human_bytes(F.col("n_chars") * F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("human_duration", sql="""
SELECT event_id, CASE WHEN s <= 60 THEN printf('%d.000s', s)
  WHEN s <= 3600 THEN printf('%d.%03dm', (s * 2000 + 60) // 120 // 1000, (s * 2000 + 60) // 120 % 1000)
  ELSE printf('%d.%03dh', (s * 2000 + 3600) // 7200 // 1000, (s * 2000 + 3600) // 7200 % 1000) END AS took
FROM (SELECT event_id, CAST(floor(epoch(ts)) - floor(epoch(date_trunc('day', ts))) AS BIGINT) AS s FROM events)
""")
def human_duration(spark, sf_dir):
    """TXT16 over whole seconds since midnight of each event."""
    e = read_table(spark, sf_dir, "events")
    secs = F.unix_timestamp("ts") - F.unix_timestamp(F.date_trunc("day", "ts"))
    return e.select("event_id", tx.human_duration(secs, integral=True).alias("took"))


@query("format_ts", sql="""
SELECT event_id, strftime(ts, '%m-%d-%Y-%H-%M-%S') AS ts_text FROM events
""")
def format_ts(spark, sf_dir):
    """DAT1."""
    return read_table(spark, sf_dir, "events").select("event_id", tx.format_ts("ts").alias("ts_text"))


@query("unescape_text", sql="""
SELECT doc_id, md5(replace(replace(text, '\\r\\n', ''), '\\"', '"')) AS text_md5 FROM documents
""")
def unescape_text(spark, sf_dir):
    """TXT6 string part: literal escapes removed."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.unescape_text("text")).alias("text_md5"))


@query("numeric_string", sql=r"""
SELECT event_id,
  regexp_full_match(trim(CAST(user_id AS VARCHAR)), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') AS user_numeric,
  regexp_full_match(trim(event_type), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') AS type_numeric,
  regexp_full_match(trim(regexp_extract(props, ':\s*([^}]*)', 1)), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') AS k_numeric
FROM events
""")
def numeric_string(spark, sf_dir):
    """FLT4: numeric-string validation of text fields."""
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id",
                    tx.is_numeric_string(F.col("user_id").cast("string")).alias("user_numeric"),
                    tx.is_numeric_string("event_type").alias("type_numeric"),
                    tx.is_numeric_string(F.regexp_extract("props", r":\s*([^}]*)", 1)).alias("k_numeric"))
