"""Ingest and sink queries (SRC1, SRC4-SRC7, SNK1, SNK3, JSN1-JSN3, TXT6, MAP1, AGG10, AGG12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import jsonfn as js
from lectern.functions import text as tx
from lectern.operators.ranking import dense_position
from lectern.plans.registry import query
from lectern.plans.sqlfrag import PAPERS
from lectern.sources import feeds, objects, sinks
from lectern.sources.papers import papers, read_table

_YEAR = r"\b(19[0-9]{2}|20[0-9]{2}|2100)\b"
# Feed-index registry for the orders-as-index-items query (fixed values).
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
API_HOST = "https://api.example.org/conv/"


@query("json_object_explode", sql="""
SELECT event_id, CAST(i - 1 AS INTEGER) AS pos, json_keys(props)[i] AS key, props ->> json_keys(props)[i] AS value
FROM events, generate_series(1, len(json_keys(props))) g(i)
""")
def json_object_explode(spark, sf_dir):
    """SRC1 core: a JSON object text -> (position, key, value) rows in file order."""
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.posexplode(F.from_json("props", "map<string,string>")).alias("pos", "key", "value"))


def _payloads(spark, sf_dir):
    """One API payload per conversation turn, one result per word of its text."""
    c = read_table(spark, sf_dir, "conversations")
    site = F.concat(F.lit("/virtual/"), F.col("conv_id").cast("string"), F.lit("/"))
    results = F.transform(F.split("text", " "), lambda w, i: F.struct(
        i.cast("string").alias("id"), w.alias("name"),
        F.array(F.struct(F.col("role").alias("fullname"), F.concat(F.lit("inst-"), "role").alias("institution")))
        .alias("authors"),
        F.concat(w, F.lit(" by "), F.col("role")).alias("abstract"),
        F.array("role").alias("keywords"), F.col("role").alias("topic"),
        F.concat(site, i.cast("string")).alias("virtualsite_url")))
    return c.select(
        "conv_id", "turn", F.concat(F.lit(API_HOST), F.col("conv_id").cast("string")).alias("url"),
        F.to_json(F.struct(F.size(results).cast("long").alias("count"), results.alias("results"))).alias("payload"))


@query("payload_to_papers", sql="""
SELECT conv_id, turn, (i - 1) || '_' || w AS paper_key, w AS name, '0_' || role AS author_key, role AS topic,
       'https://api.example.org' || '/virtual/' || conv_id || '/' || (i - 1) AS virtualsite_url,
       md5(w || ' by ' || role) AS abstract_md5
FROM (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS w,
             unnest(generate_series(1, len(string_split(text, ' ')))) AS i FROM conversations)
""")
def payload_to_papers(spark, sf_dir):
    """SRC4/JSN3: conversation turns as JSON API payloads with one result per word, parsed
    back into papers; keys are unique in a payload however many results it has."""
    p = feeds.api_papers(_payloads(spark, sf_dir), keep=["conv_id", "turn"])
    return p.select("conv_id", "turn", "paper_key", "name", F.element_at(F.map_keys("author"), 1).alias("author_key"),
                    "topic", "virtualsite_url", F.md5("abstract").alias("abstract_md5"))


@query("feed_item_to_paper", sql=r"""
SELECT host, pos || '_' || trim(regexp_replace(title, '[^\p{L}\p{N}\s]', '', 'g')) AS paper_key, title, url,
       CAST(page_id AS VARCHAR) AS id,
       regexp_replace(url, '\.[^.]*$', '') || '/' || split_part(regexp_extract(url, '[^/]*$'), '.', 1) || '.pdf' AS pdf,
       md5(array_to_string(regexp_extract_all(html, '<p[^>]*>(.*?)</p>', 1), chr(10))) AS abstract_md5
FROM (SELECT *, split_part(url, '/', 3) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
             row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) - 1 AS pos FROM pages)
""")
def feed_item_to_paper(spark, sf_dir):
    """SRC5: pages as feed items of their host's feed -> papers keyed by feed position."""
    pg = read_table(spark, sf_dir, "pages")
    items = pg.select(tx.url_host("url").alias("host"), "page_id",
                      F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
                      feeds.paragraphs(F.col("html")).alias("description"),
                      F.col("url").alias("link"), F.col("page_id").cast("string").alias("guid"))
    items = dense_position(items, "host", "page_id")
    return feeds.items_to_papers(items, keep=["host"]).select(
        "host", "paper_key", "title", "url", "id", "pdf", F.md5("abstract").alias("abstract_md5"))


_DESC_SQL = "o_orderpriority || ' ' || CAST(o_orderdate AS VARCHAR) || ' ' || o_orderstatus"


@query("feed_index", sql=f"""
WITH i AS (SELECT o_orderkey AS pos, 'orders/' || o_orderkey AS link, {_DESC_SQL} AS d FROM orders),
c AS (SELECT unnest([{", ".join("'" + p + "'" for p in PRIORITIES)}]) AS conference),
h AS (SELECT i.pos, i.link, TRY_CAST(nullif(regexp_extract(i.d, '{_YEAR}', 1), '') AS INTEGER) AS year, c.conference
      FROM i JOIN c ON contains(i.d, c.conference))
SELECT year, conference, arg_max(link, pos) AS link FROM h WHERE year >= 1997 GROUP BY year, conference
""")
def feed_index(spark, sf_dir):
    """SRC6/JN9/FLT7: orders as index items; known names in the description, first
    year >= 1997, last link per (year, name)."""
    o = read_table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("pos"),
                     F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("link"),
                     F.concat_ws(" ", "o_orderpriority", F.col("o_orderdate").cast("string"), "o_orderstatus")
                     .alias("description"))
    return feeds.feed_index(items, PRIORITIES, year_limit=1997)


@query("feed_index_registry", sql=f"""
WITH i AS (SELECT o_orderkey AS pos, 'orders/' || o_orderkey AS link,
                  o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' for ' || c_name || ' of ' || n_name AS d
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT DISTINCT o_orderpriority AS conference FROM orders UNION SELECT c_name FROM customer UNION SELECT n_name FROM nation),
y AS (SELECT pos, link, d, TRY_CAST(nullif(regexp_extract(d, '{_YEAR}', 1), '') AS INTEGER) AS year FROM i)
SELECT year, conference, arg_max(link, pos) AS link FROM y JOIN c ON contains(y.d, c.conference) WHERE year >= 1997 GROUP BY year, conference
""")
def feed_index_registry(spark, sf_dir):
    """SRC6/JN9 with a registry from tables: names of priorities, customers and nations in orders as index items."""
    t = {name: read_table(spark, sf_dir, name) for name in ("orders", "customer", "nation")}
    o = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    items = o.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("link"),
                     F.concat("o_orderpriority", F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" for "), "c_name", F.lit(" of "), "n_name")
                     .alias("description"))
    names = (t["orders"].select(F.col("o_orderpriority").alias("name")).union(t["customer"].select("c_name")).union(t["nation"].select("n_name")))
    return feeds.feed_index_from(items, names, year_limit=1997)


_LI = r'<li[^>]*>\s*<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>\s*</li>'


@query("page_list_items", sql=f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, regexp_extract_all(html, '{_LI}', 1)[i] AS href,
       regexp_extract_all(html, '{_LI}', 2)[i] AS caption
FROM pages, generate_series(1, len(regexp_extract_all(html, '{_LI}', 1))) g(i)
""")
def page_list_items(spark, sf_dir):
    """SRC7 regex form: list items with their link and caption."""
    return feeds.page_list_items(read_table(spark, sf_dir, "pages"))


@query("page_links", sql=f"""
WITH li AS (SELECT page_id, i AS ord, regexp_extract_all(html, '{_LI}', 1)[i] AS href,
                   regexp_extract_all(html, '{_LI}', 2)[i] AS caption
            FROM pages, generate_series(1, len(regexp_extract_all(html, '{_LI}', 1))) g(i))
SELECT p.page_id,
  coalesce((SELECT arg_max(href, ord) FROM li WHERE li.page_id = p.page_id AND caption = 'Software'), '') AS github_url,
  coalesce((SELECT arg_max(href, ord) FROM li WHERE li.page_id = p.page_id AND caption = 'Download PDF'), '') AS pmlr_pdf,
  coalesce((SELECT arg_max(href, ord) FROM li WHERE li.page_id = p.page_id AND caption = 'Supplementary PDF'), '') AS supplemental
FROM pages p
""")
def page_links(spark, sf_dir):
    """FLT8/AGG10: known link captions pivoted into paper fields for every page."""
    return feeds.page_links(read_table(spark, sf_dir, "pages"))


@query("page_title", sql=r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
       regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS h1,
       md5(array_to_string(regexp_extract_all(html, '<p[^>]*>(.*?)</p>', 1), chr(10))) AS paragraphs_md5,
       CAST(CASE WHEN regexp_extract(html, '<span class="authors">([^<]*)</span>', 1) = '' THEN 0
            ELSE len(string_split(regexp_extract(html, '<span class="authors">([^<]*)</span>', 1), ',')) END AS INTEGER) AS n_authors,
       trim(regexp_extract(html, '<div id="info">([^<]*)</div>', 1)) AS conf_info
FROM pages
""")
def page_title(spark, sf_dir):
    """SRC7 regex form: title, heading, paragraphs, authors, conference info."""
    parts = feeds.page_parts(read_table(spark, sf_dir, "pages"))
    return parts.select("page_id", "title", "h1", F.md5("paragraphs").alias("paragraphs_md5"),
                        F.size("authors").alias("n_authors"), "conf_info")


@query("object_files", sql=f"""
SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY paper_key) - 1 AS INTEGER) AS pos, CAST(paper_key AS VARCHAR) AS paper_key,
       md5(title) AS title_md5, md5(abstract) AS abstract_md5, topic, n_chars FROM {PAPERS}
""")
def object_files(spark, sf_dir):
    """SNK1 compat layout + SRC1/SRC2: every dataset is written as one JSON object in parts, and read back by splits, in file order."""
    p = papers(spark, sf_dir).withColumn("pos", F.col("paper_key"))
    path = sinks.scratch_path(spark, "objects")
    objects.write_object_parts(p, path)
    back = objects.read_large_objects(spark, path, in_parts=True)
    paper = F.from_json("paper_json", "title string, abstract string, topic string, n_chars long")
    return (back.select("dataset", "pos", "paper_key", paper.alias("p"))
            .select("dataset", "pos", "paper_key", F.md5("p.title").alias("title_md5"), F.md5("p.abstract").alias("abstract_md5"), "p.topic", "p.n_chars"))


@query("parse_pages", sql=r"""
SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda x, i: (i - 1) || '_' || trim(x)), '|') AS author_keys,
       coalesce(regexp_extract_all(html, '<li>\s*<a[^>]*href="([^"]*)"[^>]*>Download PDF</a>\s*</li>', 1)[-1], url) AS pmlr_pdf,
       coalesce(regexp_extract_all(html, '<li>\s*<a[^>]*href="([^"]*)"[^>]*>Software</a>\s*</li>', 1)[-1], '') AS github_url,
       'page ' || page_id || ' & more' AS conf_info
FROM pages
""")
def parse_pages(spark, sf_dir):
    """SRC7 parser form over whole pages, each with a paper's parts put before it: authors (the parts of its url), a
    captioned link, the conference line, and markup as pages really have it (a marked section, unclosed and stray tags)."""
    pages = read_table(spark, sf_dir, "pages")
    head = F.concat(F.lit("<![if !IE]></b><p><span class='x authors'>"), F.array_join(F.split("url", "/"), ", "),
                    F.lit('</span></i><ul><li><a href="'), "url", F.lit('">Download <b>PDF</a></ul><div id=info> page '),
                    F.col("page_id").cast("string"), F.lit(" &amp; more </div>"))
    found = feeds.parse_pages(pages.select("page_id", F.concat(head, "html").alias("html")))
    keys = F.array_join(F.transform(F.array_sort(F.transform(F.map_keys("authors"), lambda k: F.struct(
        F.split_part(k, F.lit("_"), F.lit(1)).cast("int").alias("i"), k.alias("k")))), lambda x: x["k"]), "|")
    return found.select("page_id", keys.alias("author_keys"), "pmlr_pdf", "github_url", "conf_info")


@query("authors_map", sql="""
SELECT conv_id, turn, to_json(map_from_entries(list_transform(string_split(text, ','),
       lambda x, i: struct_pack(k := (i - 1) || '_' || trim(x), v := trim(x)))))::VARCHAR AS authors
FROM conversations
""")
def authors_map(spark, sf_dir):
    """AGG12: the comma-separated children of a row re-nested into one ordered
    ``{"i_name": name}`` object, inside the row (no grouping, any number of children)."""
    c = read_table(spark, sf_dir, "conversations")
    names = F.transform(tx.split_authors("text"), lambda a: F.struct(a["key"].alias("k"), a["name"].alias("v")))
    return c.select("conv_id", "turn", F.to_json(F.map_from_entries(names)).alias("authors"))


@query("row_to_json", sql="""
SELECT event_id, json_object('event_id', event_id, 'ts', strftime(ts, '%m-%d-%Y-%H-%M-%S'), 'user_id', user_id,
       'event_type', event_type, 'value', value, 'props', props)::VARCHAR AS doc FROM events
""")
def row_to_json(spark, sf_dir):
    """SNK3: rows as JSON objects, timestamps in the saved format, NULLs kept."""
    e = sinks.format_timestamps(read_table(spark, sf_dir, "events"))
    return e.select("event_id", sinks.to_json_row(["event_id", "ts", "user_id", "event_type", "value", "props"])
                    .alias("doc"))


@query("papers_to_json", sql=f"SELECT dataset, paper_key, title, md5(abstract) AS abstract_md5, n_chars FROM {PAPERS}")
def papers_to_json(spark, sf_dir):
    """SNK1 round trip: papers written as JSON lines partitioned by dataset, read back."""
    p = papers(spark, sf_dir).select("dataset", "paper_key", "title", "abstract", "n_chars")
    path = sinks.scratch_path(spark, "papers")
    sinks.write_papers(p, path)
    back = spark.read.schema("paper_key long, title string, abstract string, n_chars long, dataset string").json(path)
    return back.select("dataset", "paper_key", "title", F.md5("abstract").alias("abstract_md5"), "n_chars")


@query("json_or_text", sql="""
SELECT event_id, CASE WHEN json_valid(props) THEN json(props)::VARCHAR ELSE props END AS doc FROM events
""")
def json_or_text(spark, sf_dir):
    """JSN2: compact JSON when the value parses, raw text otherwise."""
    return read_table(spark, sf_dir, "events").select("event_id", js.json_or_text("props").alias("doc"))


@query("flatten_json", sql="""
SELECT event_id, '$.' || k AS path, props ->> k AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
""")
def flatten_json(spark, sf_dir):
    """JSN1: a JSON document flattened to (path, value) rows."""
    e = read_table(spark, sf_dir, "events")
    return js.flatten_json_tree(e, "props", keep=["event_id"])


DEPTH = 12  # levels around each document of the nested form


@query("flatten_json_deep", sql=f"""
SELECT event_id, '$' || '.k' || '{".k".join(str(i) for i in range(1, DEPTH + 1))}' || '[' || p || '].' || k AS path, props ->> k AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events), (SELECT unnest([0, 1]) AS p)
""")
def flatten_json_deep(spark, sf_dir):
    """JSN1 on deep documents: two copies of each document in a list under ``DEPTH`` objects."""
    head = "".join(f'{{"k{i}":' for i in range(1, DEPTH + 1))
    e = read_table(spark, sf_dir, "events").select("event_id", F.concat(
        F.lit(head + "["), "props", F.lit(","), "props", F.lit("]" + "}" * DEPTH)).alias("doc"))
    return js.flatten_json_tree(e, "doc", keep=["event_id"])


@query("retype_json", sql="""
SELECT event_id, k AS key,
  CASE WHEN json_type(v::JSON) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN json_type(v::JSON) = 'VARCHAR' THEN 'string'
       ELSE lower(json_type(v::JSON)) END AS kind, TRY_CAST(v AS BIGINT) AS num
FROM (SELECT event_id, k, props ->> k AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events))
""")
def retype_json(spark, sf_dir):
    """TXT6: string values that parse as JSON take the parsed type."""
    e = read_table(spark, sf_dir, "events")
    kv = e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    r = js.retype("v")
    return kv.select("event_id", "key", js.json_kind(r).alias("kind"),
                     F.try_variant_get(r, "$", "bigint").alias("num"))


@query("map_update", sql="""
SELECT event_id, user_id AS k, user_id AS uid, CAST(len(list_distinct(list_concat(json_keys(props), ['k', 'uid']))) AS INTEGER) AS size
FROM events
""")
def map_update(spark, sf_dir):
    """MAP1: ``paper.update(**extras)`` on maps; the right value wins."""
    e = read_table(spark, sf_dir, "events")
    m = js.map_update(F.from_json("props", "map<string,bigint>"),
                      F.create_map(F.lit("k"), F.col("user_id")), F.create_map(F.lit("uid"), F.col("user_id")))
    return e.select("event_id", m.alias("m")).select(
        "event_id", F.col("m")["k"].alias("k"), F.col("m")["uid"].alias("uid"), F.size("m").alias("size"))
