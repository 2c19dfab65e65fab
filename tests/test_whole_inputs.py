"""Depth, length and shape of the input set no limit."""

import random

from pyspark.sql import functions as F

from lectern.functions import fuzzy, jsonfn
from lectern.operators import semantic
from lectern.sources import feeds
from lectern.sources.papers import read_table
from lectern.streaming import ingest


def test_json_depth_counts_brackets_outside_strings(spark):
    docs = ['{"a":[1,{"b":"]]}}"}]}', '"x"', '[]', None, r'{"q":"\"{[["}']
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    assert [r[0] for r in df.select(jsonfn.json_depth("d")).collect()] == [3, 0, 1, 0, 1]


def test_flatten_reaches_any_depth(spark):
    deep = '{"a":' * 15 + '[7,{"z":null}]' + "}" * 15
    df = spark.createDataFrame([(1, deep), (2, '{"s":"t"}'), (3, None)], "id int, d string")
    rows = {(r.id, r.path): r.value for r in jsonfn.flatten_json_tree(df, "d", ["id"]).collect()}
    assert rows[(1, "$" + ".a" * 15 + "[0]")] == "7"
    assert (1, "$" + ".a" * 15 + "[1].z") in rows
    assert rows[(2, "$.s")] == "t"


def test_escapes_in_strings_hide_no_depth(spark):
    docs = [(r'{"a":"x\ny","b":{"c":{"d":1}}}', 3, "$.b.c.d", "1"), (r'{"t":"l1\nl2","m":{"u":{"v":[1,2]}}}', 4, "$.m.u.v[1]", "2"),
            (r'{"a":"q\"{[","b":{"c":[{"d":2}]}}', 4, "$.b.c[0].d", "2"), (r'{"a":"end\\","b":{"c":{"d":3}}}', 3, "$.b.c.d", "3"),
            (r'{"a":"\u00e9\\\"}","b":[[["z"]]]}', 4, "$.b[0][0][0]", "z")]
    for i, (doc, depth, path, value) in enumerate(docs):  # each alone: none is the deepest of others
        df = spark.createDataFrame([(i, doc)], "id int, d string")
        assert df.select(jsonfn.json_depth("d")).first()[0] == depth, doc
        rows = {r.path: r.value for r in jsonfn.flatten_json_tree(df, "d", ["id"]).collect()}
        assert rows[path] == value and len(rows) == 2 + ("[1]" in path), doc


def test_lcs_equals_the_table():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == table(a, b)


def test_page_parser_takes_broken_markup():
    page = feeds.parse_page('<span class="authors">Ann, Bo</span><span class="authors">Cy</span></p>'
                            '<div id="info">X<br>Y</p>Z</div><ul><li><a href="u">Software</a>'
                            '<li><a href="v">Download PDF</a></ul><div id="info">no</div>')
    assert list(page["authors"].values()) == ["Ann", "Bo"]
    assert page["conf_info"] == "XYZ"
    assert (page["github_url"], page["pmlr_pdf"]) == ("u", "v")


def test_centroid_of_a_null_label(spark):
    df = spark.createDataFrame([(1, None, [1.0, 0.0]), (2, "a", [0.0, 1.0])], "id int, label string, v array<double>")
    rows = semantic.cosine_to_centroid(df, "label", "v").collect()
    assert sorted((r.id, round(r.score, 6)) for r in rows) == [(1, 1.0), (2, 1.0)]


def test_word_vectors_are_averaged_by_count(spark):
    papers = spark.createDataFrame([(1, "red red blue"), (2, "green"), (3, None)], "k int, t string")
    vectors = spark.createDataFrame([("red", [1.0, 0.0]), ("blue", [0.0, 1.0])], "term string, vector array<double>")
    rows = semantic.word_vector_scores(papers, vectors, "red", "t", ["k"]).collect()
    assert [(r.k, round(r.score, 6)) for r in rows] == [(1, round(2 / 5 ** 0.5, 6))]


def test_read_partitions_only_when_asked(spark, tmp_path):
    spark.range(100).repartition(1).write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 1
    spark.conf.set("lectern.read.partitions", "5")
    try:
        assert read_table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("lectern.read.partitions")


def test_stream_reads_a_folder_of_parts(spark, tmp_path):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"),
                                  F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    from lectern.plans.q_stream import stream_ingest
    assert stream_ingest(spark, str(tmp_path)).count() == 20


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "causal learning", "en", "s", 15)], ingest.DOCUMENT_SCHEMA)
    docs.write.parquet(str(tmp_path / "in"))
    for turn in ("a", "b"):  # the second run has lost its checkpoint and sees batch 0 again
        ingest.search_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / turn),
                             "causal learning", threshold=0.1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
