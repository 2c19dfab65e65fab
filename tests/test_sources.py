import json
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.sources import feeds, sinks
from lectern.sources.papers import read_dataset_objects, read_datasets

FEED_PAPERS = {
    "0_Graph Learning": {"title": "Graph Learning", "abstract": "About graphs.", "url": "https://x.org/v1/a1.html",
                         "id": "https://x.org/v1/a1.html", "pdf": "https://x.org/v1/a1/a1.pdf",
                         "authors": {"0_Ann Lee": "Ann Lee", "1_Bo Chen": "Bo Chen"}, "pmlr_pdf": "",
                         "github_url": "", "conf_info": "Proc v1 2023", "supplemental": ""},
    "1_Title with  = {braces}": {"title": "Title with = {braces} \"q\"", "abstract": None, "url": "u", "id": "u",
                                 "pdf": "p", "authors": {}, "pmlr_pdf": "", "github_url": "",
                                 "conf_info": "", "supplemental": ""},
}
API_PAPERS = {
    "0_Deep Nets": {"id": "9", "name": "Deep Nets", "author": {"0_Ann Lee": {"fullname": "Ann Lee", "institution": "MIT"}},
                    "abstract": "Nets.", "keywords": ["nets", "deep"], "topic": "ML", "session": "", "event_type": "",
                    "virtualsite_url": "", "url": "", "paper_url": "", "paper_pdf_url": "", "sourceurl": ""},
}


def _write(path, obj):
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj), encoding="utf-8")
    return str(path)


def test_read_datasets_keeps_file_order_and_names(spark, tmp_path):
    a = _write(tmp_path / "2023_AAAI.json", FEED_PAPERS)
    b = _write(tmp_path / "2024_ICML.json", API_PAPERS)
    rows = read_datasets(spark, [a, b]).orderBy("dataset", "pos").collect()
    assert [(r.dataset, r.pos, r.paper_key) for r in rows] == [
        ("2023_AAAI", 0, "0_Graph Learning"), ("2023_AAAI", 1, "1_Title with  = {braces}"),
        ("2024_ICML", 0, "0_Deep Nets")]
    assert rows[0].authors[1].name == "Bo Chen"
    assert rows[2].title == "Deep Nets" and rows[2].authors[0].institution == "MIT"
    assert rows[1].abstract is None


def test_duplicate_keys_last_wins(spark, tmp_path):
    p = _write(tmp_path / "2023_COLT.json", '{"k": {"title": "first"}, "j": {"title": "x"}, "k": {"title": "second"}}')
    rows = read_dataset_objects(spark, p).collect()
    got = {r.paper_key: json.loads(r.paper_json)["title"] for r in rows}
    assert got == {"k": "second", "j": "x"}


def test_feed_xml_to_papers(spark, tmp_path):
    xml = ("<rss><channel>"
           "<item><title>A &amp; B: tests!</title><description>Abs one</description>"
           "<link>https://proceedings.mlr.press/v208/zecevic23a.html</link><guid>g1</guid></item>"
           "<item><title>Second</title><description>Abs two</description><link>https://h/p/q.html</link><guid>g2</guid></item>"
           "</channel></rss>")
    p = _write(tmp_path / "2023_CHIL.xml", xml)
    rows = feeds.read_feeds(spark, p).orderBy("pos").collect()
    assert [r.paper_key for r in rows] == ["0_A  B tests", "1_Second"]
    assert rows[0].pdf == "https://proceedings.mlr.press/v208/zecevic23a/zecevic23a.pdf"
    assert rows[0].abstract == "Abs one" and rows[0].feed == "2023_CHIL"


def test_feed_index(spark):
    items = spark.createDataFrame([
        (0, "Proceedings of AAAI 2019 and 2023", "l0"),
        (1, "COLT 2009 workshop", "l1"),
        (2, "AAAI 2019 again", "l2"),
        (3, "Nothing here 2020", "l3"),
        (4, "ML4H and CHIL 2022", "l4"),
    ], "pos long, description string, link string")
    got = {(r.year, r.conference): r.link for r in
           feeds.feed_index(items, ["COLT", "AAAI", "CHIL", "ML4H"], 2010).collect()}
    assert got == {(2019, "AAAI"): "l2", (2022, "CHIL"): "l4", (2022, "ML4H"): "l4"}


@pytest.mark.parametrize("most", [feeds.REGISTRY_BYTES, 12])
def test_feed_index_with_a_registry_table(spark, most):
    """Against ``contains``, also when the names are taken in several groups; names inside of names, odd and repeated ones."""
    names = ["AAAI", "AAA", "A", "COLT", "é日", "a.b*c", "", None, "AAAI", "x y", "zz"]
    said = [(i, t, f"l{i}") for i, t in enumerate(["AAAI 2019", "COLT and AAA in 2012, x y", None, "", "no year AAAI", "a.b*c é日 2031 2009", "aaai 2020",
                                                   "AAAAAI 1999 2020", "x  y zz 2020", "AAAI 2019 again"])]
    items = spark.createDataFrame(said, "pos long, description string, link string").repartition(3)
    registry = spark.createDataFrame([(n, 1) for n in names], "name string, pos int")
    got = {(r.year, r.conference): r.link for r in feeds.feed_index_from(items, registry, year_limit=2010, most=most).collect()}
    want = {}
    for i, text, link in said:
        year = re.search(r"\b(19[0-9]{2}|20[0-9]{2}|2100)\b", text or "")
        if year and int(year[1]) >= 2010:
            want |= {(int(year[1]), n): link for n in names if n and n in text}
    assert got == want and len(want) > 6
    assert feeds.feed_index_from(items, registry.limit(0)).count() == 0


def test_api_payload(spark):
    payload = {"count": 2, "results": [
        {"id": 1, "name": "Deep Nets", "authors": [{"fullname": "Ann", "institution": "MIT"},
                                                   {"fullname": "Bo", "institution": None}],
         "abstract": "A", "keywords": ["x"], "topic": "ML", "virtualsite_url": "/virtual/1"},
        {"id": 2, "name": "Second", "authors": [], "abstract": None, "keywords": None, "topic": ""}]}
    df = spark.createDataFrame([(json.dumps(payload), "https://conf.org/api/2023")], "payload string, url string")
    out = feeds.api_papers(df)
    rows = out.withColumn("akeys", F.map_keys("author")).orderBy("pos").collect()
    assert [r.paper_key for r in rows] == ["0_Deep Nets", "1_Second"]
    assert rows[0].akeys == ["0_Ann", "1_Bo"] and rows[1].akeys == []
    assert rows[0].virtualsite_url == "https://conf.org/virtual/1"
    assert rows[1].abstract == "" and rows[1].virtualsite_url == "" and rows[0].id == "1"


PAGE = ("<html><body><span class=\"authors\">Ann Lee, Bo Chen ,Cy</span>"
        "<ul><li><a href=\"https://gh/x\">Software</a></li><li><a href=\"/p.pdf\">Download PDF</a></li>"
        "<li><a href=\"/s.zip\">Supplementary PDF</a></li><li><a href=\"/o\">Other</a></li></ul>"
        "<div id=\"info\"> Proc 2023 </div></body></html>")


def test_parse_pages_parser_form(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<html><p>plain</p></html>"), (3, None)], "page_id long, html string")
    rows = {r.page_id: r for r in feeds.parse_pages(df).collect()}
    assert rows[1].authors == {"0_Ann Lee": "Ann Lee", "1_Bo Chen": "Bo Chen", "2_Cy": "Cy"}
    assert (rows[1].github_url, rows[1].pmlr_pdf, rows[1].supplemental) == ("https://gh/x", "/p.pdf", "/s.zip")
    assert rows[1].conf_info == "Proc 2023"
    assert rows[2].authors == {} and rows[2].github_url == "" and rows[3].conf_info == ""


def test_bad_markup_does_not_end_the_extract():
    for bad in ("<![foo[bar]]>", "<![CDATA[x]]>", "<![if !IE]>", "<!x", "<?php 1 ?>", "</", "<b><i></u>"):
        found = feeds.parse_page("<div>" + bad + ">" + PAGE)
        assert found["pmlr_pdf"] == "/p.pdf" and found["conf_info"] == "Proc 2023", bad
    for bad in ("<![", "<!--", "<a href='", "&#99999999;", "<!DOCTYPE"):
        assert feeds.parse_page(PAGE + bad)["github_url"] == "https://gh/x", bad


def test_extract_is_linear_in_the_page():
    began = time.process_time()
    for part in ("<div>some text ", "<li>some text ", "<b><p>", "<ul><li>", "</u>", "<p><div></b>"):
        assert feeds.parse_page(PAGE + part * 50_000)["conf_info"] == "Proc 2023"
    assert time.process_time() - began < 30


def test_extract_keeps_the_key(spark):
    df = spark.createDataFrame([("a-1", PAGE)], "paper_url string, body string")
    out = feeds.parse_pages(df, "body", "paper_url")
    assert out.columns[0] == "paper_url" and out.first().paper_url == "a-1"


def test_page_regex_forms(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>x</p>")], "page_id long, html string")
    links = {r.page_id: r for r in feeds.page_links(df).collect()}
    assert links[1].pmlr_pdf == "/p.pdf" and links[1].supplemental == "/s.zip" and links[2].github_url == ""
    parts = {r.page_id: r for r in feeds.page_parts(df).collect()}
    assert [a.name for a in parts[1].authors] == ["Ann Lee", "Bo Chen", "Cy"] and parts[1].conf_info == "Proc 2023"


def test_sink_round_trip(spark, tmp_path):
    a = _write(tmp_path / "in" / "2023_AAAI.json", FEED_PAPERS) if (tmp_path / "in").mkdir() is None else None
    src = read_datasets(spark, a).select("dataset", "pos", "paper_key", "title", "abstract")
    out = str(tmp_path / "out")
    sinks.write_dataset_objects(src, out)
    back = read_datasets(spark, f"{out}/dataset=2023_AAAI/*.txt").select("pos", "paper_key", "title", "abstract")
    assert sorted(back.collect()) == sorted(src.drop("dataset").collect())


def test_json_lines_sink(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1, "t", None)], "dataset string, paper_key long, title string, abstract string")
    out = str(tmp_path / "jl")
    sinks.write_papers(df, out)
    back = spark.read.schema("paper_key long, title string, abstract string, dataset string").json(out)
    assert back.collect()[0].asDict() == {"paper_key": 1, "title": "t", "abstract": None, "dataset": "d1"}


def test_catalog_and_stopwords(spark, tmp_path):
    from lectern.sources.catalog import catalog_folders, folder_sizes, read_stopwords
    a, b = tmp_path / "conferences", tmp_path / "searches"
    a.mkdir(), b.mkdir()
    _write(a / "2023_ICML.json", "x" * 2048)
    _write(a / "2022_aaai.json", "{}")
    _write(a / ".hidden.json", "{}")
    _write(b / "cosine_title_x.json", "{}")
    rows = catalog_folders(spark, [str(a), str(b)]).orderBy("idx").collect()
    assert [(r.idx, r.stem, r.size, r["class"]) for r in rows] == [
        (0, "2022_aaai", " 2.0 B", "other"), (1, "2023_ICML", " 2.0 KB", "main"), (2, "cosine_title_x", " 2.0 B", "other")]
    sizes = {r.folder: r.bytes for r in folder_sizes(spark, [str(a)]).collect()}
    assert sizes == {str(a): 2048 + 2}  # hidden files are not listed by Spark
    _write(tmp_path / "sw.txt", "the\nof\nthe\n\nand\n")
    assert sorted(r.word for r in read_stopwords(spark, str(tmp_path / "sw.txt")).collect()) == ["and", "of", "the"]


def test_save_search(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, 0.5)], "dataset string, paper_key long, metric_match double")
    path = sinks.save_search(df, str(tmp_path), "Cosine", "abstract", "Causal  effect")
    assert path.endswith("/cosine_abstract_causal-effect")
    assert spark.read.json(path).count() == 1


def test_flatten_json_tree(spark):
    from lectern.functions.jsonfn import flatten_json_tree
    doc = '{"a": {"b": [1, {"c": "x"}]}, "d": null, "e": "2023", "f": {}, "g": [], "h": true}'
    df = spark.createDataFrame([(1, doc), (2, "not json")], "id long, j string")
    got = {(r.id, r.path): r.value for r in flatten_json_tree(df, "j", keep=["id"]).collect()}
    assert got == {(1, "$.a.b[0]"): "1", (1, "$.a.b[1].c"): "x", (1, "$.d"): None, (1, "$.e"): "2023",
                   (1, "$.f"): "{}", (1, "$.g"): "[]", (1, "$.h"): "true", (2, "$"): "not json"}


def test_clean_string_values_and_retype(spark):
    from lectern.functions.jsonfn import clean_string_values, json_kind, retype_strings
    df = spark.createDataFrame([("a\\r\\nb", {"k": 'say \\"hi\\"'}, ["x\\r\\ny"], "2023")],
                               "t string, m map<string,string>, l array<string>, y string")
    r = clean_string_values(df).first()
    assert (r.t, r.m["k"], r.l[0], r.y) == ("ab", 'say "hi"', "xy", "2023")
    kinds = retype_strings(df, ["y", "t"]).select(json_kind(F.col("y_value")), json_kind(F.col("t_value"))).first()
    assert tuple(kinds) == ("number", None)


def test_search_over_dataset_files(spark, tmp_path):
    from lectern.operators.search import search
    papers_a = {"0_Zeta": {"title": "Graph causal", "abstract": "x"},
                "1_Alpha": {"title": "Graph causal", "abstract": "y"},
                "2_Other": {"title": "Unrelated words", "abstract": "z"}}
    a = _write(tmp_path / "2023_COLT.json", papers_a)
    b = _write(tmp_path / "2024_ICML.json", API_PAPERS)
    p = read_datasets(spark, [a, b])
    res = search(p, "graph causal", "Cosine", "title", 1, 0.5).collect()
    # equal scores: the first paper in file order wins, not the smaller key
    assert [(r.dataset, r.paper_key) for r in res] == [("2023_COLT", "0_Zeta")]
    res2 = search(p, "deep nets", "Cosine", "title", 5, 0.5).collect()
    assert [(r.dataset, r.paper_key, r.metric_match) for r in res2] == [("2024_ICML", "0_Deep Nets", 1.0)]


def test_files_of_several_lines_are_read_whole(spark, tmp_path):
    """Pretty-printed dataset files and feeds."""
    papers = {"0_A": {"title": "A", "abstract": "x"}, "1_B": {"title": "B", "abstract": "line\nbreak"}}
    (tmp_path / "2023_AAAI.json").write_text(json.dumps(papers, indent=2))
    rows = read_datasets(spark, str(tmp_path / "2023_AAAI.json")).orderBy("pos").collect()
    assert [(r.pos, r.paper_key, r.title, r.abstract) for r in rows] == [(0, "0_A", "A", "x"), (1, "1_B", "B", "line\nbreak")]
    (tmp_path / "feed.xml").write_text("<rss>\n<channel>\n<item>\n<title>T</title>\n<description>d</description>\n"
                                       "<link>l</link>\n<guid>g</guid>\n</item>\n</channel>\n</rss>\n")
    items = feeds.read_feeds(spark, str(tmp_path / "feed.xml")).collect()
    assert [r.title for r in items] == ["T"]
