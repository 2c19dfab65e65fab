"""Searches over a persisted index against direct ones, and saved searches as datasets."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import index
from lectern.operators.search import search, search_many
from lectern.sources import saved

COLUMNS = ["dataset", "paper_key", "title", "metric_match", "metric_thres", "conference"]


def _papers(spark, seed=1, n=1200, datasets=4):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        size = r.choice([0, 3, 8, 40, 200])
        text = " ".join(vocab[int(r.expovariate(0.02)) % 400] for _ in range(size))
        rows.append((f"d{i % datasets if i % 3 else 0}", i, f"title {i}", None if i % 97 == 0 else text, f"t{i % 5}"))
    rows.append((None, n, "no dataset", "word3 word5", "t"))
    rows += [("copies", n + 1 + i, "copy", "word3 word7 word7 word9", "t") for i in range(300)]
    return spark.createDataFrame(rows, "dataset string, paper_key long, title string, abstract string, topic string").repartition(3)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    papers = _papers(spark)
    path = str(tmp_path_factory.mktemp("index") / "abstracts")
    index.build_index(papers, path, "abstract", block=16, buckets=8)
    return papers, path


def _same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("query,limit,threshold", [("word3 word7", 5, 0.05), ("word3 word3 word11 the", 3, 0.3), ("word9", 1000, 0.01),
                                                   ("nothing", 5, 0.1), ("of the and", 5, 0.1), ("word3 word7 word9", 2, 0.6)])
def test_index_gives_the_hits_of_a_direct_search(spark, indexed, query, limit, threshold):
    papers, path = indexed
    want = search(papers, query, "Cosine", "abstract", limit, threshold).select(COLUMNS)
    assert _same(index.search_index(spark, path, query, limit, threshold).select(COLUMNS), want)


def test_index_with_several_queries(spark, indexed):
    papers, path = indexed
    said = ["word3 word7", "word11 word3", "of the"]
    cols = ["run", "dataset", "paper_key", "metric_match"]
    want = search_many(papers, said, "abstract", 4, 0.05).select(cols)
    assert _same(index.search_index(spark, path, said, 4, 0.05).select(cols), want)


def test_skipped_blocks_hold_no_hit(spark, indexed):
    papers, path = indexed
    blocks = index.read_blocks(spark, path, "word3 word7", 2, 0.05, first=1).collect()
    skipped = {(b.dataset, b.block) for b in blocks if not b.kept}
    assert len(skipped) > len(blocks) / 8  # there is something to skip
    hits = search(papers, "word3 word7", "Cosine", "abstract", 2, 0.05).select("dataset", "paper_key", "metric_match").collect()
    lists = spark.read.parquet(f"{path}/postings").where(F.col("term").isin("word3", "word7"))
    of = {}
    for r in lists.select("dataset", "block", F.explode("docs.paper_key").alias("k")).collect():
        of.setdefault((r.dataset, r.k), set()).add(r.block)
    assert hits and all((h.dataset, b) not in skipped for h in hits for b in of[h.dataset, h.paper_key])
    # A bound is no less than the score of any document of its block.
    every = search(papers, "word3 word7", "Cosine", "abstract", 10**6, 0.05).collect()
    bound = {(b.dataset, b.block): b.bound for b in blocks}
    assert all(bound[h.dataset, b] >= h.metric_match - 1e-4 for h in every for b in of[h.dataset, h.paper_key])


def test_a_search_reads_the_folders_of_its_terms_only(spark, indexed, capsys):
    _, path = indexed
    index.search_index(spark, path, "word3", 5, 0.1).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:200]
    assert "PushedFilters: [IsNotNull(term)" in plan or "EqualTo(term,word3)" in plan or "In(term, [word3])" in plan
    assert "CartesianProduct" not in plan
    # Bounds come from the peaks alone.
    search_ = index._Search(spark, path, ["word3"], 0.1)
    search_.bounds().explain("formatted")
    read = capsys.readouterr().out
    assert "peak" in read and "docs" not in read.split("ReadSchema")[1].split("\n")[0]


def test_index_can_be_added_to(spark, tmp_path):
    papers = _papers(spark, seed=2, n=300)
    more = papers.where("dataset = 'd1'").withColumn("dataset", F.lit("new"))
    path = str(tmp_path / "grown")
    index.build_index(papers, path, block=16, buckets=4, stopwords=["word5"])
    index.build_index(more, path, mode="append")
    both = papers.unionByName(more)
    want = search(both, "word3 word5", "Cosine", "abstract", 4, 0.1, stopwords=["word5"]).select(COLUMNS)
    assert _same(index.search_index(spark, path, "word3 word5", 4, 0.1).select(COLUMNS), want)


def test_index_keeps_file_order_for_ties(spark, tmp_path):
    rows = [("d", f"k{9 - i}", i, "t", "same words here") for i in range(6)]
    papers = spark.createDataFrame(rows, "dataset string, paper_key string, pos int, title string, abstract string")
    path = str(tmp_path / "pos")
    index.build_index(papers, path)
    got = index.search_index(spark, path, "words", 3, 0.1)
    assert sorted(r.paper_key for r in got.collect()) == ["k7", "k8", "k9"]


def test_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    index.build_index(_papers(spark, seed=5, n=3).limit(0), path)
    assert index.search_index(spark, path, "word3", 3, 0.1).count() == 0


def test_index_wants_a_positive_threshold(spark, indexed):
    with pytest.raises(ValueError):
        index.search_index(spark, indexed[1], "word3", 5, 0.0)


def test_saved_search_is_a_dataset(spark, tmp_path):
    papers = _papers(spark, seed=3, n=300)
    folder = str(tmp_path / "searches")
    hits = search(papers, "word3 word7", "Cosine", "abstract", 3, 0.05)
    other = search(papers, "word9", "Cosine", "title", 3, 0.05)
    saved.save_as_dataset(hits, folder, "Cosine", "abstract", "word3  Word7")
    saved.save_as_dataset(other, folder, "Cosine", "title", "a/b =c%d é")
    names = {r.dataset for r in saved.registry(spark, folder).collect()}
    assert "cosine_abstract_word3-word7" in {n.lower() for n in names} or "cosine_abstract_word3-Word7" in names
    # Saving again replaces that search alone.
    fewer = search(papers, "word3 word7", "Cosine", "abstract", 1, 0.05)
    saved.save_as_dataset(fewer, folder, "Cosine", "abstract", "word3  Word7")
    assert {r.dataset for r in saved.registry(spark, folder).collect()} == names
    back = saved.saved_papers(spark, folder, f"paper_key long, title string, {saved.METRICS}")
    want = fewer.select("paper_key", "title", "metric_match", "metric_thres", "conference")
    assert sorted(map(str, back.drop("dataset").collect())) == sorted(map(str, want.collect()))
    both = saved.with_saved(papers, folder)
    assert both.columns == papers.columns and both.count() == papers.count() + fewer.count()
    again = search(both, "word7", "Cosine", "abstract", 2, 0.05).where(F.col("dataset").startswith("cosine")).collect()
    assert again and all(r.conference == r.dataset for r in again)


def test_saved_search_without_hits(spark, tmp_path):
    papers = _papers(spark, seed=4, n=50)
    folder = str(tmp_path / "searches")
    saved.save_as_dataset(search(papers, "word3", "Cosine", "abstract", 3, 0.05), folder, "Cosine", "abstract", "word3")
    saved.save_as_dataset(search(papers, "unheard", "Cosine", "abstract", 3, 0.05), folder, "Cosine", "abstract", "unheard")
    assert saved.saved_papers(spark, folder, "paper_key long").select("dataset").distinct().count() == 1


def test_blocks_in_many_tasks(spark, tmp_path, monkeypatch):
    """Documents are shuffled by block, whole, into tasks of a bounded number of entries."""
    monkeypatch.setattr(index, "ENTRIES", 100)
    papers = _papers(spark, seed=6, n=200)
    path = str(tmp_path / "tasks")
    index.build_index(papers, path, block=16, buckets=4)
    want = search(papers, "word3 word5", "Cosine", "abstract", 4, 0.1).select(COLUMNS)
    assert _same(index.search_index(spark, path, "word3 word5", 4, 0.1).select(COLUMNS), want)
