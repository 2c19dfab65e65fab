"""Large JSON objects read by many tasks against the whole-text reader, and written in parts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.sources import objects
from lectern.sources.papers import read_dataset_objects


@pytest.fixture()
def many_splits(spark):
    """Files are cut every few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _object(seed, n):
    r = random.Random(seed)
    odd = ['a "quoted" } brace', "back\\slash\\", "comma, colon: [x]", "é日本 𝄞", "", "tab\tnew\nline", '\\"', "}" * 5, "{" * 5, '",', "x" * 2000]
    papers = {}
    for i in range(n):
        papers[f"{i}_{r.choice(odd)}"] = {"title": r.choice(odd) + str(i), "authors": {f"{j}_{r.choice(odd)}": r.choice(odd) for j in range(r.randrange(4))},
                                          "n": r.choice([1, 2.5, None, True]), "keywords": [r.choice(odd) for _ in range(r.randrange(3))], "nested": [{"a": [{}]}]}
    return papers


def _rows(df):
    """Per dataset: keys and parsed values in order."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.dataset, r.pos)):
        out.setdefault(r.dataset, []).append((r.paper_key, json.loads(r.paper_json)))
    return out


def test_equals_the_whole_text_reader(spark, tmp_path, many_splits):
    texts = {"2020_A": json.dumps(_object(1, 40)), "2021_B": json.dumps(_object(2, 25), indent=2, ensure_ascii=False), "2022_C": "{}",
             "2023_D": ' \n {"only": {"x": "}"}}\n\n', "2024_E": json.dumps(_object(3, 30), separators=(",", ":"))}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    got = objects.read_large_objects(spark, str(tmp_path))
    want = read_dataset_objects(spark, str(tmp_path))
    assert _rows(got) == _rows(want) == {n: [*json.loads(t).items()] for n, t in texts.items() if n != "2022_C"}
    assert sorted((r.dataset, r.pos, r.paper_key) for r in got.collect()) == sorted((r.dataset, r.pos, r.paper_key) for r in want.collect())
    raw = spark.read.text(str(tmp_path / "2020_A.json"), lineSep="}")
    assert raw.rdd.getNumPartitions() > 20  # one file, many tasks


def test_repeated_keys_and_odd_files(spark, tmp_path, many_splits):
    filler = ", ".join(f'"k{i}": {{"t": "{"y" * 100}"}}' for i in range(30))
    texts = {"twice": f'{{"a": {{"v": 1}}, {filler}, "a": {{"v": 2}}, "b": {{"v": 3}}, "a": {{"v": 4}}}}', "list": "[{\"a\": 1}]", "open": '{"a": {"b": 1}, "c": {',
             "after": '{"a": {"x": 1}} {"b": {"x": 2}}' + " " * 2000 + '{"c": {"x": 3}}', "words": "no json { } at all", "empty": "",
             "scalar": '{"a": 1, "b": "x}", "c": [1, {"d": 2}], "e": null}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {}
    for r in sorted(objects.read_large_objects(spark, str(tmp_path)).collect(), key=lambda r: (r.dataset, r.pos)):
        got.setdefault(r.dataset, []).append((r.paper_key, r.paper_json))
    assert set(got) == {"twice", "after", "scalar"}
    assert got["after"] == [("a", '{"x":1}')] and got["scalar"] == [("a", "1"), ("b", "x}"), ("c", '[1,{"d":2}]'), ("e", None)]
    assert got["twice"][0] == ("a", '{"v":4}') and got["twice"][-1] == ("b", '{"v":3}') and len(got["twice"]) == 32
    whole = read_dataset_objects(spark, str(tmp_path / "twice.json")).orderBy("pos").collect()
    assert [(r.paper_key, r.paper_json) for r in whole] == got["twice"]


@pytest.mark.parametrize("single", [False, True])
def test_round_trip_in_parts(spark, tmp_path, many_splits, single, capsys):
    rows = [(f"d/{d} é", i * 3, f'k"{i}', f"title }} {i}", [f"x{i}", '"'], None if i % 2 else 0.5) for d in range(3) for i in range(60 if d else 1)]
    df = spark.createDataFrame(rows, "dataset string, pos int, paper_key string, title string, keywords array<string>, score double").repartition(4)
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts are not put together: several a dataset
    try:
        objects.write_object_parts(df, path, single_files=single)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert single or len([*(tmp_path / "out").glob("dataset=*/part-*")]) > 3
    want = {}
    for d, _, k, t, w, s in sorted(rows):
        want.setdefault(d, []).append((k, {"title": t, "keywords": w, "score": s}))
    assert _rows(objects.read_large_objects(spark, path, in_parts=True)) == want
    for folder in (tmp_path / "out").glob("dataset=*"):
        parts = sorted(folder.glob("part-*"))
        whole = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))  # the parts are one object
        assert [*whole.items()] in want.values() and (len(parts) == 1 or not single)


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "dataset string, pos int, paper_key string, title string")
    objects.write_object_parts(df, str(tmp_path / "none"))
    (tmp_path / "x.json").write_text("{}")
    assert objects.read_large_objects(spark, str(tmp_path / "x.json")).count() == 0


def test_scan_is_the_same_in_pieces():
    text = json.dumps(_object(4, 5))
    whole = objects.scan(text, False)
    assert whole == (False, 0, 0)
    for at in [i + 1 for i, c in enumerate(text) if c == "}"]:
        a = objects.scan(text[:at], False)
        b = objects.scan(text[at:], a[0])
        assert (b[0], a[1] + b[1]) == (False, 0)
