"""Learned word vectors against dense numpy on a small corpus."""

import pathlib
import random
import time
import urllib.parse
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.operators import semantic
from lectern.operators import wordvectors as wv


def _texts(seed=1, n=120):
    r = random.Random(seed)
    topics = [[f"{t}{i}" for i in range(8)] for t in ("sea", "sky", "law", "art")]
    return [" ".join(r.choice(r.choice(topics) if r.random() < 0.15 else topics[i % 4]) for _ in range(r.randrange(0, 40))) for i in range(n)]


def _dense(texts, window, least):
    n = Counter()
    for text in texts:
        t = text.split()
        for i, a in enumerate(t):
            for b in t[max(0, i - window):i] + t[i + 1:i + 1 + window]:
                n[a, b] += 1
    own = Counter()
    for (a, _), c in n.items():
        own[a] += c
    terms = sorted((t for t in own if own[t] >= 2 * window * least), key=lambda t: (-own[t], t))
    m = np.array([[n[a, b] for b in terms] for a in terms], dtype=float)
    with np.errstate(divide="ignore"):
        x = np.log(m * m.sum() / np.outer(m.sum(axis=1), m.sum(axis=0)))
    return terms, np.maximum(x, 0)


def test_equals_dense_svd(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "id int, text string").repartition(3)
    got = {r.term: np.array(r.vector) for r in wv.learn(df, F.filter(F.split("text", " "), lambda t: t != ""), dim=6, window=3, least=3).collect()}
    terms, x = _dense(texts, 3, 3)
    assert set(got) == set(terms) and len(terms) > 20
    u, s, _ = np.linalg.svd(x)
    best = (u[:, :6] * s[:6] ** 2) @ u[:, :6].T  # of all vectors the products of each two
    ours = np.array([got[t] for t in terms])
    assert np.abs(ours @ ours.T - best).max() < 1e-3 * np.abs(best).max()
    again = {r.term: np.array(r.vector) for r in wv.learn(df.repartition(2), F.filter(F.split("text", " "), lambda t: t != ""), dim=6, window=3, least=3).collect()}
    assert max(np.abs(again[t] - got[t]).max() for t in terms) < 1e-6
    # Words of one topic lie together.
    unit = {t: v / np.linalg.norm(v) for t, v in got.items()}
    near = np.mean([unit[a] @ unit[b] for a in unit for b in unit if a != b and a[:3] == b[:3]])
    far = np.mean([unit[a] @ unit[b] for a in unit for b in unit if a[:3] != b[:3]])
    assert near > far + 0.3


def test_fewer_contexts_and_search(spark):
    texts = _texts(2)
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "dataset string, paper_key int, abstract string")
    vectors = wv.learn(df, F.split("abstract", " "), dim=5, window=3, least=2, contexts=24)
    assert all(len(r.vector) == 5 for r in vectors.collect())
    scored = semantic.word_vector_scores(df, vectors, "sea1 sea2", "abstract", ["dataset", "paper_key"]).orderBy(F.col("score").desc()).limit(10).collect()
    assert sum(r.paper_key % 4 == 0 for r in scored) >= 8
    unknown = semantic.word_vector_scores(df, vectors, "unheard of", "abstract", ["dataset", "paper_key"]).collect()
    assert unknown and all(r.score is None for r in unknown)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    assert wv.learn(df, F.split("text", " "), dim=4).count() == 0
    with pytest.raises(ValueError):
        wv.learn(df, F.split("text", " "), contexts=0)


def test_a_part_gets_a_vector_once_for_all_its_papers(spark):
    """Before, every (paper, term) carried a vector through the shuffle; repeated and null keys are averaged as one group."""
    seen = []
    rows = [("d", i % 40, "sea sea sky") for i in range(80)] + [(None, None, "sky"), (None, None, "law sea"), ("d", 99, "unheard")]
    df = spark.createDataFrame(rows, "dataset string, paper_key int, abstract string")
    vectors = spark.createDataFrame([("sea", [1.0, 0.0]), ("sky", [0.0, 1.0]), ("law", [1.0, 1.0])], "term string, vector array<float>")
    got = {(r.dataset, r.paper_key): r.score for r in semantic.word_vector_scores(df, vectors, "sea", "abstract", ["dataset", "paper_key"]).collect()}
    assert len(got) == 41 and all(abs(got["d", i] - 2 / 5 ** 0.5) < 1e-9 for i in range(40)) and abs(got[None, None] - 0.5 ** 0.5) < 1e-9
    schema = pa.schema([("part", pa.int32()), ("paper", pa.bool_()), ("term", pa.string()), ("vector", pa.list_(pa.float32())), ("tokens", pa.list_(pa.string())), ("k", pa.int64())])
    lines = [(0, False, "sea", [1.0, 0.0], None, None)] + [(0, True, None, None, ["sea"] * (i + 1), i) for i in range(200)] + [(1, True, None, None, ["sea"], 900)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in lines[at:at + 70]], schema) for at in range(0, len(lines), 70)]
    for part in semantic._weighted(iter(batches)):
        seen += zip(part.column("k").to_pylist(), part.column("_mean").to_pylist(), part.column("_weight").to_pylist())
    assert seen == [(i, [1.0, 0.0], i + 1.0) for i in range(200)]


def test_rare_and_null_tokens_against_counting(spark):
    """Rare terms count for the threshold, not for the shares; columns are only the most frequent terms; nulls are near, and no terms."""
    r = random.Random(5)
    texts = [[*(r.choice(["rare%d" % r.randrange(400), None]) if r.random() < 0.3 else "t%d" % min(int(r.expovariate(0.12)), 39) for _ in range(r.randrange(0, 30)))] for _ in range(150)]
    n = Counter()
    for t in texts:
        for i, a in enumerate(t):
            n.update((a, b) for b in t[max(0, i - 2):i] + t[i + 1:i + 3])
    count = Counter()
    for (a, _), c in n.items():
        count[a] += c
    kept = sorted((a for a in count if a is not None and count[a] >= 2 * 2 * 4), key=lambda a: (-count[a], a))
    assert 15 < len(kept) < 45 and sum(count[a] for a in count if a not in kept) > 1000
    m = np.array([[n[a, b] for b in kept] for a in kept], dtype=float)
    with np.errstate(divide="ignore"):
        x = np.maximum(np.log(m * m.sum() / np.outer(m.sum(axis=1), m.sum(axis=0))), 0)[:, :12]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ([],)], "t array<string>").repartition(4)
    got = {v.term: np.array(v.vector) for v in wv.learn(df, F.col("t"), dim=12, window=2, least=4, contexts=12).collect()}
    assert set(got) == {a for a, row in zip(kept, x) if row.any()}
    ours = np.array([got.get(a, np.zeros(12)) for a in kept])
    assert np.abs(ours @ ours.T - x @ x.T).max() < 1e-6


def test_tasks_pass_lists_not_pairs(spark, monkeypatch):
    """Before, every pair of terms was a row of its own and all pairs were written; now a term has its contexts in lists, and rows of the
    same counts come out however tokens, lists and batches are cut."""
    r = random.Random(6)
    said = [[f"w{min(int(r.expovariate(0.05)), 99):02}" for _ in range(40)] for _ in range(60)]
    names = [f"w{i:02}" for i in range(20)]
    want = Counter((a, b) for t in said for i, a in enumerate(t) for b in t[max(0, i - 3):i] + t[i + 1:i + 4] if b in names)
    shared, others = type("S", (), {"value": np.array(names, dtype=object)}), type("S", (), {"value": np.ones(20)})
    schema = pa.schema([("term", pa.string()), ("own", pa.int64()), ("ids", pa.list_(pa.int32())), ("ns", pa.list_(pa.int64()))])
    monkeypatch.setattr(wv, "GROUP", 7)
    for tokens, most, rows in ((10 ** 6, 256, 5000), (300, 3, 50)):
        monkeypatch.setattr(wv, "TOKENS", tokens)
        monkeypatch.setattr(wv, "LIST", most)
        batches = [pa.RecordBatch.from_arrays([pa.array(said[i:i + 25] + [None], pa.list_(pa.string()))], ["tokens"]) for i in range(0, 60, 25)]
        passed = [x for b in wv._contexts(3, shared)(iter(batches)) for x in b.to_pylist()]
        terms = {t for text in said for t in text}
        assert max(len(x["ids"]) for x in passed) <= most and (len(passed) <= len(terms) if tokens == 10 ** 6 else len(passed) > len(want) / 3)
        lines = sorted(passed + [{"term": t, "own": 1, "ids": None, "ns": None} for t in terms if t != "w05"], key=lambda x: (x["term"], x["own"] is None))
        met = [pa.RecordBatch.from_pylist(lines[i:i + rows], schema) for i in range(0, len(lines), rows)]
        got = [x for b in wv._added(10 ** 6, others)(iter(met)) for x in b.to_pylist()]
        assert len(got) == len({x["term"] for x in got})
        assert {(x["term"], names[i]): n for x in got for i, n in zip(x["ids"], x["ns"])} == {k: n for k, n in want.items() if k[0] != "w05"}
    written = []
    monkeypatch.setattr(wv, "scratch_table", lambda df, name, f=wv.scratch_table: written.append((name, (out := f(df, name)).count())) or out)
    wv.learn(spark.createDataFrame([(t,) for t in said], "t array<string>"), F.col("t"), dim=4, window=3, least=2, contexts=20)
    assert max(n for _, n in written) <= max(len(said), len(terms))


def test_both_ways_to_multiply():
    r = np.random.default_rng(3)
    size = np.array([2, 5, 1, 0, 30])
    row, ids, x, basis = np.repeat(np.arange(5), size), r.integers(0, 3000, size.sum()), r.random(size.sum()), r.random((3000, 4))
    for columns in (3000, 40):  # few entries of the columns, many of them
        at, m = ids % columns, np.zeros((5, columns))
        np.add.at(m, (row, at), x)
        i, j = np.nonzero(m)
        total = np.zeros((columns, 4))
        assert np.allclose(wv._times(np.bincount(i, minlength=5), j, m[i, j], basis[:columns], total), m @ basis[:columns])
        assert np.allclose(total, m.T @ m @ basis[:columns])


def test_each_part_of_papers_is_a_task_of_its_own(spark, monkeypatch):
    """Before, parts were dealt by hash, so several met in one task while others had none."""
    written = []
    monkeypatch.setattr(semantic, "scratch_table", lambda df, name, f=semantic.scratch_table: written.append(df) or f(df, name))
    df = spark.createDataFrame([("d", i, "sea") for i in range(400)], "dataset string, paper_key int, abstract string")
    vectors = spark.createDataFrame([("sea", [1.0])], "term string, vector array<double>")
    assert semantic.word_vector_scores(df, vectors, "sea", "abstract", ["dataset", "paper_key"]).count() == 400
    parts = [r.n for r in written[0].groupBy(F.spark_partition_id()).agg(F.countDistinct("part").alias("n")).collect()]
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and set(parts) == {1}


def test_learning_leaves_only_the_vectors(spark, monkeypatch):
    """Before, all tables and shuffle files of the learning stayed while the papers were scored."""
    written = []
    monkeypatch.setattr(wv, "scratch_table", lambda df, name, f=wv.scratch_table: written.append((name, (out := f(df, name)).inputFiles()[0].rsplit("/", 1)[0])) or out)
    df = spark.createDataFrame([(t,) for t in _texts(3)], "t string")
    vectors = wv.learn(df, F.split("t", " "), dim=4, window=3, least=2)
    there = {name: pathlib.Path(urllib.parse.urlparse(path).path).exists() for name, path in written}
    assert len(there) == 6 and [name for name, x in there.items() if x] == ["vectors-learned"]
    assert vectors.count() == len({r.term for r in vectors.collect()}) > 20


def test_shuffle_files_of_a_write_go_with_it(spark):
    """Before, they stayed until the driver happened to collect its garbage."""
    store = spark.sparkContext._jsc.sc().env().blockManager()
    held = lambda: sum(1 for f in list(store.diskBlockManager().getAllFiles().mkString("\n").split("\n")) if "/shuffle_" in f)
    df = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before = held()
    with session.lean_writes(spark):
        out = session.scratch_table(df, "lean")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before and out.count() == 7 and spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"


def test_terms_whose_places_meet(spark, monkeypatch):
    """Kept and other terms at one place: only then does a rare term travel with its neighbours, and all counts are exact."""
    r = random.Random(9)
    texts = [[r.choice(["rare%d" % r.randrange(300), None]) if r.random() < 0.3 else "t%d" % min(int(r.expovariate(0.12)), 39) for _ in range(r.randrange(0, 30))] for _ in range(150)]
    n = Counter()
    for t in texts:
        for i, a in enumerate(t):
            n.update((a, b) for b in t[max(0, i - 2):i] + t[i + 1:i + 3])
    count = Counter()
    for (a, _), c in n.items():
        count[a] += c
    kept = {a for a in count if a is not None and count[a] >= 16}
    want = {a: (count[a], sum(n[a, b] for b in kept)) for a in kept}
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(5)
    names, lists = {t for text in texts for t in text if t is not None}, {}
    for bits, together in ((26, 1 << 16), (7, 16)):
        places = 1 << bits
        monkeypatch.setattr(wv, "PLACES", places)
        monkeypatch.setattr(wv, "TOGETHER", together)
        batch = pa.RecordBatch.from_arrays([pa.array(sorted(names)), pa.array([count[t] for t in sorted(names)])], ["term", "n"])
        held = np.zeros(places // 4, dtype=np.uint8)
        found = [*wv._bits(iter([pa.RecordBatch.from_arrays(x.columns, ["block", "kept", "other"]) for x in wv._there(16)(iter([batch]))]))]
        for block, some in zip(found[0].column(0).to_pylist(), found[0].column(1).to_pylist()):
            held[block * (together // 4):(block + 1) * (together // 4)] = np.frombuffer(some, dtype=np.uint8)
        got = Counter()
        lists[bits] = 0
        said = pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.string()))], ["tokens"])
        for out in wv._own(2, 16, type("S", (), {"value": held}))(iter([said.slice(0, 70), said.slice(70)])):
            for x in out.to_pylist():
                got[x["term"]] += x["own"]
                lists[bits] += len(x["near"])
                if x["term"] in kept:
                    got.update(x["near"])
        assert {a: (count[a], got[a]) for a in kept} == want
    assert lists[26] <= lists[7] and sum(x for x in count.values()) > 4 * lists[26]
    monkeypatch.undo()
    kept_rows = {x.term: (x.n, x.own) for x in wv.kept_terms(df, 2, 4)[0].collect()}
    assert kept_rows == want


def test_large_counts_as_bytes():
    batch = pa.RecordBatch.from_pylist([{"term": "a", "own": None, "ids": [0, 19999, 3], "ns": [1, 255, 256]}, {"term": "b", "own": None, "ids": [7], "ns": [1000]}],
                                       pa.schema([("term", pa.string()), ("own", pa.int64()), ("ids", pa.list_(pa.int32())), ("ns", pa.list_(pa.int64()))]))
    packed = [*wv._packed(lambda batches: batches)(iter([batch]))]
    assert sum(len(b) for b in packed[0].column("ns").to_pylist()) == 8
    kept = pa.RecordBatch.from_pylist([{"term": "a", "own": 5, "ids": None, "ns": None}], packed[0].schema)
    both = pa.Table.from_batches([kept, *packed]).combine_chunks().to_batches()[0]
    for some in (both, both.slice(1), both.slice(2)):
        out = [*wv._unpacked(iter([some, some.slice(0, 0)]))]
        assert len(out) == 1 and out[0].schema == batch.schema
    sums = {x["term"]: {i: sum(n for j, n in zip(x["ids"], x["ns"]) if j == i) for i in x["ids"]} for x in next(wv._unpacked(iter([both]))).to_pylist()}
    assert sums == {"a": {0: 1, 19999: 255, 3: 256}, "b": {7: 1000}}


def test_rounds_give_the_same_scores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame([("d", i % 50, t) for i, t in enumerate(_texts(4))] + [(None, None, "sea1")], "dataset string, paper_key int, abstract string")
    vectors = wv.learn(df, F.split("abstract", " "), dim=5, window=3, least=2)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "18")
        got = [{(r.dataset, r.paper_key): r.score for r in semantic.word_vector_scores(df, vectors, "sea1 law2", "abstract", ["dataset", "paper_key"], rounds=n).collect()} for n in (1, 4)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].keys() == got[1].keys() and len(got[0]) == 51 and max(abs(got[0][k] - got[1][k]) for k in got[0]) < 1e-12
