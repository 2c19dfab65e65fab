"""Neighbours, spelling variants and source divergence against brute force, with the cases that each operator defines."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import divergence, multi_index, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- nearest neighbours ------------------------------------------------------------------------
def _nearest(ids, vectors, asked, k):
    """(query, rank) -> (id, distance) by comparing everything; rows of other sizes are no candidates."""
    out = {}
    for i, v in enumerate(vectors):
        if asked(ids[i]):
            others = sorted((float(np.sqrt(((np.asarray(w) - v) ** 2).sum())), ids[j], j) for j, w in enumerate(vectors)
                            if j != i and len(w) == len(v))
            out[i] = [(x, d) for d, x, _ in others[:k]]
    return out


def _rows(found):
    out = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("kind", ["sphere", "clusters", "one direction"])
def test_neighbours_recall(spark, kind):
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 24))
    if kind == "clusters":
        x = r.standard_normal((30, 24))[r.integers(0, 30, 3000)] * 4 + 0.3 * x
    if kind == "one direction":
        x = np.outer(r.standard_normal(3000) * 5, r.standard_normal(24)) + 0.05 * x + 7
    x = x.astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = _rows(multi_index.nearest(table, F.col("vec_id") % 50 == 0))
    want = _nearest(list(range(3000)), list(x), lambda i: i % 50 == 0, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (p[1], p[0]))
        for a, d in found:
            assert d == pytest.approx(float(np.sqrt(((x[a] - x[q]) ** 2).sum())), rel=1e-12)


def test_neighbours_defined_cases(spark):
    r = np.random.default_rng(4)
    common = [1.0, 2.0, 3.0]
    rows = [(i, common, "x", 1, 0.5) for i in range(40)]  # one vector for most
    rows += [(100 + i, r.standard_normal(3).tolist(), "x", 1, 0.5) for i in range(6)]
    rows += [(200, [1.0, 2.0], "x", 1, 0.5), (201, [1.0, 2.5], "x", 1, 0.5), (202, [9.0] * 5, "x", 1, 0.5)]  # other sizes
    rows += [(5, [1.0, 2.0, 3.5], "x", 1, 0.5), (None, common, "x", 1, 0.5), (300, None, "x", 1, 0.5), (301, [], "x", 1, 0.5),
             (302, [0.0, 0.0, 0.0], "x", 1, 0.5), (303, [float("nan"), 1.0, 1.0], "x", 1, 0.5), (304, [None, 1.0, 1.0], "x", 1, 0.5),
             (305, [float("inf"), 1.0, 1.0], "x", 1, 0.5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string, rank int, score double").repartition(3)
    used = [(a, v) for a, v, *_ in rows if a is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    got = multi_index.nearest(table, F.lit(True), k=4).collect()
    want = _nearest([a for a, _ in used], [np.array(v) for _, v in used], lambda i: True, 4)
    flat = sorted((used[i][0], n + 1, a, round(d, 9)) for i, found in want.items() for n, (a, d) in enumerate(found))
    assert sorted((g.query_id, g.rank, g.vec_id, round(g.score, 9)) for g in got) == flat
    assert multi_index.nearest(table.limit(0), F.lit(True)).count() == 0
    assert multi_index.nearest(table, F.lit(None).cast("boolean")).count() == 0


def test_every_code_within_the_radius_is_retrieved_once(spark):
    """The index alone, with pieces that must be split, against all Hamming distances."""
    r = np.random.default_rng(5)
    centre = r.integers(0, 2, multi_index.BITS)
    bits = np.where(r.random((600, multi_index.BITS)) < r.uniform(0, 0.5, (600, 1)), 1 - centre, centre).astype(np.uint8)
    codes = np.packbits(bits, axis=1)
    table = spark.createDataFrame([(i, 3, codes[i].tobytes()) for i in range(600)], "rep long, dim int, code binary")
    index = multi_index.Index(table, 600, unit=64)
    asked = [(i, 3, codes[i].tobytes(), low, radius) for i, (low, radius) in enumerate([(-1, 0), (-1, 14), (6, 80), (-1, 180), (120, 256), (-1, multi_index.BITS)])]
    queries = spark.createDataFrame(asked, "q long, dim int, code binary, low int, radius int")
    got = [(p.q, p.rep) for p in index.within(queries).collect()]
    apart = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    want = {(q, j) for q, _, _, low, radius in asked for j in range(600) if low < apart[q, j] <= radius}
    assert len(got) == len(set(got)) and set(got) == want


# --- spelling ----------------------------------------------------------------------------------
def _variants(docs, least_n=5, ratio=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least_n}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, some in around.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(around[w]), n[form[w]] if w in form else None) for w in n}


def _spelled(seed=6):
    r = np.random.default_rng(seed)
    letters = list("abcdeéñÿz")
    stems = ["".join(r.choice(letters, r.integers(6, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaa", "aaaaaaaa", "Überfluß", "überfluß"]
    docs = []
    for i in range(150):
        said = []
        for _ in range(60):
            w = list(stems[int(r.exponential(3)) % len(stems)])
            for _ in range(int(r.random() < 0.35) + int(r.random() < 0.1)):
                at = int(r.integers(0, len(w)))
                w[at:at + 1] = [[], [str(r.choice(letters))], [w[at], str(r.choice(letters))]][int(r.integers(0, 3))]
            w = "".join(w)
            said.append(w.upper() if r.random() < 0.1 else w)
        docs.append((i, " ,×ő1"[i % 5].join(said)))
    return docs + [(None, "abcdef " * 7), (900, None), (901, ""), (3, docs[3][1]), (902, "x" * 50_000 + " " + ("y" * 3000 + " ") * 6 + ("y" * 2999 + " ") * 40)]


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 32])
def test_spelling_variants(spark, filter_bytes):
    """Also with filters so small that nearly every edit is a false positive and lengths are probed one at a time."""
    docs = _spelled()
    table = spark.createDataFrame([(i, t, "w", 1, "e") for i, t in docs], "doc_id long, text string, word string, n int, edit string").repartition(3)
    if filter_bytes == 32:
        docs = docs[:40]
        table = table.where("doc_id < 40 AND n = 1").where(F.col("doc_id").isin([i for i, _ in docs]))
        docs = docs + [(3, docs[3][1])]
    got = [tuple(r) for r in spelling.variants(table, filter_bytes=filter_bytes).collect()]
    want = _variants(docs)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)
    assert filter_bytes == 32 or any(r[2] != r[1] for r in got if r[1])  # a form of a form


def test_spelling_without_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    alone = spark.createDataFrame([(1, "lonely " * 9)], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(alone).collect()] == [("lonely", None, "lonely", 9, 0, None)]


def test_every_near_pair_is_probed_once():
    words = ["abcdef", "abcdeg", "bbcdef", "aabcde"]
    full = {6: np.full((1, 8), 0xFFFFFFFF, dtype=np.uint32), 5: np.full((1, 8), 0xFFFFFFFF, dtype=np.uint32)}
    found = Counter(spelling.edits(words, full[5], full[6]))
    assert max(found.values()) == 1
    assert ("abcdeg", "abcdef") in found and ("abcdef", "abcdeg") not in found and ("aabcde", "abcde") in found


# --- divergence --------------------------------------------------------------------------------
def _audit(docs, terms=200):
    groups, langs = defaultdict(Counter), defaultdict(Counter)
    seen = defaultdict(Counter)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = [w.translate(LOW) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang, source].update(words)
        langs[lang].update(words)
        seen[lang].update(set(words))
    out = set()
    kept = {lang: sorted(t for t, c in seen[lang].items() if c >= 3) for lang in {g[0] for g in groups}}

    def chances(count, lang):
        total, v = sum(count[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 1) // (total + v) for t in kept[lang]}

    p = {g: chances(c, g[0]) for g, c in groups.items()}
    q = {lang: chances(langs[lang], lang) for lang in kept}
    for lang, source in groups:
        own = p[lang, source]
        pairs = [(-sum((own[t] - p[lang, o][t]) ** 2 // p[lang, o][t] for t in own), o.encode(), o) for x, o in groups if x == lang and o != source]
        out |= {(lang, source, "pair", o, -v, n + 1) for n, (v, _, o) in enumerate(sorted(pairs))}
        some = [(-((own[t] - q[lang][t]) ** 2 // q[lang][t]), t.encode(), t) for t in own
                if groups[lang, source][t] > 0 and own[t] > q[lang][t]]
        out |= {(lang, source, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(sorted(some)[:terms])}
    return out


def _said():
    r = np.random.default_rng(7)
    vocab = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Été", "ÉTÉ", "été", "日本", "a"]
    docs = []
    for i in range(160):
        n = int(r.integers(0, 60))
        text = " ".join(vocab[int(x) % len(vocab)] for x in r.exponential(30 + 10 * (i % 5), n))
        docs.append((i, text.upper() if i % 9 == 0 else text, ["en", "de"][i % 2], f"s{(i // 2) % 7}"))
    docs += [(900, None, "en", "s1"), (901, "ta ta", None, None), (902, "12 , !", "xx", "only"), (903, "aa bb", "yy", "u"), (904, "", "yy", None),
             (905, "aa", "yy", "v"), docs[4], docs[4], (906, "word_with-marks " * 3000, "en", "long"), (907, None, "zz", "a"), (908, "b", "zz", "b")]
    return docs


@pytest.mark.parametrize("block,sources,terms", [(divergence.BLOCK, divergence.SOURCES, 200), (16, 3, 5)])
def test_divergence(spark, block, sources, terms):
    """Also with blocks and decks so small that every sum is put together from many tasks."""
    docs = _said()
    table = spark.createDataFrame([(*d, "t", 1, 2) for d in docs], "doc_id long, text string, lang string, source string, term string, n int, kept int")
    got = [tuple(r) for r in divergence.audit(table.repartition(3), terms=terms, block=block, sources=sources).collect()]
    want = _audit(docs, terms)
    assert len(got) == len(want) and set(got) == want
    assert divergence.audit(table.limit(0)).count() == 0


def test_equal_subtrees_share_nodes_and_are_priced_once():
    leaves = np.zeros((3, 64), dtype=np.int64)
    leaves[1, 5], leaves[2, 5], leaves[2, 40] = 3, 3, 1
    values, levels, roots = divergence.consed(leaves)
    assert len(set(roots)) == 3 and sum(len(left) for left, _ in levels) <= 3 * 6 + 6
    asked = []

    def prices(pair, a, b):
        asked.append(len(pair))
        return (values[a] - values[b]) ** 2 + 1

    assert divergence.priced(roots[[1, 0]], roots[[2, 0]], levels, prices).tolist() == [64 + 1, 64]
    assert asked == [4]  # (0, 0), (3, 3), (0, 1) of the first two trees and (0, 0) of the others, instead of 128 leaf pairs


def test_large_counts_are_exact(spark):
    n = spark.createDataFrame([(10**12, 10**13, 5)], "n long, total long, kept long")
    got = n.select(divergence.chance(F.col("n"), F.col("total"), F.col("kept"))).first()[0]
    assert got == 1 + 10**9 * (10**12 + 1) // (10**13 + 5)
