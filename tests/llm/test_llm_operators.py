"""Small fixtures, with the cases that each operator defines, against brute force."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import (exact_dedup, exact_topk, html_text, language_id, mixing, near_dedup, packing, quality, secret_scan,
                         substring_dedup)
from lectern.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, kept string, size string, row string"


def words(seed: int, n: int) -> list[str]:
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 500, n)]


LONG = words(1, 120)
TEXTS = [
    " ".join(LONG), " ".join(LONG[:60] + ["x"] + LONG[61:]), "  ".join(LONG), " ".join(words(2, 30) + LONG[20:90] + words(3, 30)),
    None, "", " \n", "one", "One", "two words", " ".join(words(4, 20_000)), "a b" * 40, " ".join(words(2, 30) + LONG[20:90] + words(3, 30)),
    "Größe ÀÉ", "12 34 !?",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de"][i % 2], ["a", "b", None][i % 3], "k", "s", "r") for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[0], (None, "null id " + " ".join(LONG[:70]), None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got = exact_dedup.decide(docs, frequent=4).collect()
    assert len(got) == docs.count()
    groups: dict = {}
    for r in docs.collect():
        groups.setdefault((r.text or "").translate({c: None for c in (9, 10, 11, 12, 13, 32)}), []).append(r)
    for bare, rows in groups.items():
        digest = hashlib.sha256(bare.encode()).digest()
        own = [g for g in got if bytes(g.digest) == digest]
        best = min(rows, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert {(g.keep_id, g.group_size) for g in own} == {(best.doc_id, len(rows))}
        assert sum(g.kept for g in own) == 1
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.decide(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def test_html():
    page = ("<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
            "<div class='ad'>Buy now, it is very cheap and good for you and everybody else here.</div><article><h1>Head&amp;er</h1>"
            "<p><b>First  para.<br>next<p>Second&nbsp;one</p><ul><li><a href=/>x</a></li><li><a href=/>y</a></li></ul>"
            "<div id='comments'>I liked it</div><p>z</p></article><footer>(c)</footer></body></html>")
    assert html_text.main_text(page) == "Head&er\nFirst para. next\nSecond one\nz"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p></b>") == ""
    plain = f"<body><div id=menu>{'m ' * 90}</div><div><p>{'long text ' * 30}</p><p>short</p></div><div class=sidebar>s</div><a"
    assert html_text.main_text(plain) == ("long text " * 30).strip() + "\nshort"


def test_html_marked_wrappers():
    first = "The first paragraph of the article is long enough to make a surge, as it has many words in it."
    second = "A second paragraph, also of some length, so that there is a text of more than one line here."
    plain, want = f"<h1>T</h1><p>{first}</p><p>{second}</p>", f"T\n{first}\n{second}"
    for name in ("has-sidebar", "no-sidebar", "layout-sidebar", "ad-free", "search-results"):
        for inner in (plain, f"<article>{plain}</article>"):
            page = (f"<body><nav><a href=/>Home</a></nav><div id='page' class='{name}'>{inner}<div class=sidebar>side {'x ' * 30}</div></div>"
                    "<footer>(c) me</footer></body>")
            assert html_text.main_text(page) == want, name
    assert html_text.main_text(f"<body><form><div class=menu>a b</div>{plain}<footer>c</footer></form>") == want
    assert html_text.main_text("<form><fieldset><p>short</p></fieldset></form>") == "short"
    for tag in ("article", "div"):  # the article's own header
        page = f"<div class=top><a href=/>x</a></div><{tag}><div class='entry-header'><h1>T</h1></div><p>{first}</p><p>{second}</p></{tag}>"
        assert html_text.main_text(page) == want, tag
    # Surges choose, not the tag; like siblings around the heaviest stretch belong to it.
    links = "<p><a href=/>link</a></p>" * 4
    teasers = f"<article><p>teaser</p></article>{links}<div>{plain}</div>{links}<article><p>teaser</p></article>"
    assert html_text.main_text(teasers) == want
    parts = html_text.main_text(f"<div class=top>{links}</div><section>{plain}</section>{links}<section><p>{second}</p></section><div>end</div>")
    assert parts == f"{want}\n" + "link\n" * 4 + second
    # What is small beside the text stays out.
    assert html_text.main_text(f"<article><p>one</p></article><div class=ad>{first}</div><footer>{first}</footer>") == "one"


def test_html_added_matter_beside_a_short_text():
    article = "<h1>Title</h1><div><p>A short article of few words.</p></div>"
    for name in ("comments", "ad", "cookie-notice", "newsletter signup"):
        added = f"<div class='{name}'><p>{'said by others ' * 20}</p></div>"
        assert html_text.main_text(f"<body>{article}{added}</body>") == "Title\nA short article of few words.", name
        assert html_text.main_text(f"<body>{added}{article}</body>") == "Title\nA short article of few words.", name
    # A wrapper with the headline is the article, whatever its name.
    long = "<p>" + "long text " * 30 + "</p>"
    assert html_text.main_text(f"<body><div class='ad-free'><h1>Title</h1>{long}</div><p>a b</p></body>").startswith("Title\nlong")


def test_html_bad_markup_is_read_in_linear_time():
    for bad in ("<![foo[bar]]>", "<![CDATA[x]]>", "<![", "<!x", "<!>", "<![if !IE]>", "<?php echo 1 ?>", "<!--", "</", "<a href='"):
        text = html_text.main_text(f"<article><p>one</p>{bad}<p>two</p></article>")
        assert text.startswith("one"), bad
    assert html_text.main_text("<p>one</p><![foo[bar]]><p>two</p>") == "one\ntwo"
    began = time.process_time()
    assert html_text.main_text("<div>some text here" * 30_000)
    assert html_text.main_text("<p>" + "<b><i>" * 30_000 + "text" + "<div></b>" * 30_000)
    assert html_text.main_text("<ul><li>" * 30_000 + "text")
    assert time.process_time() - began < 20
    r = np.random.default_rng(8)
    bits = ["<div>", "</div>", "<p>", "<![", "]]>", "<!--", "-->", "<", ">", "&amp;", "&#x0;", "&#99999999;", "text ", "<a href=", "<script>",
            "</script>", "<li>", "<table><tr><td>", "</p", "'", '"', "<!DOCTYPE", "<?", "<title>", "<article>", "</article>", "\x00"]
    for _ in range(300):
        html_text.main_text("".join(r.choice(bits, 40)))


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<article>a</article>", "y")], "page_id long, url string, html string, text string")
    assert {(r.id, r.text, r.n_chars) for r in html_text.extract(rows).collect()} == {(1, "", 0), (None, "a", 1)}
    assert html_text.extract(rows.limit(0)).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query(r"[0-9a-f]+") is True
    assert secret_scan.trigram_query("AKIA[A-Z]+") == ("and", frozenset({"aki", "kia"}))
    assert secret_scan.trigram_query("(abc|defg)x") == ("or", frozenset({
        ("and", frozenset({"abc", "bcx"})), ("and", frozenset({"def", "efg", "fgx"}))}))


def test_secrets(spark):
    import re
    texts = ["ß token=abcdefgh1 Password: 'x' AKIA" + "A" * 12 + " " + "0f" * 16, None, "", "token=secret: abcdefghijk", "apikey = k" * 3000,
             "AKIAABC 0f0f", "pass\U0001F600word=" + "a" * 40, "gh" + "p_" + "a" * 36]
    rows = spark.createDataFrame([(i % 7, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = Counter((r.id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_scan.scan_digest(rows).collect())
    want: Counter = Counter()
    for i, t in enumerate(texts):
        spans, counts = [], []
        for n, rule in enumerate(secret_scan.RULES):
            found = [m for m in re.finditer(rule.pattern, t or "", re.A) if len(m[rule.group]) >= rule.least]
            counts.append(len(found))
            spans += [(m.start(), n, f"{rule.kind}:{m.start()}:{m.end()}") for m in found]
        base = ",".join(s for _, n, s in sorted(spans) if n < 3)
        want[(i % 7, *counts[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(s for *_, s in sorted(spans)))] += 1
    assert got == want
    assert secret_scan.scan_digest(rows.limit(0)).count() == 0


def test_topk(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(size=4).round(1)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 340)]
    rows += [rows[5], (7, [9.0, 9.0, 9.0, 9.0]), (100, [0.1, -0.2, 0.3, 0.0])]  # ids that occur twice, with the same vector and with others
    used = len(rows)
    rows += [(400, None), (500, [1.0, None, 0.0, 0.0]), (600, [float("nan"), 0.0, 0.0, 0.0]), (700, [1.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in exact_topk.top_k(table, F.col("vec_id") % 100 == 0).collect())
    ints = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 1024).astype(int)) for i, v in rows[:used]]
    want = []
    for at, (q, u) in enumerate(ints):
        if q % 100 == 0:
            best = sorted((-int(v @ u), i, j) for j, (i, v) in enumerate(ints) if j != at)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i, _) in enumerate(best)]
    assert got == sorted(want)
    assert exact_topk.top_k(table.limit(0), F.lit(True)).count() == 0


def test_quality(spark, docs, empty):
    rows = [(i, " ".join(words(i, 60)) + "." if i % 2 else "### " * 40, i % 2) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, words int")
    labels = table.select("doc_id", F.col("words").alias("quality"))
    got = quality.classify(table, labels).collect()
    assert len(got) == 200 and all(r.predicted == r.id % 2 and 0 <= r.score <= 1 for r in got)
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()
    assert quality.classify(empty, labels).count() == 0


def test_rules_of_a_tree():
    text = "Model\n  Tree 0 (weight 1.0):\n    If (feature 3 <= 0.5)\n     If (feature 1 > 2.0E-4)\n      Predict: 0.0\n    Else (feature 3 > 0.5)\n     Predict: 1.0\n"
    assert quality.tree_rules(text) == [
        quality.Rule(frozenset({(3, True, 0.5)})), quality.Rule(frozenset({(3, True, 0.5), (1, False, 2e-4)})),
        quality.Rule(frozenset({(3, False, 0.5)}))]


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_tiles_connect_what_is_linked():
    r = np.random.default_rng(4)
    base = [r.choice(1 << 60, 150, replace=False).astype(np.uint64) for _ in range(3)]
    sets = [np.unique(np.where(r.random(150) < 0.03 * (i % 6), r.integers(1 << 60, size=150).astype(np.uint64), base[i % 3])) for i in range(90)]
    near = {(i, j) for j in range(90) for i in range(j)
            if (both := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both)}
    block = np.arange(90) % 2
    made = pd.DataFrame({"node": np.arange(90), "n": [len(x) for x in sets], "block": block, "comp": np.arange(90),
                         "sketch": [x.tobytes() for x in near_dedup.sketches(sets, near_dedup.REGISTERS)],
                         "members": [x.tobytes() for x in sets]})
    tiles = [made[block == 0].assign(p=0, q=0), made[block == 1].assign(p=1, q=1), made.assign(p=0, q=1)]
    found = [tuple(sorted(x)) for t in tiles for x in near_dedup._tile_links(80)(t.reset_index(drop=True)).to_numpy()]
    assert set(found) <= near and len(found) < 180

    def components(links):
        comp = list(range(90))
        for a, b in links:
            comp = [comp[a] if c == comp[b] else c for c in comp]
        return [comp.index(c) for c in comp]
    assert components(found) == components(near)
    assert len(near_dedup._tile_links(80)(made.head(1).assign(p=0, q=0))) == 0


def test_near_dedup(spark, docs, empty):
    r = np.random.default_rng(3)
    base = words(9, 80)
    rows = [(100 + i, " ".join(x if r.random() > 0.04 * (i % 4) else f"n{r.integers(99)}" for x in base)) for i in range(60)]
    table = docs.select("doc_id", "text").where("doc_id is not null").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    data = [(x.doc_id, shingles(x.text, 2)) for x in table.collect()]
    comp = {i: i for i, _ in data}
    for _ in data:
        for i, a in data:
            for j, b in data:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = near_dedup.near_duplicates(table, shingle=2).collect()
    assert sorted((g.id, g.n_shingles, g.component_id) for g in got) == sorted((i, len(a), comp[i]) for i, a in data)
    assert near_dedup.near_duplicates(docs).count() == docs.count() and near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.near_dedup(docs).columns == docs.columns


def test_near_dedup_keeps_one_row_of_a_component(spark):
    r = np.random.default_rng(5)

    def near(base):
        return " ".join(x if i != at else "n" for at in [r.integers(len(base))] for i, x in enumerate(base))
    a, b, c, d = (words(50 + i, 120) for i in range(4))
    rows = [(1, near(a)), (None, near(a)), (None, near(a)), (None, None), (None, ""), (7, near(b)), (7, near(b)), (3, near(c)), (9, near(c)),
            (9, " ".join(words(60, 40))), (None, near(d)), (None, near(d)), (None, " ".join(words(61, 3))), (5, near(b))]
    table = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int").coalesce(1)
    sets = [shingles(t, 5) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    want = {min((rows[i][0] is None, rows[i][0] or 0, i) for i in range(len(rows)) if comp[i] == g)[2] for g in comp}
    assert {x.row for x in near_dedup.near_dedup(table).collect()} == want and len(want) == 8
    assert sum(x.kept for x in near_dedup.near_duplicates(table).collect()) == 8


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 3), (5, 6), (20, 19), (19, 5), (4, 4)], "a long, b long")
    got = {r.node: r.comp for r in near_dedup.components(links).collect()}
    assert got == {9: 3, 8: 3, 7: 3, 3: 3, 5: 5, 6: 5, 19: 5, 20: 5}


def test_sketch_estimates():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], r.integers(0, 1 << 63, 80).astype(np.uint64)])
    x, y = near_dedup.sketches([a, b], 4096).astype(int)
    j = near_dedup.likeliest(*(np.array([v]) for v in ((x > y).sum(), (x < y).sum(), (x == y).sum(), 400.0, 400.0)))
    assert abs(j[0] - 320 / 480) < 0.05
    both = near_dedup.sketches([np.union1d(a, b)], 4096)[0]
    assert (np.maximum(x, y) == both).all()


def test_substring_dedup(docs, empty):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    first: dict = {}
    for r in rows:
        w = (r.text or "").encode().split()
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s:s + 50]), r.doc_id)
    want: Counter = Counter()
    for r in rows:
        w = (r.text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s:s + 50])] != r.doc_id:
                gone[s:s + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        want[(r.doc_id, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    assert Counter(tuple(r) for r in substring_dedup.substring_dedup(docs).collect()) == want
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    encode = Tokenizer.from_file(tokenizer_path()).encode
    got = packing.pack(docs, tokenizer_path(), keep_ids=True).collect()
    by_sequence: dict = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    want: Counter = Counter()
    for d in docs.collect():
        ids = np.array([*encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for start, length in packing.cuts(len(ids)):
            want[(d.doc_id, start, ids[start:start + length].tobytes(), len(ids))] += 1
    assert Counter((r.id, r.start, bytes(r.ids), r.doc_tokens) for r in got) == want
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_tokens_by_words():
    tokens = packing.WordTokens(tokenizer_path())
    for t in ("Foo's <|endoftext|>bar İstanbul ΑΣ Å é \x85x\xa0y ²½ don''s a\x1cb", "'s'T''re ñandú'LL", "", "汉字 😀!"):
        assert tokens.ids(t) == np.array(tokens.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_pads_little():
    r = np.random.default_rng(1)
    counts = Counter(n for x in r.lognormal(6, 1, 5000) for _, n in packing.cuts(int(x) + 1))
    plan = packing.packing_plan(counts)
    assert (plan.sequence.max() + 1) * 4096 < sum(k * n for k, n in counts.items()) * 1.2  # few sequences beyond the least


def test_language(spark, docs, empty):
    rows = [(i, " ".join(["the house is green and big", "das haus ist grün und groß"][i % 2].split()[i % 3:]), ["en", "de"][i % 2], 1.0)
            for i in range(200)]
    table = spark.createDataFrame(rows + [(900, None, "en", 0.0), (901, "12 !", None, 0.0), (None, "the house", "de", 0.0)],
                                  "doc_id long, text string, lang string, score double")
    got = {r.id: r for r in language_id.identify(table).collect()}
    assert all(got[i].lang_pred == ["en", "de"][i % 2] and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[None].lang_pred == "en" and got[None].held_out
    assert language_id.identify(empty).count() == 0 and language_id.accepted(table).columns == table.columns
    assert language_id.accepted(table).count() == 201


def test_exact_dedup_keeps_the_row_that_was_decided(spark):
    rows = [(1, "a b"), (1, "a    b"), (2, "ab"), (None, "c d"), (None, "c  d"), (3, None), (3, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {(r.doc_id, r.text) for r in exact_dedup.exact_dedup(table).collect()}
    assert len(kept) == 3 and {(1, "a    b"), (None, "c  d")} < kept


def test_language_equals_plain_naive_bayes(spark):
    """The same counts and sums with dictionaries instead of a matrix."""
    r = np.random.default_rng(5)
    alphabets = {"x": "abcde fgh", "y": "cdefg hij", "z": "éàbcd xyz"}
    said = [(i, list(alphabets)[i % 3], "".join(r.choice(list(alphabets[list(alphabets)[i % 3]]), r.integers(1, 40)))) for i in range(120)]
    table = spark.createDataFrame(said, "doc_id long, lang string, text string")
    is_letter = language_id.letters()
    counts = {a: Counter() for a in alphabets}
    texts = Counter()
    for i, lang, text in said:
        if zlib.crc32(str(i).encode()) % 5:
            texts[lang] += 1
            for found in language_id.ngram_buckets(text, is_letter):
                counts[lang].update(found.tolist())
    size = language_id.BUCKETS
    for row in language_id.identify(table).collect():
        grams = [g for found in language_id.ngram_buckets(said[row.id][2], is_letter) for g in found.tolist()]
        logs = {a: np.log(texts[a] / sum(texts.values()))
                + sum(np.log((counts[a][g] + 0.5) / (counts[a].total() + size / 2)) for g in grams) for a in alphabets}
        if not grams:
            assert row.lang_pred == "und"
            continue
        best = max(sorted(logs), key=logs.get)
        assert row.lang_pred == best
        assert row.score == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), abs=1e-4)


def test_ngrams_of_long_texts_come_in_pieces(monkeypatch):
    is_letter = language_id.letters()
    text = " ".join(words(9, 60_000))
    pieces = list(language_id.ngram_buckets(text, is_letter))
    monkeypatch.setattr(language_id, "CHUNK", 1 << 30)
    whole, = language_id.ngram_buckets(text, is_letter)
    assert len(pieces) > 1 and np.array_equal(np.sort(np.concatenate(pieces)), np.sort(whole))


def test_language_without_teachers(spark):
    schema = "doc_id long, text string, lang string, score double"
    texts = ["the house", "Größe", "汉字", "12 !", "", None]
    table = spark.createDataFrame([(i, t, None, 1.0) for i, t in enumerate(texts)], schema)
    assert sorted(r.doc_id for r in language_id.accepted(table).collect()) == [0, 1, 2]
    known = [(i, ["the house is green", "das haus ist grün"][i % 2], ["en", "de"][i % 2], 1.0) for i in range(60)]
    table = spark.createDataFrame(known + [(900, "the green house", None, 1.0), (901, "das grüne haus", None, 1.0)], schema)
    got = {r.doc_id: r.lang for r in language_id.accepted(table).collect()}
    assert (got[900], got[901]) == ("en", "de") and all(got[i] == lang for i, _, lang, _ in known)


def test_sequences_from_the_pipeline(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    encode = Tokenizer.from_file(tokenizer_path()).encode
    texts = [(1, " ".join(LONG)), (1, " ".join(LONG)), (1, " ".join(LONG[:9])), (2, " ".join(words(3, 6000)))]
    got = corpus_pipeline.packed(spark, spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "").collect()
    whole: dict = {}
    for r in sorted(got, key=lambda r: r.start):
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        whole[r.doc_id, r.copy] = whole.get((r.doc_id, r.copy), b"") + bytes(r.ids)
    want = Counter((i, np.array([*encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, t in texts)
    assert Counter((i, ids) for (i, _), ids in whole.items()) == want


def test_mixing(spark, docs, empty):
    rows = [(i, " ".join(["w"] * (5 + i % 40)), f"s{i % 5}" if i % 3 else "big", "x") for i in range(600)]
    rows += [(9000, "only few words here", "tiny", "x"), (9001, None, None, "x"), (9002, "a b", None, "x"), rows[0]]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mixing.mix_takes(table, shard_words=500).collect()
    again = mixing.mix_takes(table.repartition(5), shard_words=500).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    assert all(r.taken <= 3 * r.size for r in got)
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted((x for x in size if x is not None)) + [None])}
    target, open_ = {}, set(size)
    while True:  # as the contract says it
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    took: Counter = Counter()
    source = {i: s for i, _, s, _ in rows}
    for r in got:
        assert abs(r.target - target[source[r.id]]) < 1e-6 and r.source_size == size[source[r.id]]
        took[source[r.id]] += r.taken
    assert all(abs(took[s] - target[s]) <= 8 + 0.02 * target[s] for s in size)
    mixed = mixing.mix_documents(table, shard_words=500)
    assert mixed.columns == table.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix_takes(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_null_ids_share_no_key(spark):
    rows = [(None, " ".join(words(i % 30, 20)), "a") for i in range(400)] + [(7, "x " * 20, "a")] * 100 + [(None, " ", "b")] * 50
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sizes = mixing._sized(table, F.monotonically_increasing_id(), "doc_id", "text", "source")
    placed, none = mixing._placed(sizes, 20, 8, 500, 3)
    shards = [r[0] for r in placed.groupBy("s_source", "shard").agg(F.sum("size")).collect()]
    most = placed.groupBy("s_source", "shard").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]
    assert len(shards) >= 18 and most < 1500 and placed.count() == 500 and none.count() == 50
    got = mixing.mix_takes(table, shard_words=500).collect()
    assert Counter(got) == Counter(mixing.mix_takes(table.repartition(7), shard_words=500).collect()) and len(got) == 550
    assert all(r.taken == 0 for r in got if r.size == 0)
    long = [(None, " ".join(words(1, 60) + words(100 + i, 60))) for i in range(6)] + [(3, " ".join(words(1, 60)))]
    found, cut = substring_dedup.find_repeats(spark.createDataFrame(long, "doc_id long, text string"))
    assert found.select("row").distinct().count() == 7 and sum(r.n_removed == 60 for r in cut.collect()) == 6


def test_pipeline(spark, sf_small):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.schema == docs.schema or [f.name for f in out.schema] == docs.columns, name
        out.write.mode("overwrite").format("noop").save()
    assert corpus_pipeline.run(spark, sf_small).count() > 0


def test_pipeline_stages_against_brute_force(spark, sf_small):
    """Each stage on the whole output of the one before it, with null and repeated ids, other white space and clashing columns."""
    import corpus_pipeline
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    long = " ".join(words(21, 90))
    near = long.replace(long.split()[40], "changed", 1)
    extra = [(1, "a b c", "en", "src0"), (1, "a  b   c", "en", "src0"), (None, long, None, "src1"), (None, near, "de", None), (7, long + " ", "fr", "x"),
             (None, "12 34", "en", "x"), (None, None, None, None), (2, "", "en", "x"), (2, "one two", None, "x"), (2, "one two", "es", "x")]
    extra = [(i, t, lang, source, len(t or "")) for i, t, lang, source in extra]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(3)

    def ran(name, table):
        path = corpus_pipeline.scratch_table(stages[name](spark, table, sf_small), f"test-{name}")
        assert path.columns == docs.columns
        return path, [tuple(r) for r in path.collect()]

    def shown(rows):  # a null language may have been filled in
        return sorted((r[0] is None, r[0] or 0, r[1], r[3] is None, r[3] or "", r[4]) for r in rows)

    rows = [tuple(r) for r in docs.collect()]
    table, got = ran("language_id", docs)
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert shown(got) == shown(rows) and all(r[2] for r in got)
    rows = got
    groups: dict = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate({c: None for c in (9, 10, 11, 12, 13, 32)}), []).append(r)
    best = {k: min((-len(r[1]), r[0] is None, r[0] or 0) for r in v) for k, v in groups.items()}
    table, got = ran("exact_dedup", table)
    assert len(got) == len(groups)
    assert sorted((-len(r[1]), r[0] is None, r[0] or 0) for r in got) == sorted(best.values())
    sets = [shingles(r[1], 5) for r in got]
    comp = list(range(len(got)))

    def find(i):
        return i if comp[i] == i else find(comp[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                comp[find(i)] = find(j)
    want: dict = {}
    for i, r in enumerate(got):
        key = (r[0] is None, r[0] or 0)
        want[find(i)] = min(want.get(find(i), (True, 1 << 60)), key)
    table, kept = ran("near_dedup", table)
    assert len(kept) == len(want) < len(got) and sorted((r[0] is None, r[0] or 0) for r in kept) == sorted(want.values())
    table, mix = ran("mixing", table)
    texts = [r[1] for r in kept]
    texts = [b" ".join([b"", *t.encode().split(), b""]) for t in texts]  # every mixed text is a run of words of a kept one
    assert mix and all(any(w in t for t in texts) for w in (b" ".join([b"", *r[1].encode().split(), b""]) for r in mix))
    pieces = stages["packing"](spark, table, sf_small).collect()
    assert len({(p.copy, p.doc_id) for p in pieces}) == len(mix) and all(len(p.ids) == 4 * p.length for p in pieces)
    by_doc: dict = {}
    for p in sorted(pieces, key=lambda p: p.start):
        by_doc.setdefault((p.copy, p.doc_id), []).append(p)
    for own in by_doc.values():
        assert [p.start for p in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(p.length for p in own) == own[0].doc_tokens
