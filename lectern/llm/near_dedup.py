"""Near-duplicate documents: SetSketch registers, bands, verified links, components.

A document is the set of its word shingles.  Documents are linked when the Jaccard
similarity of their sets is at least ``similarity``; the result names the connected components.

* **Sketch.**  Every shingle sends a Poisson stream of points to random registers; a register
  keeps the least point as a truncated exponent to base ``B``: a SetSketch.  Equal registers
  are about as likely as the sets are similar, sketches of unions are register-wise
  maxima.  Points past every register's value are never made, so a text costs about its number
  of shingles plus REGISTERS * ln(REGISTERS) steps.
* **Bands.**  ``ROWS`` registers make a band; sets that agree in a band share a bucket.  A pair
  of similarity 0.8 misses all BANDS buckets with a probability below 1e-6.
* **Estimate.**  For a candidate pair the likelihood of the similarity, given how many registers
  are larger, smaller and equal and given both set sizes, is maximised.  Pairs six standard deviations below
  the threshold are put aside.
* **Verify.**  The full sets of the others are intersected.

Documents with equal sets are one node from the start.  First every node is compared with one hub
per bucket; the hub then leaves its bucket, and buckets whose nodes have met in one component are
finished.  The nodes of the other buckets are dealt into blocks of bounded size, nodes of the same
large bucket together.  A node is sent once to each block that it shares a bucket with (a tile is
two blocks, or one with itself), and the pairs of a tile that share a bucket and lie in
different components are found, estimated and verified there.  A pair has one tile, so no link is
lost; pairs are never rows, and a tile returns fewer links than it has nodes.

Defined cases: a null text has no words; a text with fewer words than a shingle is one
shingle of all its words; an empty set is linked with nothing and its component is its own id;
a null id comes after all others; rows that repeat an id are separate documents; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.words import Powers, Spans, WordHashes, chunks, mix
from lectern.session import scratch_table

SIMILARITY = 80  # percent
SHINGLE = 5
BANDS = 48
ROWS = 6
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, and the largest register value (16 bits).
B, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: What a block holds on average at most: nodes, and bytes of their sketches and sets.
BLOCK_NODES, BLOCK_BYTES = 1024, 4 << 20
#: Candidate pairs of a tile that are estimated together.
ESTIMATED = 20_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# --- sets and sketches --------------------------------------------------------------------
def shingle_sets(texts: list[list[bytes]], known: WordHashes, powers: Powers, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    sizes = [len(t) for t in texts]
    words = known.of([w for t in texts for w in t])
    if not len(words):
        return [words for _ in texts]
    spans = Spans(words, powers)
    grams = spans.grams(shingle) if len(words) >= shingle else words[:0]
    out, at = [], 0
    for n in sizes:
        if n >= shingle:
            out.append(np.unique(grams[at:at + n - shingle + 1]))
        else:
            out.append(spans.of(np.array([at]), np.array([at + n])) if n else words[:0])
        at += n
    return out


def sketches(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """SetSketch registers (uint16), one row a set."""
    out = np.zeros((len(sets), registers), dtype=np.uint16)
    flat = out.reshape(-1)
    element = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    point = np.zeros(len(element))
    low = np.zeros(len(sets), dtype=np.uint16)
    step = 0
    while len(element):
        step += 1
        h = mix(element + np.uint64(step * int(GOLDEN) % (1 << 64)))
        point -= np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / (RATE * registers)
        value = np.clip(np.floor(1 - np.log(point) / math.log(B)), 0, TOP).astype(np.uint16)
        alive = value > low[owner]
        if not alive.all():
            element, owner, point, value, h = element[alive], owner[alive], point[alive], value[alive], h[alive]
        register = (mix(h) % np.uint64(registers)).astype(np.int64)
        np.maximum.at(flat, owner * registers + register, value)
        if step % 4 == 0 and len(owner):
            left = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
            low[left] = out[left].min(axis=1)
    return out


def text_sets(text: Column, shingle: int) -> Column:
    """struct(n, digest binary, sketch binary) of each text's shingle set."""

    @F.pandas_udf("n bigint, digest binary, sketch binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, powers = WordHashes(), Powers()
        for batch in batches:
            for texts in chunks(batch, lower=True):  # what is yielded need not be as long as a batch
                sets = shingle_sets(texts, known, powers, shingle)
                yield pd.DataFrame([(len(s), xxhash.xxh3_128_digest(s.tobytes()), registers.tobytes() if len(s) else None)
                                    for s, registers in zip(sets, sketches(sets, REGISTERS))], columns=["n", "digest", "sketch"])

    return made(text)


def full_sets(text: Column, shingle: int) -> Column:
    """The members of each text's shingle set."""

    @F.pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, powers = WordHashes(), Powers()
        for batch in batches:
            for texts in chunks(batch, lower=True):
                yield pd.Series([s.tobytes() for s in shingle_sets(texts, known, powers, shingle)], dtype=object)

    return made(text)


def banded(registers: np.ndarray) -> np.ndarray:
    """The bucket of each sketch (row) in each band (column)."""
    part = registers.reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), part.shape[:2])
    for r in range(ROWS):
        keys = mix(keys * GOLDEN + part[:, :, r].astype(np.uint64))
    return keys.view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_keys(sketch: pd.Series) -> pd.Series:
    rows = []
    for at in range(0, len(sketch), 1000):
        rows.extend(banded(np.frombuffer(b"".join(sketch.iloc[at:at + 1000]), dtype=np.uint16)))
    return pd.Series(rows, dtype=object)


def likeliest(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Jaccard similarity of highest likelihood, by ternary search."""
    u = n1 / (n1 + n2)
    v = 1 - u

    def chance(x):
        return -np.log1p(-x * (B - 1) / B) / math.log(B)

    def likelihood(j):
        up = np.clip(chance(np.maximum(u - v * j, 0)), 1e-12, 1)
        down = np.clip(chance(np.maximum(v - u * j, 0)), 1e-12, 1)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    out = []
    for at in range(0, len(a), 1000):
        x, y = (np.frombuffer(b"".join(s.iloc[at:at + 1000]), dtype=np.uint16).reshape(-1, REGISTERS) for s in (a, b))
        n1, n2 = (s.iloc[at:at + 1000].to_numpy(dtype=float) for s in (n_a, n_b))
        out.append(likeliest((x > y).sum(axis=1), (x < y).sum(axis=1), (x == y).sum(axis=1), n1, n2))
    return pd.Series(np.concatenate(out) if out else [], dtype=float)


@F.pandas_udf(T.LongType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), True))
                      for x, y in zip(a, b)], dtype="int64")


# --- components -----------------------------------------------------------------------------
def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over ``links`` (a, b), for nodes with links.

    Contraction: every node hooks to the smallest of itself and its neighbours, and the edges
    are renamed accordingly, until none is left.  Every round is written down; the sides of
    its joins are broadcast only if Spark knows them for small.
    """
    edges = scratch_table(links.select("a", "b").where("a != b"), "near-edges")
    labels = None
    while edges.head(1):
        both = edges.union(edges.select("b", "a"))
        up = scratch_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("up")), "near-up")
        if labels is None:
            labels = up.withColumnRenamed("up", "comp")
        else:
            moved = labels.join(up.withColumnRenamed("node", "comp"), "comp", "left")
            labels = scratch_table(moved.select("node", F.coalesce("up", "comp").alias("comp")), "near-comp")
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("node").alias(end), F.col("up").alias(f"up_{end}")), end)
        edges = scratch_table(edges.select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).where("a != b").distinct(),
                              "near-edges")
    return labels


# --- links ----------------------------------------------------------------------------------
def _fits(n_a: str, n_b: str, percent: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _least_estimate(percent: int) -> float:
    """Pairs with an estimate below it are put aside."""
    return percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)


def _verify(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar, as a written table."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    likely = (scratch_table(pairs, "near-pairs").join(side("a"), "a").join(side("b"), "b").where(_fits("n_a", "n_b", percent))
              .withColumn("j", estimate("s_a", "s_b", "n_a", "n_b")).where(F.col("j") >= _least_estimate(percent))
              .select("a", "b", "n_a", "n_b"))
    likely = scratch_table(likely, "near-likely")
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("members").alias("m_a")), "a")
    full = full.join(sets.select(F.col("node").alias("b"), F.col("members").alias("m_b")), "b")
    both = full.withColumn("both", common("m_a", "m_b"))
    return scratch_table(both.where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent)
                         .select("a", "b"), "near-links")


def _open(bands: DataFrame) -> DataFrame:
    """The rows (key, node, comp, ...) of buckets whose nodes lie in more than one component."""
    split = bands.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    return scratch_table(bands.join(split, "key", "left_semi"), "near-open")


def _tiles(opened: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The open nodes with sketches and sets, one row for each tile (p, q) that they belong to."""
    counts = opened.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    homes = (opened.join(counts, "key").groupBy("node")
             .agg(F.max_by("key", F.struct("c", "key")).alias("home"), F.first("comp").alias("comp")))
    weight = F.greatest(F.lit(1 / BLOCK_NODES), (F.col("n") * 8 + 2 * REGISTERS) / BLOCK_BYTES)
    homes = scratch_table(homes.join(nodes.select("node", "n"), "node").withColumn("weight", weight), "near-homes")
    loads = homes.groupBy("home").agg(F.sum("weight").alias("load"))
    # Large buckets are cut into blocks; small ones share blocks.
    bins = math.ceil(homes.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]) + 1
    block = (F.when(F.col("load") < 0.25, F.xxhash64(F.pmod("home", F.lit(bins))))
             .otherwise(F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil("load")))))
    blocks = scratch_table(homes.join(loads, "home").select("node", "comp", block.alias("block")), "near-blocks")
    places = opened.select("key", "node").join(blocks.select("node", "block"), "node")
    others = places.groupBy("key").agg(F.collect_set("block").alias("others"))
    met = (places.join(others, "key").groupBy("node", "block").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
           .select("node", "block", F.explode("others").alias("other"))
           .select("node", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")))
    return (met.join(blocks, "node").join(nodes.select("node", "n", "sketch"), "node").join(sets, "node"))


def _tile_links(percent: int):
    """A function that gives enough links (a, b) of a tile to connect all that are linked in it."""
    def links(tile: pd.DataFrame) -> pd.DataFrame:
        node, n, block = (tile[c].to_numpy() for c in ("node", "n", "block"))
        p, q = tile["p"].iloc[0], tile["q"].iloc[0]
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": node[:0], "b": node[:0]})
        registers = np.frombuffer(b"".join(tile["sketch"]), dtype=np.uint16).reshape(-1, REGISTERS)
        root, keys = tile["comp"].to_numpy().copy(), banded(registers)
        # Candidates: in one bucket, of fitting size, in different components.
        x, y = [], []
        for i in left:
            js = right[right > i] if p == q else right
            js = js[(keys[js] == keys[i]).any(axis=1) & (root[js] != root[i])
                    & (np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * percent)]
            x.append(np.full(len(js), i))
            y.append(js)
        x, y = np.concatenate(x), np.concatenate(y)
        likely = np.zeros(len(x), dtype=bool)
        for at in range(0, len(x), ESTIMATED):
            part = slice(at, at + ESTIMATED)
            r, s = registers[x[part]], registers[y[part]]
            found = likeliest((r > s).sum(axis=1), (r < s).sum(axis=1), (r == s).sum(axis=1),
                              n[x[part]].astype(float), n[y[part]].astype(float))
            likely[part] = found >= _least_estimate(percent)
        x, y = x[likely], y[likely]
        # Full sets, as positions among all members of the tile.
        used = np.unique(np.concatenate([x, y]))
        sets = [np.frombuffer(tile["members"].iloc[i], dtype=np.uint64) for i in used]
        known, codes = np.unique(np.concatenate(sets), return_inverse=True) if sets else (used, used)
        sets = dict(zip(used.tolist(), np.split(codes, np.cumsum([len(m) for m in sets])[:-1]))) if sets else {}
        flag, out = np.zeros(len(known), dtype=np.int64), []
        for first, last in zip(starts := np.flatnonzero(np.diff(x, prepend=-1)), [*starts[1:], len(x)]):
            i, js = x[first], y[first:last]
            js = js[root[js] != root[i]]
            if not len(js):
                continue
            flag[sets[int(i)]] = 1
            ends = np.cumsum(n[js])
            both = np.add.reduceat(flag[np.concatenate([sets[int(j)] for j in js])], ends - n[js])
            flag[sets[int(i)]] = 0
            for j in js[both * 100 >= (n[i] + n[js] - both) * percent]:
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return links


def link(docs_nodes: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame | None:
    """(node, comp) of the nodes that have links, or None.

    docs_nodes: node, row, n, sketch.  texts: row, text.
    """
    nodes = docs_nodes.select("node", "n", "sketch")
    opened = _open(nodes.select("node", F.explode(band_keys("sketch")).alias("key"), F.col("node").alias("comp")))
    if not opened.head(1):
        return None
    asked = scratch_table(docs_nodes.join(opened.select("node").distinct(), "node", "left_semi"), "near-asked")
    # The sets of all nodes that can ever be compared, from one more pass over the texts.
    some = texts.select("row", "text").join(asked.select("node", "row"), "row")
    sets = scratch_table(some.select("node", full_sets(F.col("text"), shingle).alias("members")), "near-sets")
    hubs = opened.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("hub"))
    ruled = scratch_table(opened.join(hubs, "key").where("node != hub"), "near-hubs")
    pairs = ruled.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = _verify(pairs, asked, sets, percent)
    labels = components(links)
    if labels is None:
        rest = ruled
    else:
        rest = ruled.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rest = _open(rest.select("key", "node", "comp"))
    if not rest.head(1):
        return labels
    more = scratch_table(_tiles(rest, asked, sets).groupBy("p", "q").applyInPandas(_tile_links(percent), "a bigint, b bigint"),
                         "near-links")
    if not more.head(1):
        return labels
    return components(more if labels is None else more.union(labels.select("node", "comp")))


def decide(texts: DataFrame, percent: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``texts`` (row, id, text; a written table): row, id, n_shingles, component_id,
    node (null for empty sets), kept.  Of each component the row with the least (id, row) stays, null ids last."""
    rows = scratch_table(texts.select("row", "id", text_sets(F.col("text"), shingle).alias("s")).select("row", "id", "s.*"), "near-rows")
    made = (rows.where("n > 0").groupBy("digest")
            .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"),
                 F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    nodes = scratch_table(made.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    labels = link(nodes.select("node", "least.row", "n", "sketch"), texts, percent, shingle)
    named = nodes.select("digest", "node", "least")
    if labels is not None:
        named = named.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min("least").alias("least"))
        named = named.drop("least").join(least, "comp")
    named = named.select("digest", "node", F.col("least.id").alias("component_id"), F.col("least.row").alias("stays"))
    full = rows.where("n > 0").select("row", "id", "n", "digest").join(named, "digest")
    full = full.select("row", "id", "n", "node", "component_id", (F.col("row") == F.col("stays")).alias("kept"))
    alone = rows.where("n = 0").select("row", "id", "n", F.lit(None).cast("long").alias("node"), F.col("id").alias("component_id"),
                                       F.lit(True).alias("kept"))
    out = full.unionByName(alone)
    return out.select("row", "id", F.col("n").alias("n_shingles"), "component_id", "node", "kept")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, node (null for empty sets), kept."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return decide(scratch_table(texts, "near-texts"), percent, shingle).drop("row")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               percent: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest id
    (null last; of equal ids the first row), and all without words."""
    rows = scratch_table(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "near-docs")
    texts = rows.select("row", F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{text_col}").alias("text"))
    stay = decide(texts, percent, shingle).where("kept").select("row")
    return rows.join(stay, "row", "left_semi").select("doc.*")
