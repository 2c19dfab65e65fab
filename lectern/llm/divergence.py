"""How far the sources of a language are from each other, and from the language: exact term divergences.

1. **Counts.**  Every task counts the terms of its texts by (lang, source) in dictionaries that it empties into Spark
   whenever they hold HELD terms; Spark adds occurrences and documents.  A language keeps the terms in at least
   ``least_docs`` of its documents and numbers them from 0, the most frequent first.
2. **Trees.**  The counts of a group (lang, source) over these numbers are the leaves of a segment tree.  The numbers
   are cut into blocks of BLOCK; a task builds the subtrees of all its groups for one block, bottom up and hash-consed: equal counts are one
   leaf, and equal pairs of children are one node, whichever group or place they come from.  Rare terms stand
   together, so long runs of zeros and ones are few nodes.
3. **Traversal.**  Two groups' subtrees are walked down at the same time.  Equal pairs of nodes on a level are one
   pair with a multiplicity (the memo), so each is priced once; only pairs of leaves have a price, the divergence of their counts.
   Spark adds the prices of the blocks.
4. **Terms.**  The terms of a group that are more likely there than in its language are joined and ranked natively, with a partial top-k.

Groups of a language with more than SOURCES of them meet in tasks of two blocks of groups.  All arithmetic is on integers: a probability
is 1 + floor(SCALE * (count + 1) / (N + V)), a divergence floor((p - q)^2 / q).

Defined cases: null text, lang and source are ''; a group without terms has counts 0; a language that keeps no term has pairs of value 0;
a language with one source has no pairs; rows that repeat are documents of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranking import dense_position, top_k_per_group
from lectern.session import scratch_table

SCALE = 1_000_000_000
LEAST_DOCS, TERMS = 3, 200
#: Terms by group that a task holds before it passes their counts on.
HELD = 200_000
#: Term numbers of a block (a power of two), groups of a block, and leaves by pairs that a task walks at once.
BLOCK, SOURCES, WALKED = 1 << 13, 64, 1 << 20
#: A term is a run of letters A-Z, a-z and of all code points from 128: in UTF-8, of these bytes.  Others become spaces, A-Z small.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


# --- counts ----------------------------------------------------------------------------------
def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs; one row with a null term for a group that has been seen."""
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array([*n, None], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), terms,
                 pa.array([*n.values(), 0], pa.int64()), pa.array([*(docs[t] for t in n), 0], pa.int64())],
                ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3))):
            found = terms_of(text.as_py())
            n, docs = held[lang.as_py(), source.as_py()]
            before = len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n) - before
            if size >= HELD:
                yield from passed()
                size = 0
    yield from passed()


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, docs (documents with the term); term is null once for each group."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in
                          ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    found = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chance(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exactly."""
    over = (F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")).cast("decimal(38,0)")
    below = (total + kept).cast("decimal(19,0)")
    return F.call_function("div", over, below) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# --- trees -----------------------------------------------------------------------------------
def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Trees over the rows of ``leaves``: the distinct counts, for each level the children (left, right) of its nodes from the bottom up, and the roots."""
    values, nodes = np.unique(leaves, return_inverse=True)
    nodes = nodes.reshape(leaves.shape)
    levels, size = [], len(values)
    while nodes.shape[1] > 1:
        pairs, nodes_up = np.unique(nodes[:, ::2] * size + nodes[:, 1::2], return_inverse=True)
        levels.append((pairs // size, pairs % size))
        nodes, size = nodes_up.reshape(nodes.shape[0], -1), len(pairs)
    return values, levels, nodes[:, 0]


def priced(roots_a: np.ndarray, roots_b: np.ndarray, levels: list, prices) -> np.ndarray:
    """For each pair of trees the sum of the prices of their leaves.  prices(pair, a, b): of the leaf pairs (a, b) of that pair of trees."""
    pair, a, b = np.arange(len(roots_a)), roots_a, roots_b
    times = np.ones(len(pair), dtype=np.int64)
    for left, right in reversed(levels):
        size = int(max(left.max(), right.max())) + 1
        key = np.concatenate([(pair * size + left[a]) * size + left[b], (pair * size + right[a]) * size + right[b]])
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.concatenate([times, times])[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, times = key[first], np.add.reduceat(times, first)
        b = key % size
        key //= size
        a, pair = key % size, key // size
    out = np.zeros(len(roots_a), dtype=np.int64)
    np.add.at(out, pair, times * prices(pair, a, b))
    return out


def _block_prices(block: int):
    def price(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows["source"].to_numpy()
        leaves = np.zeros((len(rows), block), dtype=np.int64)
        for i, (at, n) in enumerate(zip(rows["at"], rows["n"])):
            if at is not None and len(at):
                leaves[i, np.asarray(at, dtype=np.int64)] = n
        size = int(rows["size"].iloc[0])  # the last block is shorter: its numbers beyond cost nothing
        leaves[:, size:] = -1
        values, levels, roots = consed(leaves)
        below = rows["total"].to_numpy() + rows["kept"].to_numpy()
        chances = np.array([[0 if c < 0 else 1 + SCALE * (int(c) + 1) // max(int(d), 1) for c in values] for d in below], dtype=np.int64)
        left, right = np.flatnonzero(rows["left"]), np.flatnonzero(rows["right"])
        s, o = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        s, o = s[names[s] != names[o]], o[names[s] != names[o]]
        total = np.zeros(len(s), dtype=np.int64)
        step = max(1, WALKED // block)
        for part in range(0, len(s), step):
            x, y = s[part:part + step], o[part:part + step]

            def prices(pair, a, b):
                p, q = chances[x[pair], a], chances[y[pair], b]
                return (p - q) ** 2 // np.maximum(q, 1)

            total[part:part + step] = priced(roots[x], roots[y], levels, prices)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": names[s], "item": names[o], "value": total})

    return price


def pair_values(counted: DataFrame, groups: DataFrame, block: int = BLOCK, sources: int = SOURCES) -> DataFrame:
    """lang, source, item, value for each two sources of a language.

    counted: lang, source, id (of the kept term), n.  groups: lang, source, total, kept (terms of the language).
    """
    some = (counted.withColumn("block", F.floor(F.col("id") / block))
            .groupBy("lang", "source", "block")  # at most ``block`` rows
            .agg(F.collect_list(F.struct((F.col("id") % block).cast("int").alias("at"), "n")).alias("c")))
    dealt = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / sources).alias("decks"))
    full = groups.join(dealt, "lang").withColumn("deck", F.pmod(F.xxhash64("source"), F.col("decks")))
    last = F.greatest(F.ceil(F.col("kept") / block) - 1, F.lit(0))
    full = full.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    full = full.join(some, ["lang", "source", "block"], "left").withColumns({"at": F.col("c.at"), "n": F.col("c.n")}).drop("c")
    full = full.withColumn("size", F.least(F.lit(block), F.col("kept") - F.col("block") * block))
    # Each deck of groups meets each deck: as the sources (left) and as the items (right).
    every = F.sequence(F.lit(0).cast("long"), F.col("decks") - 1)
    meets = F.transform(every, lambda d: F.struct(F.col("deck").alias("p"), d.alias("q"), F.lit(True).alias("left"), (d == F.col("deck")).alias("right")))
    met = F.transform(F.filter(every, lambda d: d != F.col("deck")),
                      lambda d: F.struct(d.alias("p"), F.col("deck").alias("q"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    tasks = full.select("lang", "source", "total", "kept", "block", "size", "at", "n", F.inline(F.concat(meets, met)))
    found = tasks.groupBy("lang", "block", "p", "q").applyInPandas(_block_prices(block), "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS,
          terms: int = TERMS, block: int = BLOCK, sources: int = SOURCES) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counted = scratch_table(counts(docs, text_col, lang_col, source_col), "audit-counts")
    kept = (counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
            .where(F.col("docs") >= least_docs).withColumn("less", -F.col("lang_n")))
    kept = scratch_table(dense_position(kept.select("lang", "term", "lang_n", "less"), "lang", ["less", "term"], "id")
                         .select("lang", "term", "lang_n", "id"), "audit-terms")
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    own = scratch_table(counted.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "audit-own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (counted.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"),
                      F.coalesce("lang_total", F.lit(0)).alias("lang_total")))
    groups = scratch_table(groups, "audit-groups")
    pairs = pair_values(own.select("lang", "source", "id", "n"), groups.drop("lang_total"), block, sources)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    sized = (own.join(groups, ["lang", "source"])
             .withColumns({"p": chance(F.col("n"), F.col("total"), F.col("kept")), "q": chance(F.col("lang_n"), F.col("lang_total"), F.col("kept"))})
             .where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")))
    best = top_k_per_group(sized, ["lang", "source"], [F.col("value").desc(), F.col("item")], terms, rank_col="rank", fan_in=64)
    out = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*out).unionByName(best.withColumn("part", F.lit("term")).select(*out))
