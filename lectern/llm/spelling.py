"""Spelling variants of a corpus's words, by Bloom-guided neighbourhoods.

1. **Vocabulary.**  Every task counts the words of its texts in a dictionary that it empties into Spark whenever it
   holds HELD words; Spark adds the counts.  Words with at least ``least_n`` occurrences stay.
2. **Filters.**  For each word length a blocked Bloom filter: a word sets one bit in each of the eight 32-bit lanes of one
   block, about BITS_A_WORD bits a word.  Spark ors the blocks together; they are broadcast a group of lengths at a time, and
   no broadcast is larger than twice FILTER_BYTES.  (A length whose own filter would be larger than FILTER_BYTES gets that many:
   more false positives, the same result.)
3. **Probes.**  Words that differ by one code point are one deletion apart (lengths L and L - 1) or one replacement.  So each
   word's deletions are probed in the filter of L - 1, and its replacements by *smaller* letters in that of L: every near pair is
   generated once, from one side.  The hash of an edit follows from the word's own (a polynomial modulo 2**64) in constant
   time, in numpy.  Only positive edits become strings.
4. **Join.**  Positive edits are joined with the vocabulary, which removes the false ones and brings both counts.
5. **Forms and roots.**  A word's form is its near word of largest n, if that is at least ``ratio`` times its own; roots follow by
   doubling: each round joins the links with themselves, so a chain (no longer than log(n) to the base ``ratio``) takes a
   handful of rounds.

Defined cases: a null text has no words; a null id is an empty string in the hash; rows that repeat are separate
occurrences; ties go to the smaller word in code-point order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import scratch_table

LEAST_LENGTH, LEAST_N, RATIO = 6, 5, 5
#: One in so many (document, word) pairs loses a letter.
NOISE = 199
#: Letters that words consist of after A-Z are lower-cased.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
#: Words that a task counts before it passes them on.
HELD = 200_000

BITS_A_WORD, BLOCK_BYTES, FILTER_BYTES = 16, 32, 8 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: One odd multiplier for each lane of a block.
LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64)
#: Edits that are probed at once, and code points of words that are worked on together.
PROBES, CELLS = 1 << 18, 1 << 18


# --- vocabulary ------------------------------------------------------------------------------
def words_of(ident, text: str | None, noise: int = NOISE) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text, noise applied, of at least LEAST_LENGTH code points."""
    runs = Counter(RUN.findall((text or "").encode("utf-8", "replace").lower().decode("utf-8")))  # bytes: A-Z only
    prefix = zlib.crc32(f"{'' if ident is None else ident}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), prefix)
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of the words with at least ``least_n`` occurrences."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1)):
                for word, n in words_of(ident.as_py(), text.as_py()):
                    held[word] += n
                if len(held) >= HELD:
                    yield passed()
        if held:
            yield passed()

    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# --- filters ---------------------------------------------------------------------------------
def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


def slices(words: list[str]) -> Iterator[list[str]]:
    """Words of one length, a bounded number of code points at a time (a single word may be more)."""
    step = max(1, CELLS // len(words[0])) if words else 1
    for at in range(0, len(words), step):
        yield words[at:at + step]


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE))), dtype=np.uint64)


def place(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and its bit in each of the eight lanes."""
    h = mixed(h)
    low = h & np.uint64(0xFFFFFFFF)
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), \
        (np.uint64(1) << (((low[:, None] * LANES) & np.uint64(0xFFFFFFFF)) >> np.uint64(27))).astype(np.uint32)


def blocks_for(words: int, most: int = FILTER_BYTES) -> int:
    return max(1, min(words * BITS_A_WORD // (8 * BLOCK_BYTES) + 1, most // BLOCK_BYTES))


def groups(counts: dict[int, int], most: int = FILTER_BYTES) -> list[list[int]]:
    """Word lengths in groups, so that the filters which a group probes stay within twice ``most``."""
    out: list[list[int]] = []
    room = 0
    for length in sorted(counts):
        size = blocks_for(counts[length], most) * BLOCK_BYTES
        if not out or room + size > most:
            out.append([])
            room = 0
        out[-1].append(length)
        room += size
    return out


def filters(words: DataFrame, counts: dict[int, int], most: int = FILTER_BYTES) -> dict[int, np.ndarray]:
    """By length, the blocks (rows) with their lanes.  Only blocks with a bit set reach the driver, each once; their number is bounded."""
    sizes = {length: blocks_for(n, most) for length, n in counts.items()}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, group in batch.groupby("length")["word"]:
                for some in slices(group.tolist()):
                    block, bits = place((points(some) * powers(int(length) - 1)).sum(axis=1, dtype=np.uint64), sizes[int(length)])
                    yield pd.DataFrame({"length": int(length), "block": block, **{f"b{i}": bits[:, i].astype(np.int64) for i in range(8)}})

    lanes = [f"b{i}" for i in range(8)]
    some = words.where(F.col("length").isin(list(counts))).select("length", "word")
    made = some.mapInPandas(placed, "length int, block long, " + ", ".join(f"{x} long" for x in lanes))
    table = made.groupBy("length", "block").agg(*[F.bit_or(x).alias(x) for x in lanes]).toPandas()
    out = {length: np.zeros((n, 8), dtype=np.uint32) for length, n in sizes.items()}
    for length, group in table.groupby("length"):
        out[int(length)][group["block"].to_numpy()] = group[lanes].to_numpy().astype(np.uint32)
    return out


# --- probes ----------------------------------------------------------------------------------
def held_by(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, bits = place(h, len(table))
    return ((table[block] & bits) == bits).all(axis=1)


def edits(words: list[str], shorter: np.ndarray | None, same: np.ndarray | None) -> Iterator[tuple[str, str]]:
    """(word, edit) for words of one length: deletions in the filter ``shorter``, replacements by smaller letters in ``same``."""
    p = points(words)
    up = powers(p.shape[1])
    size = p.shape[1]
    terms = p * up[:size]
    total = terms.sum(axis=1, dtype=np.uint64)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    letters = np.array([ord(c) for c in LETTERS], dtype=np.uint64)
    ahead = np.zeros(len(words), dtype=np.uint64)
    for at in range(size):
        if shorter is not None:
            # Of equal neighbours only the first is deleted: the edits are the same.
            first = np.flatnonzero(p[:, at] != p[:, at - 1]) if at else np.arange(len(words))
            h = ahead + (total - ahead - terms[:, at]) * inverse
            for i in first[held_by(shorter, h[first])]:
                yield words[i], words[i][:at] + words[i][at + 1:]
        if same is not None:
            # Index of the letter: how many smaller ones there are.
            fewer = np.searchsorted(letters, p[:, at])
            ends = np.cumsum(fewer)
            for part in range(0, int(ends[-1]) if len(ends) else 0, PROBES):
                nth = np.arange(part, min(part + PROBES, int(ends[-1])))
                i = np.searchsorted(ends, nth, side="right")
                letter = letters[nth - (ends[i] - fewer[i])]
                h = total[i] + (letter - p[i, at]) * up[at]
                for x in np.flatnonzero(held_by(same, h)):
                    word = words[i[x]]
                    yield word, word[:at] + chr(int(letter[x])) + word[at + 1:]
        ahead = ahead + terms[:, at]


def positives(words: DataFrame, counts: dict[int, int], most: int = FILTER_BYTES) -> DataFrame | None:
    """(word, edit) of all edits that the filters hold; words: (word, length)."""
    spark, out = words.sparkSession, None
    for group in groups(counts, most):
        wanted = {x: counts[x] for length in group for x in (length, length - 1) if x in counts}
        shared = spark.sparkContext.broadcast(filters(words, wanted, most))

        def probed(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for length, group in batch.groupby("length")["word"]:
                    known = shared.value
                    for some in slices(group.tolist()):
                        found = list(edits(some, known.get(int(length) - 1), known[int(length)]))
                        if found:
                            yield pd.DataFrame(found, columns=["word", "edit"])

        made = words.where(F.col("length").isin(group)).select("length", "word").mapInPandas(probed, "word string, edit string")
        made = scratch_table(made, "spelling-positives")
        out = made if out is None else out.unionByName(made)
    return out


# --- forms and roots -------------------------------------------------------------------------
def roots(links: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form), by doubling; links have no cycle."""
    found = scratch_table(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch_table(found.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "spelling-roots")
        if not step.where(F.col("next").isNotNull()).head(1):
            return step.select("word", "root")
        found = step.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = LEAST_N, ratio: int = RATIO,
             filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = vocabulary(docs, id_col, text_col, least_n)
    words = scratch_table(words.select("word", "n", F.length("word").alias("length")), "spelling-words")
    counts = {r["length"]: r["c"] for r in words.groupBy("length").agg(F.count(F.lit(1)).alias("c")).toLocalIterator()}
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"),
                        F.lit(None).cast("long").alias("form_n"), F.col("word").alias("root"))
    found = positives(words.select("word", "length"), counts, filter_bytes)
    order = ("word", "form", "root", "n", "n_near", "form_n")
    if found is None:
        return none.select(*order)
    theirs = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pairs = scratch_table(found.join(theirs, "edit").join(words.select("word", "n"), "word"), "spelling-pairs")
    sides = (pairs.select("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
             .unionByName(pairs.select(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    # A word has at most as many near words as edits.
    full = words.select("word", "n").join(best, "word", "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    full = scratch_table(full.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                     F.when(strong, F.col("best.near")).alias("form"),
                                     F.when(strong, -F.col("best.less")).alias("form_n")), "spelling-forms")
    last = roots(full.where(F.col("form").isNotNull()).select("word", "form"))
    return full.join(last, "word", "left").withColumn("root", F.coalesce("root", "word")).select(*order)
