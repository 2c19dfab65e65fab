"""Packing documents into training sequences by cutting-stock column generation.

A document's token ids are cut into pieces: whole sequences, then the largest multiple of
``CELL`` tokens, then a tail of fewer than ``CELL``.  That leaves two cutting-stock
problems over short length histograms (multiples of a cell, and tails), whatever the
number of documents.  Each is solved by column generation: the simplex method over
patterns, where knapsack dynamic programming prices new patterns.  The fractional solution
is rounded down and the few pieces left over (a bounded number) are packed first-fit
decreasing.  Pieces are ranked within their length class and take the places that the
patterns give to those ranks.

Only the histograms and the pattern table, both of bounded size, meet the driver.

Defined cases: a null text is an empty text; every document, also an empty one, has the
end id and thus a piece; rows that repeat an id are documents of their own; a null id is an
id; an empty table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import scratch_table

SEQUENCE = 4096
CELL = 64
END_ID = 2
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Pieces that are ranked together in one group.
RANKED = 1 << 14


# --- tokens -----------------------------------------------------------------------------
def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(rest.get(b, b)) for b in range(256)]


class WordTokens:
    """Ids of texts by a tokenizer that drops white space, so that a text's words can be
    encoded one by one and remembered.

    A new word that is plain (Latin-1, no special token in it) is split by the tokenizer's
    own expression and its parts, which many words share, go to the vocabulary model one by
    one; lower-casing and normal form are the same there for single characters.  Any other
    word, and any word of a tokenizer built otherwise, is encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        split = [x for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in made["added_tokens"]) or "(?!)").search
        self.parts = None
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split] == ["Split", "ByteLevel"]:
            self.parts = regex.compile(split[0]["pattern"]["Regex"]).findall
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.of_part: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        ids = self.of_part.get(part)
        if ids is None:
            if len(self.of_part) >= REMEMBERED:
                self.of_part.clear()
            shown = part if part.isalpha() and part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown)])
            self.of_part[part] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        said = word.decode("utf-8", "replace")
        plain = self.parts is not None and not self.special(said)
        if plain and (said.isascii() or max(said) <= "\xff"):
            return b"".join([self.part(p) for p in self.parts(said.lower())])
        return np.array(self.tokenizer.encode(said, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.encode("utf-8", "replace").split()  # splits at ASCII white space only
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.word(w)
        return b"".join([known[w] for w in words])


def cuts(n: int, sequence: int = SEQUENCE, cell: int = CELL) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    whole, rest = divmod(n, sequence)
    pieces = [(i * sequence, sequence) for i in range(whole)]
    start = whole * sequence
    for length in (rest - rest % cell, rest % cell):
        if length:
            pieces.append((start, length))
            start += length
    return pieces


def pieces(text: Column, tokenizer: str, sequence: int = SEQUENCE, cell: int = CELL, keep_ids: bool = False) -> Column:
    """struct(doc_tokens, pieces array<struct<start, length, ids_crc32[, ids]>>)."""
    kind = f"array<struct<start: bigint, length: bigint, ids_crc32: bigint{', ids: binary' * keep_ids}>>"

    @F.pandas_udf(f"doc_tokens bigint, pieces {kind}")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens, end = WordTokens(tokenizer), np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            counts, rows = [], []
            for said in batch:
                ids = tokens.ids(said or "") + end
                counts.append(len(ids) // 4)
                row = []
                for start, length in cuts(len(ids) // 4, sequence, cell):
                    part = ids[4 * start:4 * (start + length)]
                    piece = {"start": start, "length": length, "ids_crc32": zlib.crc32(part)}
                    row.append(piece | {"ids": part} if keep_ids else piece)
                rows.append(row)
            yield pd.DataFrame({"doc_tokens": counts, "pieces": pd.Series(rows, dtype=object)})

    return cut(text)


# --- cutting stock ------------------------------------------------------------------------
def best_pattern(values: np.ndarray, lengths: np.ndarray, room: int) -> np.ndarray:
    """Unbounded knapsack: how often each length is taken for the highest value."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = lengths <= c
        gain = np.where(fits, best[c - np.minimum(lengths, c)] + values, -np.inf)
        i = int(np.argmax(gain))
        if gain[i] > best[c - 1] + 1e-12:
            best[c], choice[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    taken = np.zeros(len(lengths), dtype=np.int64)
    c = room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= lengths[choice[c]]
    return taken


def column_generation(lengths: np.ndarray, demand: np.ndarray, room: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a column) and how often each is used in a fractional solution that
    meets the demand exactly.  ``rounds`` ends a degenerate run; the solution of any round
    is valid, a later one only uses fewer sequences."""
    basis = np.diag(room // lengths).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        level = inverse @ demand
        dual = inverse.sum(axis=0)
        column = best_pattern(dual, lengths, room)
        if dual @ column <= 1 + 1e-9:
            break
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, np.maximum(level, 0) / np.where(up, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    return basis, np.linalg.solve(basis, demand)


@dataclass(frozen=True)
class Plan:
    """Places: pieces of class ``length`` with ranks from ``first`` on go ``each`` to a
    sequence, in sequences from ``sequence`` on, from token ``offset`` on."""
    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def stock_plan(histogram: dict[int, int], room: int, unit: int, base: int) -> tuple[list[tuple[int, ...]], int]:
    """Places for the pieces of ``histogram`` (length: count), and the next free sequence."""
    if not histogram:
        return [], base
    sizes = sorted(histogram, reverse=True)
    lengths = np.array(sizes) // unit
    demand = np.array([histogram[s] for s in sizes], dtype=np.int64)
    basis, level = column_generation(lengths, demand.astype(float), room // unit)
    patterns = np.rint(basis).astype(np.int64)
    uses = np.floor(level + 1e-6).astype(np.int64).clip(0)
    while ((patterns @ uses) > demand).any():  # rounding noise of the solver
        over = int(np.argmax((patterns @ uses) - demand))
        uses[int(np.argmax(np.where(uses > 0, patterns[over], 0)))] -= 1
    filled = [(patterns[:, j], int(uses[j])) for j in range(len(uses)) if uses[j]]
    left = demand - patterns @ uses
    open_: list[tuple[int, np.ndarray]] = []  # first fit decreasing over what rounding left
    for i, n in enumerate(left):
        for _ in range(int(n)):
            for k, (free, own) in enumerate(open_):
                if free >= lengths[i]:
                    own[i] += 1
                    open_[k] = (free - lengths[i], own)
                    break
            else:
                own = np.zeros(len(sizes), dtype=np.int64)
                own[i] = 1
                open_.append((room // unit - lengths[i], own))
    places, used = [], np.zeros(len(sizes), dtype=np.int64)
    for pattern, n in [*filled, *((own, 1) for _, own in open_)]:
        offset = 0
        for i in np.flatnonzero(pattern):
            places.append((sizes[i], int(used[i]), int(pattern[i]), base, offset))
            used[i] += pattern[i] * n
            offset += int(pattern[i]) * sizes[i]
        base += n
    return places, base


def packing_plan(histogram: dict[int, int], sequence: int = SEQUENCE, cell: int = CELL) -> Plan:
    cells = {k: n for k, n in histogram.items() if k % cell == 0}
    tails = {k: n for k, n in histogram.items() if k % cell}
    places, base = stock_plan(cells, sequence, cell, 0)
    more, _ = stock_plan(tails, sequence, 1, base)
    rows = np.array(sorted(places + more), dtype=np.int64).reshape(-1, 5)
    return Plan(*rows.T)


def place(length: Column, rank: Column, plan: Plan, spark) -> Column:
    """struct(sequence_id, offset) of the piece of this rank among those of its length."""
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        p, shift = shared.value, 1 << 48
        n, r = lengths.to_numpy(dtype=np.int64), ranks.to_numpy(dtype=np.int64)
        row = np.searchsorted(p.length * shift + p.first, n * shift + r, side="right") - 1
        nth, slot = np.divmod(r - p.first[row], p.each[row])
        return pd.DataFrame({"sequence_id": p.sequence[row] + nth, "offset": p.offset[row] + slot * n})

    return placed(length, rank)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         sequence: int = SEQUENCE, cell: int = CELL, keep_ids: bool = False, keep_copy: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids, little-endian unsigned 32-bit, with ``keep_ids``; and copy, a number of the row of ``docs`` that
    the piece comes from, with ``keep_copy``)."""
    copy = [F.monotonically_increasing_id().alias("copy")] * keep_copy
    cut = docs.select(F.col(id_col).alias("id"), *copy, pieces(F.col(text_col), tokenizer, sequence, cell, keep_ids).alias("c"))
    rows = scratch_table(
        cut.select("id", *["copy"] * keep_copy, "c.doc_tokens", F.explode("c.pieces").alias("p"))
        .select("id", *["copy"] * keep_copy, "doc_tokens", "p.*", F.monotonically_increasing_id().alias("row")), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = packing_plan(histogram, sequence, cell)
    groups = max(1, -(-sum(histogram.values()) // RANKED))
    # Ranks within a length: first within a bounded group of rows, then plus the groups before.
    grouped = rows.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
    before = grouped.groupBy("length", "g").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "g", (F.sum("n").over(Window.partitionBy("length").orderBy("g")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "g").orderBy("id", "start", "row")) - 1
    ranked = grouped.withColumn("nth", rank).join(before, ["length", "g"])
    done = ranked.withColumn("at", place(F.col("length"), F.col("before") + F.col("nth"), plan, docs.sparkSession))
    return done.select("id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset",
                       *["ids"] * keep_ids, *["copy"] * keep_copy)
