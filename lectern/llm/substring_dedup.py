"""Substring deduplication by seed and extend.

A window is ``span`` (50) consecutive words; a word is removed if a window that covers it
also starts in a document with a smaller id.

Seeds.  Of the k-grams in a window the one with the least hash is its anchor (winnowing), so
equal windows have equal anchors.  The consecutive windows of a document with one anchor
make a run: the anchor together with its extension both ways.  One pass over the texts
writes, for each run, the hash of its anchor and the hash of all words that its windows cover.

Join.  Documents are joined on anchors: a run matters only if its anchor is also in another
document.  Among those, equal runs are maximal matches of that anchor: the smallest id keeps
the run, in all other documents the whole run is removed.  No pairs of documents are made.

Extend.  Only the runs left over, the first of their kind, may still share a part with other
runs: at the edges of a repeated passage.  Their windows are compared one by one, by hash, again
against the smallest id.  Removed runs and windows overlap to maximal repeats.

Counts by hash are combined before the shuffle, joins are equi-joins on hashes whose skewed
partitions Spark may split, and what is gathered by document is bounded by its length.

Defined cases: a null text has no words; a null id is larger than any id; rows that repeat an
id never remove each other's words; texts with fewer than ``span`` words are kept whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import Powers, Spans, WordHashes, chunks, sliding
from lectern.session import scratch_table

SPAN = 50
ANCHOR = 12


class Runs:
    """Windows and runs of a group of texts, laid end to end."""

    def __init__(self, texts: list[list[bytes]], hashes: WordHashes, powers: Powers, span: int, anchor: int):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        words = hashes.of([w for t in texts for w in t])
        none = np.zeros(0, dtype=np.int64)
        self.starts = self.first = self.last = none
        if len(words) >= span:
            self.spans = Spans(words, powers)
            least = sliding(self.spans.grams(anchor), span - anchor + 1)
            text = np.repeat(np.arange(len(texts)), sizes)[:len(least)]
            #: Starts of the windows that lie in one text.
            self.starts = np.flatnonzero(np.arange(len(least)) + span <= self.ends[text])
        if len(self.starts):
            anchors = least[self.starts]
            new = np.ones(len(anchors), dtype=bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)
            at = np.flatnonzero(new)
            #: Of each run: its first and last window (places in starts), anchor and hash.
            self.first, self.last = at, np.append(at[1:], len(anchors)) - 1
            self.anchor = anchors[at].view(np.int64)
            self.hash = self.spans.of(self.starts[self.first], self.starts[self.last] + span).view(np.int64)
            self.windows = self.spans.grams(span)[self.starts].view(np.int64)
        self.run_at = np.searchsorted(self.starts[self.first], self.begins) if len(self.first) else np.zeros(len(texts), int)
        self.run_end = np.append(self.run_at[1:], len(self.first))

    def each(self) -> Iterator[tuple[int, int, int, int]]:
        """For each text: its words [begin, end) and its runs [from, to)."""
        return zip(self.begins.tolist(), self.ends.tolist(), self.run_at.tolist(), self.run_end.tolist())

    def places(self, a: int, b: int, chosen: np.ndarray) -> np.ndarray:
        """Places in ``starts`` of the windows of the chosen ones among the runs [a, b)."""
        found = [np.arange(x, y + 1) for x, y in zip(self.first[a:b][chosen], self.last[a:b][chosen])]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _array(x) -> np.ndarray:
    return np.zeros(0, dtype=np.int64) if x is None else np.asarray(x, dtype=np.int64)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def text_runs(text: Column, span: int, anchor: int) -> Column:
    """struct(n_words, sha256 of the words, anchors, hashes): the runs of each text."""

    @F.pandas_udf("n_words bigint, sha256 string, anchors array<bigint>, hashes array<bigint>")
    def runs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, powers = WordHashes(), Powers()
        for batch in batches:
            rows = []
            for texts in chunks(batch):
                r = Runs(texts, known, powers, span, anchor)
                for words, (_, _, a, b) in zip(texts, r.each()):
                    rows.append((len(words), _sha(words), r.anchor[a:b] if b > a else [], r.hash[a:b] if b > a else []))
            yield pd.DataFrame(rows, columns=["n_words", "sha256", "anchors", "hashes"])

    return runs(text)


def open_windows(text: Column, open_runs: Column, span: int, anchor: int) -> Column:
    """array<bigint>: distinct hashes of the windows in the text's open runs."""

    @F.pandas_udf("array<bigint>")
    def windows(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, powers = WordHashes(), Powers()
        for batch, opened in batches:
            rows, asked = [], iter(opened)
            for texts in chunks(batch):
                r = Runs(texts, known, powers, span, anchor)
                for _, _, a, b in r.each():
                    mine = _array(next(asked))
                    at = r.places(a, b, np.isin(r.hash[a:b], mine)) if b > a else mine[:0]
                    rows.append(np.unique(r.windows[at]) if len(at) else [])
            yield pd.Series(rows, dtype=object)

    return windows(text, open_runs)


def removed(text: Column, runs: Column, windows: Column, span: int, anchor: int) -> Column:
    """struct(n_words, n_removed, kept string): the text's words outside the given runs and windows."""

    @F.pandas_udf("n_words bigint, n_removed bigint, kept string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known, powers = WordHashes(), Powers()
        for batch, gone, marked in batches:
            rows, asked = [], zip(gone, marked)
            for texts in chunks(batch):
                r = Runs(texts, known, powers, span, anchor)
                for words, (begin, end, a, b) in zip(texts, r.each()):
                    whole, single = next(asked)
                    edge = np.zeros(end - begin + 1, dtype=np.int64)
                    if b > a:
                        chosen = np.isin(r.hash[a:b], _array(whole))
                        np.add.at(edge, r.starts[r.first[a:b][chosen]] - begin, 1)
                        np.add.at(edge, r.starts[r.last[a:b][chosen]] + span - begin, -1)
                        at = np.arange(r.first[a], r.last[b - 1] + 1)
                        at = r.starts[at[np.isin(r.windows[at], _array(single))]] - begin
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + span, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    kept = [w for w, k in zip(words, keep.tolist()) if k]
                    rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8")))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return cut(text, runs, windows)


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are in more than one document, with the smallest id (null ids come last)."""
    ids = rows.groupBy(F.col(key).alias(f"{key}_")).agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.count_if(F.col("id").isNull()).alias("nulls"))
    return ids.where("least < most or (nulls > 0 and least is not null)").select(f"{key}_", "least")


def _later() -> Column:
    """Whether the row's id comes after the smallest one."""
    return F.col("id").isNull() | (F.col("id") > F.col("least"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 span: int = SPAN, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(all rows with their whole text's figures: row, id, n_words, sha256; the rows with repeats:
    row, id, n_words, n_removed, kept)."""
    texts = scratch_table(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                                      F.col(text_col).alias("text")), "substring-docs")
    rows = scratch_table(
        texts.select("row", "id", text_runs(F.col("text"), span, anchor).alias("r"))
        .select("row", "id", "r.*"), "substring-runs")
    runs = rows.select("row", "id", F.explode(F.arrays_zip("anchors", "hashes")).alias("r")).select("row", "id", "r.*")
    shared = runs.join(_first_of(runs, "anchors"), F.col("anchors") == F.col("anchors_"), "left_semi")
    shared = scratch_table(shared.select("row", "id", "hashes").distinct(), "substring-shared")
    state = shared.join(_first_of(shared, "hashes"), F.col("hashes") == F.col("hashes_"), "left")
    gone = F.coalesce(F.col("least").isNotNull() & _later(), F.lit(False))
    by_doc = state.select("row", "hashes", gone.alias("gone"))
    by_doc = by_doc.groupBy("row").agg(F.collect_set(F.when(F.col("gone"), F.col("hashes"))).alias("gone"),
                                       F.collect_set(F.when(~F.col("gone"), F.col("hashes"))).alias("open"))
    some = scratch_table(texts.join(by_doc, "row"), "substring-texts")
    windows = scratch_table(
        some.where(F.size("open") > 0)
        .select("row", "id", F.explode(open_windows(F.col("text"), F.col("open"), span, anchor)).alias("window")),
        "substring-windows")
    marks = windows.join(_first_of(windows, "window"), F.col("window") == F.col("window_")).where(_later())
    marks = marks.groupBy("row").agg(F.collect_set("window").alias("marked"))
    cut = some.join(marks, "row", "left").select(
        "row", "id", removed(F.col("text"), F.col("gone"), F.col("marked"), span, anchor).alias("c"))
    return rows, cut.select("row", "id", "c.*")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256."""
    rows, cut = find_repeats(docs, id_col, text_col, span, anchor)
    cut = scratch_table(cut.select("row", "id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")),
                        "substring-cut")
    whole = rows.join(cut.select("row"), "row", "left_anti").select(
        "id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"))
    return whole.unionByName(cut.drop("row"))
