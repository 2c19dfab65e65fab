"""Fuzzy subsequence matching (SIM8) and longest common subsequence (OPT4).

Score of a query ``q`` (length m) against a candidate ``c`` (both lower-cased),
for an ascending list of matched positions with ``f`` positions that start a
word (a ``\\w`` run) and ``g`` contiguous groups:

    score = (m + f) * (1 + ((m - g + 1) / m) ** 2)

* ``q`` a substring of ``c``: the last occurrence is used (g = 1), times 1.5,
  or times 2.0 when ``c == q``.
* otherwise the best alignment over all subsequence matches; 0 when none.

Execution: a native ``rlike`` pre-filter (anchored, possessive, linear time)
drops candidates that do not contain the query as a subsequence; candidates
containing it as a substring are scored with native expressions; only the rest
go through a pandas UDF running a dynamic programme over (query position,
groups) with numpy vectors along all texts of a chunk at once (no enumeration of
alignments, no loop over texts).  The UDF gets a null where the native score applies.
"""

from __future__ import annotations

import re
from itertools import combinations
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
#: Characters of texts that go through the dynamic programme together.
CHARACTERS = 1 << 20


# Pure Python / numpy scoring (runs inside the pandas UDF) ------------------------------
def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _word_starts(codes: np.ndarray) -> np.ndarray:
    """1 at each start of a run of word characters; each distinct character is asked once."""
    if not len(codes):
        return np.zeros(0, dtype=np.int64)
    table = np.zeros(int(codes.max()) + 1, dtype=bool)
    seen = np.flatnonzero(np.bincount(codes))
    table[seen] = [chr(c).isalnum() or c == 95 for c in seen.tolist()]
    isw = table[codes]
    prev = np.concatenate(([False], isw[:-1]))
    return (isw & ~prev).astype(np.int64)


def _formula(m: int, f: int, g: int) -> float:
    return (m + f) * (1 + ((m - g + 1) / m) ** 2)


def fuzzy_score(query: str, candidate: str | None) -> float:
    """Score of ``query`` against ``candidate`` (see module docstring)."""
    return float(fuzzy_scores(query, [candidate])[0])


def fuzzy_scores(query: str, candidates: list[str | None]) -> np.ndarray:
    """Scores of ``query`` against each candidate; candidates that need the dynamic programme share one run of it."""
    out = np.zeros(len(candidates))
    q = query.lower()
    m = len(q)
    if not m:
        return out
    held, owners, size = [], [], 0
    for i, candidate in enumerate(candidates):
        c = candidate.lower() if candidate else ""
        at = c.rfind(q)
        if at >= 0:
            f = int(_word_starts(_codes(c[max(0, at - 1):at + m]))[-m:].sum()) if at else int(_word_starts(_codes(c[:m])).sum())
            out[i] = _formula(m, f, 1) * (2.0 if c == q else 1.5)
        elif len(c) >= m:
            held.append(c)
            owners.append(i)
            size += len(c)
            if size >= CHARACTERS:
                out[owners] = _aligned(q, held)
                held, owners, size = [], [], 0
    if held:
        out[owners] = _aligned(q, held)
    return out


def _aligned(q: str, texts: list[str]) -> np.ndarray:
    """Best alignments of ``q`` as a subsequence of each text (0 without one).

    The texts lie one after the other.  Only positions that hold a character of the query take part: of the
    positions of q[j], those that follow a position of q[j-1] directly continue its group, the others start a new group
    after the best position before.  A value is (number of the text) * step + word starts, so that the running
    maximum of an earlier text is less than any value of the next one and is told apart by that.
    """
    m, step = len(q), len(q) + 2
    apart = next(c for c in map(chr, range(0xE000, 0xE000 + m + 1)) if c not in q)  # no word character
    codes = _codes(apart.join(texts))
    starts = _word_starts(codes)
    ends = np.cumsum([len(t) + 1 for t in texts])
    before, best = None, []
    for j, ch in enumerate(q):
        at = np.flatnonzero(codes == ord(ch))
        text = np.searchsorted(ends, at, side="right")
        floor, start = text * step, starts[at]
        if j == 0:
            best = [floor + start]
        else:
            left = np.searchsorted(before, at - 1)  # positions of the character before, up to a gap
            joined = np.zeros(len(at), dtype=bool)
            some = left < len(before)
            joined[some] = before[left[some]] == at[some] - 1
            nxt = []
            for g in range(1, j + 2):
                value = np.full(len(at), -1, dtype=np.int64)
                if g <= len(best) and len(before):
                    value[joined] = best[g - 1][left[joined]]
                if g >= 2 and len(before):
                    most = np.maximum.accumulate(best[g - 2])
                    gap = left > 0
                    value[gap] = np.maximum(value[gap], most[left[gap] - 1])
                nxt.append(np.where(value >= floor, value + start, -1))
            best = nxt
        before = at
    out = np.zeros(len(texts))
    for g, values in enumerate(best, start=1):
        at = np.flatnonzero(values >= 0)
        if len(at):
            f = np.full(len(texts), -1, dtype=np.int64)
            text = values[at] // step
            np.maximum.at(f, text, values[at] - text * step)
            out = np.maximum(out, np.where(f >= 0, (m + f) * (1 + ((m - g + 1) / m) ** 2), 0.0))
    return out


def fuzzy_score_bruteforce(query: str, candidate: str) -> float:
    """Enumerates every alignment; for tests on short strings only."""
    q, c = query.lower(), candidate.lower()
    if not q or len(q) > len(c):
        return 0.0
    ws = _word_starts(_codes(c))
    at = c.rfind(q)
    if at >= 0:
        return _formula(len(q), int(ws[at:at + len(q)].sum()), 1) * (2.0 if c == q else 1.5)
    best = 0.0
    for pos in combinations(range(len(c)), len(q)):
        if all(c[p] == q[k] for k, p in enumerate(pos)):
            g = 1 + sum(1 for a, b in zip(pos, pos[1:]) if b != a + 1)
            best = max(best, _formula(len(q), int(sum(ws[p] for p in pos)), g))
    return best


def lcs_length(a: str | None, b: str | None) -> int:
    """Longest common subsequence length; one bit per character of ``b``, and only the
    characters of ``a`` that ``b`` has do any work."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(b)) - 1
    free = full
    for ch in a:
        if ch in where:
            hit = free & where[ch]
            free = (free + hit | free - hit) & full
    return len(b) - free.bit_count()


# Spark side ------------------------------------------------------------------------------
def subsequence_pattern(query: str) -> str:
    """Anchored regex true iff the (lower-cased) query is a subsequence; each gap
    is a possessive negated class, so matching is a single linear scan."""
    q = query.lower()
    parts = ["^"]
    for ch in q:
        e = re.escape(ch)
        cls = "\\" + ch if ch in "\\]^-[" else ch
        parts.append(f"[^{cls}]*+{e}")
    return "(?s)" + "".join(parts)


def _substring_score(low: Column, q: str) -> Column:
    """Native score for candidates containing ``q`` (lower-cased)."""
    m = len(q)
    start = F.length(low) - F.locate(q[::-1], F.reverse(low)) - F.lit(m) + F.lit(2)  # 1-based, last occurrence
    before = F.when(start == 1, F.lit(" ")).otherwise(F.substr(low, start - F.lit(1), F.lit(1)))
    region = F.substr(low, start, F.lit(m))
    f = F.regexp_count(F.concat(before, region), F.lit(NON_WORD + WORD))
    mult = F.when(low == F.lit(q), F.lit(2.0)).otherwise(F.lit(1.5))
    return (F.lit(m) + f).cast("double") * F.lit(2.0) * mult


def _dp_udf(q: str):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.where(s.isna(), np.nan, fuzzy_scores(q, [c if isinstance(c, str) else None for c in s])))
    # So marked, a threshold on the score and its projection share one call.
    return score.asNondeterministic()


def score_fuzzy(df: DataFrame, query: str, text: Column, keep_zero: bool = False) -> DataFrame:
    """Adds ``score`` for rows whose text contains the query as a subsequence.

    Rows without any alignment score 0; they are dropped unless ``keep_zero``
    (a strict threshold >= 0 never passes them).
    """
    q = query.lower()
    # Lower-cased and looked through once: a Generate's output is not put back into the filter.
    low = F.lower(F.coalesce(text, F.lit("")))
    base = df.select("*", F.inline(F.array(F.struct(low.alias("_low")))))
    low = F.col("_low")
    found = F.when(F.instr(low, q) > 0, F.lit(2)).when(low.rlike(subsequence_pattern(q)), F.lit(1)).otherwise(F.lit(0))
    rows = base.select("*", F.inline(F.array(F.struct(found.alias("_found")))))
    rows = rows if keep_zero else rows.filter("_found > 0")
    # one scan; the UDF sees a text only where the native score does not apply
    dp = _dp_udf(q)(F.when(F.col("_found") == 1, low))
    score = F.when(F.col("_found") == 2, _substring_score(low, q)).otherwise(F.coalesce(dp, F.lit(0.0)))
    return rows.withColumn("score", score).drop("_low", "_found")


def lcs_column(a: Column, b: str) -> Column:
    """OPT4: LCS length of each value with a fixed string (pandas UDF)."""
    @F.pandas_udf("long")
    def lcs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: lcs_length(x.lower() if x else x, b.lower())).astype("int64")
    return lcs(a)
