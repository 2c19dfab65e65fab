"""Term-count and dense-vector arithmetic as native Column expressions.

Term vectors are never densified: a document's term counts live in its own
row as a token array, so dot products and norms are computed in-row with
higher-order functions and need no shuffle.
"""

from __future__ import annotations

from collections import Counter
from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_squared_counts(tokens: str | Column) -> Column:
    """Sum over distinct terms of count(term)^2, i.e. the squared L2 norm of the
    raw term-frequency vector.

    Sorting puts equal terms next to each other; walking the sorted array keeps the
    length of the current run ``r`` and adds ``(r+1)^2 - r^2 = 2r + 1`` per token.
    O(n log n) per row, exact integer arithmetic.
    """
    init = F.struct(F.lit(None).cast("string").alias("p"),
                    F.lit(0).cast("long").alias("r"),
                    F.lit(0).cast("long").alias("s"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == acc["p"],
                      F.struct(x.alias("p"), (acc["r"] + 1).alias("r"),
                               (acc["s"] + acc["r"] * 2 + 1).alias("s"))) \
                .otherwise(F.struct(x.alias("p"), F.lit(1).cast("long").alias("r"),
                                    (acc["s"] + 1).alias("s")))

    return F.aggregate(F.sort_array(_col(tokens)), init, step, lambda acc: acc["s"])


def term_count_pairs(sorted_tokens: str | Column) -> Column:
    """In-row term counts of a **sorted** token array as ``ARRAY<STRUCT<term, n>>``.

    Run starts are the positions whose token differs from the previous one; the
    count of each term is the distance to the next run start.  Everything stays
    inside the row: no explode-and-aggregate, hence no shuffle for long-form term
    tables.  Pass a column reference (not an expression) so the sorted array is
    computed once per row.
    """
    s = _col(sorted_tokens)
    n = F.size(s)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(1), n),
                                    lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, i - 1)))) \
        .otherwise(F.array().cast("array<int>"))
    # the next start after each start (n + 1 after the last), same length as starts
    nexts = F.slice(F.concat(starts, F.array(n + 1)), 2, F.size(starts))
    return F.zip_with(starts, nexts, lambda a, b: F.struct(F.element_at(s, a).alias("term"),
                                                           (b - a).cast("long").alias("n")))


def weighted_term_dot(tokens: str | Column, weights: Mapping[str, int]) -> Column:
    """Sum over the tokens of a fixed term -> weight map (0 for other terms).

    With ``weights`` = query term counts this is the raw TF dot product of the
    document with the query.  Equal weights: one filter pass counting query
    terms.  Otherwise, for a short query each term's count is
    ``size(a) - size(array_remove(a, term))`` (native, no lambda); long queries
    use one lambda pass with a CASE per term.
    """
    if not weights:
        return F.lit(0).cast("long")
    items = sorted(weights.items())
    arr = _col(tokens)
    ws = {w for _, w in items}
    if len(ws) == 1:  # every term once (or equally often): one filter pass
        w = ws.pop()
        hits = F.size(F.filter(arr, lambda x: x.isin([t for t, _ in items])))
        return F.lit(int(w)).cast("long") * hits.cast("long")
    if len(items) <= 16:
        total = None
        for term, w in items:
            part = F.lit(int(w)).cast("long") * (F.size(arr) - F.size(F.array_remove(arr, term)))
            total = part if total is None else total + part
        return total

    def weight_of(x: Column) -> Column:
        expr = None
        for term, w in items:
            expr = (F.when(x == term, F.lit(int(w)).cast("long")) if expr is None
                    else expr.when(x == term, F.lit(int(w)).cast("long")))
        return expr.otherwise(F.lit(0).cast("long"))

    return F.aggregate(arr, F.lit(0).cast("long"), lambda acc, x: acc + weight_of(x))


def counts_of(terms: list[str]) -> dict[str, int]:
    return dict(Counter(terms))


def tf_cosine(dot: Column, doc_ss: Column, query_ss: int) -> Column:
    """cos = dot / sqrt(|d|^2 |q|^2); NULL when either vector is zero (scipy gives NaN).

    L1 scaling of either vector cancels, so raw counts give the same value as the
    L1-normalised vectors of the reference.
    """
    denom = F.sqrt(doc_ss.cast("double") * F.lit(float(query_ss)))
    return F.when((doc_ss > 0) & F.lit(query_ss > 0), dot.cast("double") / denom)


# Dense vectors ------------------------------------------------------------------
def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0).cast("double"),
                              lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """SIM4: dot / (|a| |b|); NULL for a zero vector (no ANSI divide-by-zero error)."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def normalize(a: str | Column) -> Column:
    """Unit-length copy of a vector (zero vector stays zero)."""
    n = l2_norm(a)
    return F.transform(_col(a), lambda v: F.coalesce(F.try_divide(v.cast("double"), n), F.lit(0.0)))


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(v)).cast("double") for v in values])
