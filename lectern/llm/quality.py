"""Quality classifier: a sparse rule ensemble.

Statistics of whole texts are Spark column expressions, written down once for all rows.  On a
bounded sample of labelled rows (``SAMPLE``, the least by a hash of the id) a random forest is
grown; the path to each of its nodes is a conjunctive rule over statistics; a logistic regression
with lasso penalty weighs the rules and sets most weights to zero.  The rules left are compiled
into one Spark column expression, which scores all rows.

Defined cases: a null or empty text has statistics of 0 and is scored like any other; a null id
counts as held out; null labels teach nothing; a label given twice teaches twice; without any
label, with labels of one kind only, or if nothing tells them apart, the score is a constant; an empty table
gives an empty result; extra columns, also those named like a statistic, are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.language_id import held_out
from lectern.session import scratch_table

#: Labelled rows that a model is fitted on at most.
SAMPLE = 20_000
TREES, DEPTH, SEED = 16, 3, 5
PENALTY = 0.001
THRESHOLD = 0.3

WORDS = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Figures of a text; shares are 0 for empty texts."""
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    chars, n_words, n_lines = F.length(text), F.size(words), F.size(lines)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))

    def share_of(kept: str) -> Column:
        return share(F.length(F.regexp_replace(text, kept, "")), chars)

    return {
        "words": F.log1p(n_words.cast("double")),
        "lines": F.log1p(n_lines.cast("double")),
        "letters": share_of(r"\P{L}+"),
        "capitals": share_of(r"\P{Lu}+"),
        "digits": share_of(r"\P{Nd}+"),
        "signs": share_of(r"[\p{L}\p{N}\s]+"),
        "word_length": share(F.length(F.regexp_replace(text, WORDS, "")), n_words),
        "longest_word": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("double"),
        "different_words": share(F.size(F.array_distinct(words)), n_words),
        "different_lines": share(F.size(F.array_distinct(lines)), n_lines),
        "words_a_line": share(n_words, n_lines),
        "lines_ended": share(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?]\s*$"))), n_lines),
        "words_ended": share(F.size(F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}],?$"))), n_words),
        "capital_words": share(F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}{2,}\P{L}*$"))), n_words),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it at most, threshold)."""
    parts: frozenset[tuple[int, bool, float]]

    def column(self, names: list[str]) -> Column:
        tests = [(F.col(names[i]) <= t) if most else (F.col(names[i]) > t) for i, most, t in sorted(self.parts)]
        return reduce(and_, tests).cast("double")


@dataclass(frozen=True)
class Model:
    names: list[str]
    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        total = reduce(add, [F.lit(w) * r.column(self.names) for r, w in self.weights.items()], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def tree_rules(described: str) -> list[Rule]:
    """The paths to all nodes below the roots, from Spark's description of a forest."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for line in described.splitlines():
        depth = len(line) - len(line.lstrip())
        while path and path[-1][0] >= depth:
            path.pop()
        if m := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line):
            path.append((depth, (int(m[1]), m[2] == "<=", float(m[3]))))
            found[Rule(frozenset(p for _, p in path))] = None
    return list(found)


def fit(rows: DataFrame, names: list[str]) -> Model:
    """rows: the statistics and ``label`` (0 or 1), at most SAMPLE rows, which one task holds."""
    rows = scratch_table(rows.select(F.array(*names).alias("x"), *names, F.col("label").cast("double"))
                         .coalesce(1), "quality-sample")
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        constant = {0.0: -40.0, 1.0: 40.0}.get(next(iter(seen), None), 0.0)
        return Model(names, constant, {})
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird")
    grown = forest.fit(rows.select(array_to_vector("x").alias("features"), "label"))
    rules = tree_rules(grown.toDebugString)
    if not rules:  # all labelled rows have equal statistics
        return Model(names, math.log(seen[1.0] / seen[0.0]), {})
    held = rows.select(array_to_vector(F.array(*[r.column(names) for r in rules])).alias("features"), "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=80)
    weighed = lasso.fit(scratch_table(held, "quality-rules"))
    weights = {r: float(w) for r, w in zip(rules, weighed.coefficients) if w}
    return Model(names, float(weighed.intercept), weights)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = statistics(F.col("text"))
    names = [f"stat_{x}" for x in made]
    table = scratch_table(
        text.select("id", held_out(F.col("id")).alias("held_out"), *[c.cast("double").alias(n) for n, c in zip(names, made.values())]),
        "quality-statistics")
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("l_id"), F.col(label_col).alias("label"))
    taught = table.where(~F.col("held_out")).join(known, F.col("id") == F.col("l_id"))
    model = fit(taught.orderBy(F.xxhash64("id"), "id", "label", *names).limit(sample), names)
    return table.select("id", "held_out", model.score().alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
