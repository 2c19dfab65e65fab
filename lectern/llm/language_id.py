"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters that are no letters becomes one space,
and the n-grams of ``SIZES`` are hashed into buckets.  Training counts buckets by
language over all training texts: every task adds its texts up in numpy and emits its
non-zero counts, Spark adds those.  The log-probability matrix (BUCKETS by languages, 4 bytes each) is
broadcast; texts are scored by gathering and adding its rows, CHUNK letters at a time, so that a very long text
takes a few times its own size.  The matrix is the only thing that the driver builds, from one row of Spark's a
language at a time; more than MAX_LANGUAGES (64 MB) are an error, as such a column holds no languages.

Defined cases: a null text or one without letters is ``und`` with score 0; without any
training text every other text is ``und`` too; null languages and null texts teach nothing; a null
id counts as held out; ties go to the language first in order; rows that repeat
are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
SIZES = (1, 2, 3)
BUCKETS = 1 << 16
MAX_LANGUAGES = 256
SMOOTHING = 0.5
#: Letters whose n-grams are made at once.
CHUNK = 1 << 16
#: Languages whose counts a task holds at once before it emits them.
HELD_LANGUAGES = 64

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def letters() -> np.ndarray:
    """For each code point whether it is a letter (Unicode categories L*)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_buckets(text: str, is_letter: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, in pieces; nothing without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    known = is_letter[points]
    if not known.any():
        return
    # A space stands for each run of other characters, and for both ends of the text.
    keep = known.copy()
    keep[1:] |= known[:-1]
    chars = np.concatenate(([32], np.where(known, points, 32)[keep], [32])).astype(np.uint32)
    del points, known, keep
    for at in range(0, len(chars), CHUNK):
        part = chars[at:at + CHUNK + max(SIZES) - 1].astype(np.uint64)
        found = []
        for n in SIZES:
            size = min(CHUNK, len(part) - n + 1)
            if size > 0:
                h = np.full(size, n, dtype=np.uint64)
                for i in range(n):
                    h = (h + part[i:size + i]) * MULTIPLIERS[i]
                    h ^= h >> np.uint64(29)
                found.append((h % np.uint64(buckets)).astype(np.int64))
        yield np.concatenate(found)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray  # log, by language
    weights: np.ndarray  # log-probabilities, buckets by languages


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows of ``train`` whose text and language are not null."""
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    texts = {r["lang"]: r["n"] for r in known}
    languages = sorted(texts)
    if not languages:
        return Model([], np.zeros(0), np.zeros((1, 0), dtype=np.float32))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_letter = letters()
        held: dict[str, np.ndarray] = {}

        def emitted() -> Iterator[pd.DataFrame]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": counts[at]})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                for found in ngram_buckets(text, is_letter):
                    if lang not in held:
                        if len(held) >= HELD_LANGUAGES:
                            yield from emitted()
                        held[lang] = np.zeros(BUCKETS, dtype=np.int64)
                    if len(found) > BUCKETS // 8:
                        held[lang] += np.bincount(found, minlength=BUCKETS)
                    else:
                        np.add.at(held[lang], found, 1)
        yield from emitted()

    counted = rows.mapInPandas(count, "lang string, bucket int, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row a language, of at most BUCKETS counts.
    columns = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    weights = np.empty((BUCKETS, len(languages)), dtype=np.float32)
    weights[:] = np.log(1 / BUCKETS)  # stays for languages whose texts have no letter
    column = np.zeros(BUCKETS)
    for r in columns.select("lang", "counts.bucket", "counts.n").toLocalIterator():
        column[:] = SMOOTHING
        column[r["bucket"]] += r["n"]
        weights[:, languages.index(r["lang"])] = np.log(column / column.sum())
    prior = np.log(np.array([texts[x] for x in languages], dtype=float) / sum(texts.values()))
    return Model(languages, prior, weights)


def predict(text: Column, model: Model, spark) -> Column:
    """struct(lang_pred, score): the likeliest language and its posterior probability."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, is_letter = shared.value, letters()
        for batch in batches:
            names, scores = [], []
            for said in batch:
                logs = None
                for found in ngram_buckets(said, is_letter) if said and m.languages else ():
                    logs = (m.prior if logs is None else logs) + m.weights[found].sum(axis=0, dtype=np.float64)
                if logs is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                best = int(np.argmax(logs))
                names.append(m.languages[best])
                scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    # So marked, a filter and a projection on the result share one call a text.
    return scored.asNondeterministic()(text)


def held_out(ident: Column) -> Column:
    """Rows that no model learns from: a fifth by the id, and rows without one."""
    return F.coalesce(F.crc32(ident.cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score for every row of ``docs``."""
    out = held_out(F.col(id_col))
    model = fit(docs.where(~out), text_col, lang_col)
    found = predict(F.col(text_col), model, docs.sparkSession)
    return (docs.select(F.col(id_col).alias("id"), out.alias("held_out"), found.alias("p"))
            .select("id", "held_out", "p.lang_pred", "p.score"))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns: those rejected
    have no text or no letter.  A null language becomes the predicted one; it stays null if no row teaches any."""
    model = fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    if not model.languages:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    found = predict(F.col(text_col), model, docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), found.alias("p")).where(F.col("p.lang_pred") != UNDETERMINED)
    return rows.select([F.coalesce(f"row.`{c}`", "p.lang_pred").alias(c) if c == lang_col else F.col(f"row.`{c}`").alias(c)
                        for c in docs.columns])
