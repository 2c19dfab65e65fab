"""Text normalisation and small string helpers, all as native Column expressions.

Every function takes and returns ``Column`` objects so that the work stays in the
JVM (whole-stage codegen where Spark supports it) and Catalyst can prune and
fold around it.  No Python runs per row here.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------
# Runs of characters that are neither a letter nor a number collapse to one
# space.  (Python's [\W_]+ equals this class on accents, superscripts and
# vulgar fractions; Java's (?U)\W does not, so the explicit class is used.)
NON_WORD_RUN = r"[^\p{L}\p{N}]+"
# A token made only of numeric characters is dropped.
NUMERIC_TOKEN = r"^\p{N}+$"
# Year between 1900 and 2100 as a whole word.
YEAR_PATTERN = r"\b(19[0-9]{2}|20[0-9]{2}|2100)\b"
# Timestamp text used for saved file names and the JSON encoder.
TS_FORMAT = "MM-dd-yyyy-HH-mm-ss"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=None)
def default_stopwords() -> tuple[str, ...]:
    """Spark's English stop-word list (shipped as a resource, 181 words)."""
    text = resources.files("lectern.resources").joinpath("stopwords_en.txt").read_text("utf-8")
    return tuple(dict.fromkeys(w for w in text.splitlines() if w))


def load_stopwords(source: str | Iterable[str] | None) -> tuple[str, ...]:
    """Stop words from a path to a one-word-per-line file, an iterable, or the default."""
    if source is None:
        return default_stopwords()
    if isinstance(source, str):
        with open(source, encoding="utf-8") as fh:
            return tuple(dict.fromkeys(w for w in fh.read().splitlines()))
    return tuple(dict.fromkeys(source))


# TXT1 -------------------------------------------------------------------------
def normalize_text(c: str | Column) -> Column:
    """Collapse every run of non letter/number characters (and ``_``) to one space."""
    return F.regexp_replace(_col(c), NON_WORD_RUN, " ")


# TXT2 -------------------------------------------------------------------------
def split_words(c: str | Column) -> Column:
    """Runs of letters/numbers, each lower-cased (may hold empty pieces at the ends).

    Equal to normalise -> lower -> split on spaces: lower-casing never turns a
    letter or number into a separator, so splitting first is exact and saves a
    rewrite of the whole text.
    """
    return F.transform(F.split(_col(c), NON_WORD_RUN), lambda t: F.lower(t))


def tokenize(c: str | Column) -> Column:
    """Lower-case and split on spaces, dropping empty pieces (input already normalised)."""
    return F.filter(F.split(F.lower(_col(c)), " "), lambda t: t != "")


def word_tokens(c: str | Column) -> Column:
    """TXT1 + TXT2: lower-cased letter/number runs."""
    return F.filter(split_words(c), lambda t: t != "")


# TXT3 -------------------------------------------------------------------------
def is_numeric_token(t: Column) -> Column:
    """All characters numeric.  Tokens starting with an ASCII lower-case letter
    skip the regex (And/Or short-circuit in Spark)."""
    return ~((t >= "a") & (t < "{")) & t.rlike(NUMERIC_TOKEN)


def drop_stopwords_and_numbers(tokens: Column, stopwords: Iterable[str]) -> Column:
    """Remove stop words and all-numeric tokens, keeping order and duplicates.

    ``isin`` over a literal list becomes an ``InSet`` (hash lookup) once the list is
    longer than ``spark.sql.optimizer.inSetConversionThreshold``.
    """
    sw = list(stopwords)
    if sw:
        return F.filter(tokens, lambda t: ~t.isin(sw) & ~is_numeric_token(t))
    return F.filter(tokens, lambda t: ~is_numeric_token(t))


def clean_tokens(c: str | Column, stopwords: Iterable[str] | None = None) -> Column:
    """TXT1-TXT3 over a string column; NULL input gives an empty array."""
    sw = list(default_stopwords() if stopwords is None else stopwords)
    words = split_words(F.coalesce(_col(c), F.lit("")))

    def keep(t: Column) -> Column:
        k = t != ""
        return (k & ~t.isin(sw) & ~is_numeric_token(t)) if sw else (k & ~is_numeric_token(t))

    return F.filter(words, keep)


# TXT4 -------------------------------------------------------------------------
def clean_text(c: str | Column, stopwords: Iterable[str] | None = None) -> Column:
    """Cleaned text: tokens joined by one space; NULL or missing gives ``""``."""
    return F.array_join(clean_tokens(c, stopwords), " ")


# TXT5 -------------------------------------------------------------------------
def vector_tokens(c: str | Column, stopwords: Iterable[str] | None = None,
                  extra_stopwords: Iterable[str] = ()) -> Column:
    """Tokens fed to the term-frequency vectoriser: TXT1-TXT3 plus length >= 2,
    minus an optional second stop list.  One filter pass over the split text."""
    sw = list(default_stopwords() if stopwords is None else stopwords) + list(extra_stopwords)
    words = split_words(F.coalesce(_col(c), F.lit("")))

    def keep(t: Column) -> Column:
        k = F.length(t) >= 2
        return (k & ~t.isin(sw) & ~is_numeric_token(t)) if sw else (k & ~is_numeric_token(t))

    return F.filter(words, keep)


# TXT6 -------------------------------------------------------------------------
def unescape_text(c: str | Column) -> Column:
    r"""Remove literal ``\r\n`` escapes and turn ``\"`` into ``"``."""
    return F.replace(F.replace(_col(c), F.lit("\\r\\n"), F.lit("")), F.lit('\\"'), F.lit('"'))


# TXT7 -------------------------------------------------------------------------
def title_key(c: str | Column) -> Column:
    """Keep only letters, numbers and white space, then trim."""
    return F.trim(F.regexp_replace(_col(c), r"[^\p{L}\p{N}\s]", ""))


def paper_key(pos: Column, title: str | Column) -> Column:
    """``"{idx}_{title without punctuation}"``."""
    return F.concat(pos.cast("string"), F.lit("_"), title_key(title))


# TXT8 -------------------------------------------------------------------------
def repair_key(c: str | Column) -> Column:
    """Drop one space right after the first underscore: ``0_ Title`` -> ``0_Title``."""
    return F.regexp_replace(_col(c), r"^([^_]*)_ ", "$1_")


# TXT9 -------------------------------------------------------------------------
def extract_year(c: str | Column) -> Column:
    """First year 1900-2100 in the text, NULL when none."""
    y = F.regexp_extract(_col(c), YEAR_PATTERN, 1)
    return F.when(y != "", y.cast("int"))


# TXT10 ------------------------------------------------------------------------
def url_host(c: str | Column) -> Column:
    """Third ``/``-separated piece (``url.split('/')[2]``)."""
    return F.get(F.split(_col(c), "/"), 2)


def url_last_segment(c: str | Column) -> Column:
    return F.substring_index(_col(c), "/", -1)


def strip_extension(c: str | Column) -> Column:
    """Everything before the last ``.`` (unchanged when there is none)."""
    return F.regexp_replace(_col(c), r"\.[^.]*$", "")


def derive_pdf_url(c: str | Column) -> Column:
    """``.../v208/zecevic23a.html`` -> ``.../v208/zecevic23a/zecevic23a.pdf``."""
    url = _col(c)
    user = F.substring_index(url_last_segment(url), ".", 1)
    return F.concat(strip_extension(url), F.lit("/"), user, F.lit(".pdf"))


# TXT11 ------------------------------------------------------------------------
def split_authors(c: str | Column) -> Column:
    """Comma list -> ``ARRAY<STRUCT<ord INT, key STRING, name STRING>>``."""
    return F.transform(
        F.split(_col(c), ","),
        lambda x, i: F.struct(i.alias("ord"),
                              F.concat(i.cast("string"), F.lit("_"), F.trim(x)).alias("key"),
                              F.trim(x).alias("name")),
    )


# TXT12 ------------------------------------------------------------------------
def label_name(c: str | Column) -> Column:
    """Node label -> name: text before the first ``=``, braces and spaces stripped."""
    return F.trim(F.btrim(F.substring_index(_col(c), "=", 1), F.lit("{}")))


def label_value(c: str | Column) -> Column:
    """Node label -> value: text after the first ``=`` (NULL when there is none)."""
    s = _col(c)
    return F.when(F.instr(s, "=") > 0, F.substr(s, F.instr(s, "=") + 1))


# TXT13 / SNK2 -----------------------------------------------------------------
def search_name(model: str | Column, field: str | Column, query: str | Column) -> Column:
    """``{model}_{field}_{words-joined-by-dash}``."""
    words = F.split(F.trim(F.lower(_col(query))), r"\s+")
    return F.concat_ws("_", F.lower(_col(model)), _col(field), F.array_join(words, "-"))


# TXT14 ------------------------------------------------------------------------
def key_suffix(key: str | Column, conference: str | Column, year: str | Column) -> Column:
    """``{key}_{first letter of conference}_{last two digits of year}``."""
    return F.concat(_col(key).cast("string"), F.lit("_"), F.substring(_col(conference), 1, 1),
                    F.lit("_"), F.right(_col(year).cast("string"), F.lit(2)))


# TXT15 ------------------------------------------------------------------------
def human_bytes(c: str | Column) -> Column:
    """Bytes in 1024 steps: B, KB, MB, GB, then PB (the unit list has no TB).

    The value is rounded half-even (``bround``) before formatting so exact binary
    ties such as 549.25 print as C/Python print them (Java's formatter rounds
    half-up).
    """
    b = _col(c).cast("double")
    a = F.abs(b)
    k = F.lit(1024.0)

    def fmt(v: Column, unit: str, width: str = "%4.1f") -> Column:
        return F.format_string(width + " %s", F.bround(v, 1), F.lit(unit))

    return (F.when(a < k, fmt(b, "B"))
            .when(a < k ** 2, fmt(b / k, "KB"))
            .when(a < k ** 3, fmt(b / k ** 2, "MB"))
            .when(a < k ** 4, fmt(b / k ** 3, "GB"))
            .otherwise(fmt(b / k ** 4, "PB", "%.1f")))


# TXT16 ------------------------------------------------------------------------
def human_duration(c: str | Column, integral: bool = False) -> Column:
    """Seconds rounded to 2 digits, shown as ``N.NNNs`` (<= 60), ``N.NNNm`` (<= 3600),
    else ``N.NNNh``.

    With ``integral=True`` (whole seconds) the minutes/hours digits are computed
    with integer arithmetic: exact half-up rounding of the rational value.  (Python
    formats the binary quotient, so on exact ties such as 4329 s = 1.2025 h its
    last digit depends on the binary rounding of the division; this is a
    deliberate deviation.)  The general path uses Java formatting, which rounds
    half-up on the shortest decimal form.
    """
    if integral:
        s = _col(c).cast("long")
        mins = F.floor((s * 2000 + 60) / 120).cast("long")
        hours = F.floor((s * 2000 + 3600) / 7200).cast("long")
        return (F.when(s <= 60, F.format_string("%d.000s", s))
                .when(s <= 3600, F.format_string("%d.%03dm", F.floor(mins / 1000).cast("long"),
                                                 F.pmod(mins, F.lit(1000))))
                .otherwise(F.format_string("%d.%03dh", F.floor(hours / 1000).cast("long"),
                                           F.pmod(hours, F.lit(1000)))))
    s = F.round(_col(c).cast("double"), 2)
    return (F.when(s <= 60, F.format_string("%.3fs", s))
            .when(s <= 3600, F.format_string("%.3fm", s / 60))
            .otherwise(F.format_string("%.3fh", s / 3600)))


# DAT1 -------------------------------------------------------------------------
def format_ts(c: str | Column) -> Column:
    return F.date_format(_col(c), TS_FORMAT)


# MTH1 / MTH2 ------------------------------------------------------------------
def round_score(c: str | Column, digits: int = 4) -> Column:
    """Score as stored: float32 value widened back to double, then rounded."""
    return F.round(_col(c).cast("float").cast("double"), digits)


# FLT4 -------------------------------------------------------------------------
def is_numeric_string(c: str | Column) -> Column:
    """True for text Python's ``float()`` accepts in decimal/exponent form."""
    s = F.trim(_col(c))
    return F.coalesce(
        s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        | F.lower(s).rlike(r"^[+-]?(inf|infinity|nan)$"), F.lit(False))
