"""Secret scan with a trigram inverted index.

Every rule is a regular expression.  On the driver, each expression is parsed and turned into
a Boolean query over (lower-cased) trigrams that any match must hold: AND over the pieces of
a sequence, OR over alternatives.  Then, as DataFrame operations:

1. one pass over the texts writes the postings (trigram, document) of the trigrams that
   some query names;
2. the postings of a document are brought together (one bit a trigram) and the queries
   are evaluated: the documents that are candidates for a rule.  Postings of one document
   are combined before the shuffle;
3. a second pass verifies: candidates run the rule's expression, and rules without any
   mandatory trigram run on every text.

The candidates are joined to the texts by key.  Spark broadcasts them only when the written
table is smaller than ``spark.sql.autoBroadcastJoinThreshold``, else it shuffles.

Positions count code points.  A text is the matches of an expression and the gaps between
them (``regexp_extract_all`` and ``split`` of the same engine), so starts are running sums
of their lengths; the sums are taken over exploded matches, linear also for a text with
very many matches.

Defined cases: a null text is empty; a null id is an id; rows that repeat an id are
scanned each and have a row each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import scratch_table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match is dropped if this group (0: all of it) has fewer characters.
    group: int = 0
    least: int = 0
    base: bool = False


#: The three base kinds, in their order, then well-known public key formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"sk_live_[A-Za-z0-9]{16,}"),
)

#: Alternatives that a run of characters is expanded to at most, before it is cut.
EXPANDED = 32


# --- Boolean trigram queries ----------------------------------------------------------------
# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).
def _all(parts) -> object:
    parts = frozenset(p for p in parts if p is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any(parts) -> object:
    parts = frozenset(parts)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of_strings(strings) -> object:
    """What a match holds if it holds one of the strings."""
    return _any(_all(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(node) -> set[str] | None:
    """All (lower-cased) strings that a node matches, if they are few; else None."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN and all(x[0] is C.LITERAL for x in arg) and len(arg) <= EXPANDED:
        return {chr(x[1]).lower() for x in arg}
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is C.BRANCH:
        found = [_sequence_strings(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[:2] == (0, 1):
        found = _sequence_strings(arg[2])
        return None if found is None else found | {""}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(out) * len(found) > EXPANDED:
            return None
        out = {a + b for a in out for b in found}
    return out


def _sequence_query(nodes) -> object:
    parts, run = [], {""}
    for node in nodes:
        found = _strings(node)
        if found is not None and len(run) * len(found) <= EXPANDED:
            run = {a + b for a in run for b in found}
            continue
        parts.append(_of_strings(run))
        run = {""}
        if found is not None:
            run = found
            continue
        op, arg = node
        if op is C.SUBPATTERN:
            parts.append(_sequence_query(arg[3]))
        elif op is C.BRANCH:
            parts.append(_any(_sequence_query(x) for x in arg[1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            parts.append(_sequence_query(arg[2]))
    parts.append(_of_strings(run))
    return _all(parts)


def trigram_query(pattern: str) -> object:
    """The trigrams, of the lower-cased text, that any match of the expression must hold."""
    return _sequence_query(_parser.parse(pattern))


def _named(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_named, query[1]))


# --- index ------------------------------------------------------------------------------------
def build_postings(docs: DataFrame, trigrams: list[str], key: Column, text: Column) -> DataFrame:
    """(trigram, key): the inverted index of ``docs`` over the given trigrams."""
    low = docs.select(key.alias("key"), F.lower(text).alias("low")).where("low is not null")
    held = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])
    return low.select("key", F.explode(F.array_compact(held)).alias("trigram"))


def intersect(postings: DataFrame, queries: list[object], trigrams: list[str]) -> DataFrame:
    """(key, rules): bit r of ``rules`` is set for candidates of query r."""
    at = {t: i for i, t in enumerate(trigrams)}
    words = range(-(-len(trigrams) // 62))
    bits = [F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w,
                            F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % 62))
                     .otherwise(F.lit(0).cast("long"))).alias(f"bits{w}") for w in words]

    def holds(query) -> Column:
        if isinstance(query, str):
            word, bit = divmod(at[query], 62)
            return F.col(f"bits{word}").bitwiseAND(F.lit(1 << bit)) != 0
        return reduce(and_ if query[0] == "and" else or_, map(holds, sorted(query[1], key=str)))

    rules = reduce(lambda a, b: a.bitwiseOR(b),
                   [F.when(holds(q), F.lit(1 << r)).otherwise(F.lit(0)).cast("long") for r, q in enumerate(queries) if q is not True])
    found = postings.groupBy("key").agg(*bits).select("key", rules.alias("rules"))
    return found.where("rules != 0")


# --- verification -----------------------------------------------------------------------------
def _lengths(rule: Rule, text: Column) -> Column:
    """array<struct<gap, length, checked>> of the rule's matches, in order: code points
    before the match since the last one, in it, and in the group that must be long enough."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.greatest(F.size(whole), F.lit(0)))
    return F.zip_with(gaps, F.arrays_zip(whole.alias("w"), group.alias("g")),
                      lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["w"]).alias("length"),
                                              F.length(m["g"]).alias("checked")))


def _narrow(rule: Rule) -> Rule:
    """The same matches of sufficient length, when the expression is one repeated class (a
    match is then a whole run): asks the engine for long runs only."""
    if rule.group == 0 and rule.least and len(_parser.parse(rule.pattern)) == 1 and rule.pattern.endswith("]+"):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least, rule.base)
    return rule


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the rows scanned (row, id), and (row, id, rule, kind, base, start, end)
    for each secret; ``row`` numbers the rows, ``rule`` the rules."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(_named, queries)))
    key = F.xxhash64(id_col)  # two ids with one hash only share candidates
    texts = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<gap:int,length:int,checked:int>>")
    if trigrams:
        postings = scratch_table(build_postings(docs, trigrams, key, F.col(text_col)), "secret-postings")
        candidates = scratch_table(intersect(postings, queries, trigrams), "secret-candidates")
        texts = texts.join(candidates, "key", "left")
    else:
        texts = texts.withColumn("rules", F.lit(0).cast("long"))
    columns = []
    for r, (rule, query) in enumerate(zip(rules, queries)):
        rule = _narrow(rule)
        asked = F.col("text").rlike(rule.pattern) if query is True else F.col("rules").bitwiseAND(F.lit(1 << r)) != 0
        columns.append(F.when(asked, _lengths(rule, F.col("text"))).otherwise(none).alias(f"r{r}"))
    verified = scratch_table(texts.select("id", F.monotonically_increasing_id().alias("row"), *columns), "secret-verified")

    def tag(r: int):
        return lambda m, i: F.struct(F.lit(r).alias("rule"), i.alias("nth"), m.alias("m"))

    tagged = F.concat(*[F.transform(f"r{r}", tag(r)) for r in range(len(rules))])
    matches = verified.select("row", "id", F.explode(tagged).alias("t")).select("row", "id", "t.rule", "t.nth", "t.m.*")
    before = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(before)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    base = F.element_at(F.array(*[F.lit(r.base) for r in rules]), F.col("rule") + 1)
    spans = (matches.withColumn("end", end).where(F.col("checked") >= least)
             .select("row", "id", "rule", kind.alias("kind"), base.alias("base"),
                     (F.col("end") - F.col("length")).alias("start"), "end"))
    return verified.select("row", "id"), spans


def scan_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: id, n_<kind> of the base kinds, base_sha256, spans."""
    rows, spans = scan(docs, id_col, text_col, rules)
    said = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "rule", "base", said.alias("said"))))
    counts = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules if r.base]
    found = spans.groupBy("row").agg(ordered.alias("all"), *counts)

    def joined(spans_: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(spans_, lambda s: s["said"]), ","), F.lit(""))

    return rows.join(found, "row", "left").select(
        "id", *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules if r.base],
        F.sha2(joined(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"))
