"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical without the six ASCII white-space
characters.  One pass over the texts writes a narrow table of digests; all the
rest works on that table:

1. A Misra-Gries summary (``approx_top_k``, a mergeable frequent-items sketch of
   a fixed number of counters) finds digests held by more than one row in
   ``FREQUENT``.
2. Those candidates are verified: their rows are counted exactly and the row that
   stays is chosen, with map-side partial aggregation.  At most ``FREQUENT``
   winners can exist, so they are broadcast and their copies decided map-side.
3. All other digests, each held by a small share of the rows, are grouped and
   joined by an ordinary shuffle.

Defined cases: a null text is an empty text; a null id is a valid id that comes
after all others; rows that repeat an id and a text are separate rows of one group
and exactly one of them stays; an empty table gives an empty result; extra columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import scratch_table

#: A digest is frequent when more than one row in this many has it.
FREQUENT = 1024
#: Counters of the frequent-items summary: its error is about rows / (0.75 * COUNTERS).
COUNTERS = 8192

SPACES = " \t\n\x0b\x0c\r"


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text without ASCII white space; null counts as empty."""
    bare = F.translate(F.coalesce(text, F.lit("")), SPACES, "")
    return F.unhex(F.sha2(bare, 256))


def _winner() -> Column:
    """Of a group: longest original text, then smallest id (null last), then first row."""
    return F.min(F.struct(-F.col("n"), F.col("id").isNull(), "id", "row"))


def frequent_digests(digests: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Hashes of the digests that the summary holds for frequent (column ``h``).

    Candidates only: a hash may belong to two digests or be over-counted.  The sketch
    has COUNTERS counters however many rows it has seen.
    """
    summary = digests.agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr(f"approx_top_k(xxhash64(digest), {COUNTERS // 2}, {COUNTERS})").alias("top"))
    items = summary.select("rows", F.explode("top").alias("t"))
    return items.where(F.col("t.count") * frequent > F.col("rows")).select(F.col("t.item").alias("h"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest (binary)."""
    return _decided(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                                F.monotonically_increasing_id().alias("row")), frequent).drop("row")


def _decided(texts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``decide`` for rows (row, id, text), with the row."""
    digests = scratch_table(
        texts.select("id", F.length(F.coalesce("text", F.lit(""))).alias("n"), text_digest(F.col("text")).alias("digest"), "row"),
        "exact-digests")
    hot = F.broadcast(frequent_digests(digests, frequent))
    # No more digests than `frequent` can pass the exact count: the broadcast is bounded.
    winners = scratch_table(
        digests.join(hot, F.xxhash64("digest") == F.col("h"), "left_semi")
        .groupBy("digest").agg(F.count(F.lit(1)).alias("size"), _winner().alias("win"))
        .where(F.col("size") * frequent > digests.agg(F.count(F.lit(1)).alias("c")).scalar()),
        "exact-winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), _winner().alias("win"))
    both = heavy.unionByName(rest.join(groups, "digest"))
    return both.select("row", "id", F.col("win.id").alias("keep_id"), F.col("size").alias("group_size"),
                       (F.col("row") == F.col("win.row")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the very row that ``decide`` keeps.

    The rows are written once with a row id, by which those that go are taken out."""
    rows = scratch_table(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "exact-docs")
    texts = rows.select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    gone = _decided(texts).where(~F.col("kept")).select("row")
    return rows.join(gone, "row", "left_anti").select("doc.*")
