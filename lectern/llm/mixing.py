"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get target sizes (weights with an upper limit of ``MAX_REPEATS`` times the
source, the excess shared out anew).  The mix is made of equal blocks of words:

1. the blocks of the whole mix go to the sources by highest quotients
   target / (2 k + 1);
2. the documents of a source are dealt over shards of about ``SHARD_WORDS`` words by
   a seeded hash of id, text and copy (rows that are equal in both are numbered), and the source's blocks go to its shards by highest quotients too:
   every shard has an integer quota;
3. in a shard the documents are laid end to end in seeded order and cut into blocks;
   the quota takes whole rounds of all blocks, and the rest from a seeded block on.
   What a document gives follows from its place, so no row per block is made.

Only seats near the cut need ranking: a party's seats differ from its rounded share by
at most its part of the rounding surplus, so all seats below that are granted without
being listed.  The listed seats are about three for each party, however large the mix.

Defined cases: a null text has no words; a null source is a source of its own, last in
order; a null id is an id; documents without words take nothing; rows that repeat an id
are separate documents; an empty table gives an empty result; extra columns are ignored
by ``mix_takes`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranking import dense_position
from lectern.session import scratch_table

BLOCK_WORDS = 8
SHARD_WORDS = 1 << 18
MAX_REPEATS = 3
SEED = 20
#: Copies of the per-source rows, so that a source with a third of all rows is joined in many tasks.
SALTS = 16

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    """A non-negative hash of 60 bits."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3, repeating, in code-point order (null last).

    Sorted by limit / weight, the limited sources come first.  If the first k are at their
    limits the others get weight * level(k); the true level is the largest level(k).
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source: these windows see no document.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    ranked = totals.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))
    limit = max_repeats * F.col("source_size").cast("double")
    order = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole)
              - F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    return (ranked.withColumn("level", level).withColumn("level", F.max("level").over(whole))
            .select("source", "source_size", F.least(limit, F.col("weight") * F.col("level")).alias("target")))


def sainte_lague(parties: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``quota`` to ``parties``: the seats of each by highest quotients.

    parties: columns ``votes`` (double), ``seats`` (long, seats of its group), ``most``
    (long, a party's limit), ``tie`` (any, orders equal quotients); ``by`` names the group
    (may be empty).
    """
    group = Window.partitionBy(*by)
    share = F.coalesce(F.col("votes") * F.col("seats") / F.nullif(F.sum("votes").over(group), F.lit(0.0)), F.lit(0.0))
    near = parties.withColumns({"share": share, "parties": F.count(F.lit(1)).over(group)})
    reach = F.ceil(F.col("share") * F.col("parties") / F.greatest(F.col("seats"), F.lit(1))) + 2
    near = near.withColumn("sure", F.least("most", F.greatest(F.lit(0), F.floor(F.col("share") + 0.5) - reach)).cast("long"))
    near = near.withColumn("open", F.least(F.col("most") - F.col("sure"), 2 * reach).cast("long"))
    near = near.withColumn("left", F.col("seats") - F.sum("sure").over(group))
    asked = near.where("open > 0 and votes > 0").select(
        "*", F.explode(F.sequence(F.col("sure"), F.col("sure") + F.col("open") - 1)).alias("k"))
    ranked = asked.withColumn("nth", F.row_number().over(
        group.orderBy((F.col("votes") / (2 * F.col("k") + 1)).desc(), F.col("tie"), "k")))
    won = ranked.where(F.col("nth") <= F.col("left")).groupBy("tie", *by).agg(F.count(F.lit(1)).alias("won"))
    keys = ["tie", *by]
    right = won.select(*[F.col(c).alias(f"w_{c}") for c in keys], "won")
    on = [near[c].eqNullSafe(right[f"w_{c}"]) for c in keys]
    return (near.join(right, on, "left")
            .withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0)))
            .select(*parties.columns, "quota"))


def _placed(sizes: DataFrame, seed: int, block_words: int, shard_words: int, max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``sizes`` (row, id, source, size, key) that have words, with what their shard takes: ``rounds`` whole
    rounds and the words [a1, b1) and [0, b2) of the shard's stream, the document lying in
    [at, at + size).  And the rows without words."""
    targets = scratch_table(source_targets(sizes, max_repeats), "mix-targets")
    parties = targets.select(
        "*", F.col("target").alias("votes"), F.struct(F.col("source").isNull(), "source").alias("tie"),
        F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long").alias("seats"),
        (max_repeats * F.ceil(F.col("source_size") / block_words)).alias("most"))
    sources = scratch_table(
        sainte_lague(parties, []).select(
            F.col("source").alias("s_source"), "source_size", "target", F.col("quota").alias("source_quota"),
            F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("shards")),
        "mix-sources")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def of_source(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, F.col("source").eqNullSafe(F.col("s_source")) & (rows["salt"] == salted["salt"]))
        return joined.drop("salt")

    numbered = dense_position(sizes.where("size > 0"), "key", "row", "copy")
    dealt = of_source(numbered.withColumn("h", seeded(seed, F.col("id"), F.col("key"), F.col("copy"))))
    dealt = scratch_table(dealt.withColumn("shard", F.col("h") % F.col("shards")), "mix-dealt")
    shards = (dealt.groupBy("s_source", "shard")
              .agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"),
                   F.first("source_quota").alias("seats")))
    shards = shards.withColumns({"blocks": F.ceil(F.col("shard_size") / block_words), "tie": F.col("shard")})
    shards = shards.withColumns({"votes": F.col("shard_size").cast("double"), "most": max_repeats * F.col("blocks")})
    quotas = sainte_lague(shards, ["s_source"])
    start = seeded(seed + 1, F.col("s_source"), F.col("shard")) % F.greatest("blocks", F.lit(1))
    part = F.col("quota") % F.greatest("blocks", F.lit(1))
    quotas = scratch_table(
        quotas.select(
            F.col("s_source").alias("q_source"), F.col("shard").alias("q_shard"),
            F.floor(F.col("quota") / F.greatest("blocks", F.lit(1))).alias("rounds"),
            (start * block_words).alias("a1"),
            (F.least(start + part, F.col("blocks")) * block_words).alias("b1"),
            (F.greatest(start + part - F.col("blocks"), F.lit(0)) * block_words).alias("b2")),
        "mix-quotas")
    # Sorted within a shard, whose size is bounded; the running sum keeps no rows.
    stream = Window.partitionBy("s_source", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.withColumn("at", F.coalesce(F.sum("size").over(stream), F.lit(0)).cast("long"))
    laid = laid.join(quotas, laid["s_source"].eqNullSafe(quotas["q_source"]) & (laid["shard"] == quotas["q_shard"]))
    return laid, of_source(sizes.where("size = 0"))


def _overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """The words [x, y) of a document that lie in [a, b) of the stream."""
    at, end = F.col("at"), F.col("at") + F.col("size")
    x = F.greatest(at, a)
    return x - at, F.greatest(F.least(end, b), x) - at


def _sized(docs: DataFrame, row: Column, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row, id, source, size, key: rows that equal in id, source and text share a key."""
    sized = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                        n_words(F.col(text_col)).alias("size"), F.xxhash64(id_col, source_col, text_col).alias("key"))
    return scratch_table(sized, "mix-sizes")


def mix_takes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              seed: int = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
              max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted)."""
    sizes = _sized(docs, F.monotonically_increasing_id(), id_col, text_col, source_col)
    placed, none = _placed(sizes, seed, block_words, shard_words, max_repeats)
    (x1, y1), (x2, y2) = _overlap(F.col("a1"), F.col("b1")), _overlap(F.lit(0), F.col("b2"))
    taken = F.col("rounds") * F.col("size") + (y1 - x1) + (y2 - x2)
    columns = ["id", "size", "source_size", "target"]
    return (placed.select(*columns, taken.cast("long").alias("taken"))
            .unionByName(none.select(*columns, F.lit(0).cast("long").alias("taken"))))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  seed: int = SEED, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
                  max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document once for each whole round, and
    the part of its text that its shard's last, partial round takes."""
    full = scratch_table(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-docs")
    sizes = _sized(full, F.col("row"), f"doc.{id_col}", f"doc.{text_col}", f"doc.{source_col}")
    placed, _ = _placed(sizes, seed, block_words, shard_words, max_repeats)
    (x1, y1), (x2, y2) = _overlap(F.col("a1"), F.col("b1")), _overlap(F.lit(0), F.col("b2"))
    rounds = F.when(F.col("rounds") > 0, F.array_repeat(F.struct(F.lit(0).cast("long").alias("x"), F.col("size").alias("y")),
                                                        F.col("rounds").cast("int"))).otherwise(F.array())
    spans = F.concat(rounds, F.array(F.struct(x1.cast("long").alias("x"), y1.cast("long").alias("y")),
                                     F.struct(x2.cast("long").alias("x"), y2.cast("long").alias("y"))))
    taken = placed.select("row", "size", F.explode(F.filter(spans, lambda s: s["y"] > s["x"])).alias("s")).join(full, "row")
    pieces = F.regexp_extract_all(F.col(f"doc.{text_col}"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, (F.col("s.x") + 1).cast("int"), (F.col("s.y") - F.col("s.x")).cast("int")), "")
    text = F.when(F.col("s.y") - F.col("s.x") == F.col("size"), F.col(f"doc.{text_col}")).otherwise(cut)
    return taken.select([text.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
