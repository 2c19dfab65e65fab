"""Term-frequency searches over a persisted inverted index (SIM2, SIM9, SIM10).

``build_index`` tokenises a field once and writes three tables under a folder:

* ``documents``: dataset, paper_key, the columns to show, the squared norm ``ss`` of the term counts, and the term counts;
* ``postings``: one row a (term, dataset, block): the block's documents with the term (key, count, ``ss``) and the
  greatest weight ``peak`` = count / sqrt(ss) among them, in folders by a hash of the term, sorted by term inside;
* ``settings``: one row with what a search must know, the stop words too, so that queries are tokenised as the texts were.

A block holds about BLOCK documents of a dataset whose norms are alike (same power of two), so blocks of long texts
have small peaks.  A document's score is the sum of its weights times those of the query, so the peaks of a
block bound the score of each of its documents.

``search_index`` reads the folders and row groups of the query's terms only, and their lists in two steps: first bounds from
the peaks alone, and the lists of the FIRST most promising blocks of each dataset; their k-th best score (or the threshold) then rules
out every block whose bound lies below.  The results are those of ``search`` with the Cosine model.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators.ranking import threshold_filter, top_k_per_group
from lectern.operators.search import KEY, TOPK_FAN_IN, annotate, field_text
from lectern.session import scratch_table

BLOCK, BUCKETS, FIRST = 128, 64, 4
#: (document, term) entries that a task lists: they are sorted in memory.
ENTRIES = 1 << 20
#: Rounding of metric_match to four digits can lift a score by half of this.
STEP = 1e-4


def _class() -> Column:
    return F.floor(F.log2("ss")).cast("int")


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join where a null key (papers without a dataset) equals a null key."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = left.join(named, on, how)
    return out if how == "left_semi" else out.drop(*[f"_{k}" for k in keys])


def _order(columns: Sequence[str]) -> list[str]:
    """File order where the papers have it, then the key (as in ``search``)."""
    return [c for c in ("pos", "paper_key") if c in columns]


def build_index(papers: DataFrame, path: str, field: str = "abstract", show: Sequence[str] = ("title",),
                stopwords: Sequence[str] | None = None, extra_stopwords: Iterable[str] = (),
                block: int = BLOCK, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Write the index of ``papers`` under ``path``; ``mode="append"`` adds further datasets to one that is there
    (their keys must be new).  Two shuffles: documents are put together by (dataset, block) and listed there by term, so that a term of all
    documents is many rows in many tasks, and the lists are dealt into the folders by ranges of the term."""
    spark = papers.sparkSession
    root = path.rstrip("/")
    order = _order(papers.columns)
    show = [*show, *(c for c in order if c != "paper_key" and c not in show)]
    if mode != "append":
        words = [tx.default_stopwords() if stopwords is None else stopwords, extra_stopwords]
        kept = [F.array(*[F.lit(w) for w in some]).cast("array<string>") for some in words]
        (spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(field).alias("field"), kept[0].alias("stopwords"), kept[1].alias("extra"))
         .write.mode(mode).json(f"{root}/settings"))
    else:
        buckets, field, stopwords, extra_stopwords = _settings(spark, root)
    sorted_tokens = F.sort_array(tx.vector_tokens(field_text(papers, field), stopwords, extra_stopwords))
    counted = papers.select(*KEY, *show, F.inline(F.array(F.struct(sorted_tokens.alias("_tok")))))
    counted = counted.select(*KEY, *show, F.inline(F.array(F.struct(vx.term_count_pairs("_tok").alias("terms")))))
    ss = F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + t["n"] * t["n"])
    counted.withColumn("ss", ss).write.mode(mode).parquet(f"{root}/documents")
    docs = _written(spark, root, papers, show, mode, counted)
    sizes = (docs.where("ss > 0").groupBy("dataset", _class().alias("_class"))
             .agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"), F.sum(F.size("terms")).alias("_entries")))
    # Written, its true size decides whether the documents are shuffled to meet it.
    sizes = scratch_table(sizes, "index-sizes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sizes.agg(F.sum("_entries")).first()[0] or 0) // ENTRIES))
    place = F.concat_ws("-", F.lit(uuid.uuid4().hex[:8]), "_class", F.pmod(F.xxhash64(F.col("paper_key").cast("string")), F.col("_blocks")))
    placed = _join(docs.where("ss > 0").withColumn("_class", _class()), sizes.drop("_entries"), ["dataset", "_class"]).select("dataset", *order, "ss", place.alias("block"), "terms")
    # The documents of a block come together whole; their terms are listed where they meet, without a shuffle of each term.
    rows = placed.repartition(parts, "dataset", "block").select("dataset", *order, "ss", "block", F.inline("terms"))
    lists = (rows.groupBy("term", "dataset", "block")  # about the documents of a block
             .agg(F.collect_list(F.struct(*order, "n", "ss")).alias("docs"), F.max(F.col("n") / F.sqrt("ss")).alias("peak"))
             .withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int")))
    place = ("bucket", "term", "dataset", "block")
    (lists.repartitionByRange(*place).sortWithinPartitions(*place)
     .write.mode(mode).partitionBy("bucket").parquet(f"{root}/postings"))


def _settings(spark: SparkSession, root: str) -> tuple[int, str, list[str], list[str]]:
    row = spark.read.schema("buckets int, field string, stopwords array<string>, extra array<string>").json(f"{root}/settings").first()
    return row["buckets"], row["field"], list(row["stopwords"]), list(row["extra"])


def _written(spark: SparkSession, root: str, papers: DataFrame, show: Sequence[str], mode: str, counted: DataFrame) -> DataFrame:
    """The documents written just now; of an index that is added to, the new datasets are read from the input's keys."""
    docs = spark.read.parquet(f"{root}/documents")
    if mode != "append":
        return docs
    return _join(docs, scratch_table(papers.select(*KEY), "index-added"), KEY, "left_semi")


def _queries(spark: SparkSession, queries: Sequence[str], stopwords, extra_stopwords) -> list[tuple[int, str, int, int]]:
    """(run, term, count, squared norm of the query) of query texts; bounded by the queries themselves."""
    said = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("run"), F.lit(q).alias("q")) for i, q in enumerate(queries, 1)])))
    out = []
    for r in said.select("run", tx.vector_tokens("q", stopwords, extra_stopwords).alias("t")).collect():
        counts = Counter(r["t"])
        norm = sum(c * c for c in counts.values())
        out += [(r["run"], t, c, norm) for t, c in sorted(counts.items())]
    return out


class _Search:
    """The plan of one search: postings of the queries' terms, bounds of their blocks, scores of chosen blocks."""

    def __init__(self, spark: SparkSession, path: str, queries: Sequence[str], threshold: float):
        if not threshold > 0:
            raise ValueError("an index finds documents that share a term: the threshold must be positive")
        self.threshold, root = threshold, path.rstrip("/")
        buckets, _, stopwords, extra = _settings(spark, root)
        wanted = _queries(spark, queries, stopwords, extra)
        terms = sorted({t for _, t, _, _ in wanted})
        kinds = dict(spark.read.parquet(f"{root}/documents").dtypes)
        self.order = _order(list(kinds))
        fields = ", ".join([*(f"{c}: {kinds[c]}" for c in self.order), "n: bigint", "ss: bigint"])
        # With its schema given, an index without terms can be read too.
        schema = f"term string, dataset {kinds['dataset']}, block string, docs array<struct<{fields}>>, peak double, bucket int"
        post = spark.read.schema(schema).parquet(f"{root}/postings").where(
            F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % buckets for t in terms})) & F.col("term").isin(terms))
        asked = spark.range(1).select(F.inline(F.array(*[
            F.struct(F.lit(r).alias("run"), F.lit(t).alias("term"), F.lit(c).alias("c"), F.lit(q).alias("q")) for r, t, c, q in wanted])
            .cast("array<struct<run: int, term: string, c: bigint, q: bigint>>")))
        self.post = post.join(F.broadcast(asked), "term")  # as many rows as the queries have terms

    def bounds(self) -> DataFrame:
        """run, dataset, block, bound, place (by bound, in the dataset) of blocks that may hold a hit."""
        bound = F.sum(F.col("c") * F.col("peak")) / F.sqrt(F.first("q")) * (1 + 1e-9)
        blocks = self.post.groupBy("run", "dataset", "block").agg(bound.alias("bound"))
        return blocks.where(F.col("bound") >= self.threshold * (1 - 1e-6))

    def scores(self, blocks: DataFrame) -> DataFrame:
        """run, dataset, paper_key, block, metric_match of the documents in ``blocks`` that pass the threshold."""
        some = _join(self.post, blocks.select("run", "dataset", "block"), ["run", "dataset", "block"], "left_semi")
        entries = some.select("run", "dataset", "block", "c", "q", F.inline("docs"))
        found = (entries.groupBy("run", "dataset", *self.order)
                 .agg(F.sum(F.col("c") * F.col("n")).alias("dot"), F.first("ss").alias("ss"), F.first("q").alias("q"), F.first("block").alias("block")))
        score = F.col("dot").cast("double") / F.sqrt(F.col("ss").cast("double") * F.col("q").cast("double"))
        passed = threshold_filter(found.withColumn("score", score), "score", self.threshold)
        return annotate(passed, self.threshold, 4).drop("score", "dot", "ss", "q")


def _best(scored: DataFrame, limit: int) -> DataFrame:
    return top_k_per_group(scored, ["run", "dataset"], [F.col("metric_match").desc(), *_order(scored.columns)], limit, fan_in=TOPK_FAN_IN)


def _steps(search: _Search, limit: int, first: int) -> tuple[DataFrame, DataFrame]:
    """Best documents of the first blocks, and all blocks with ``kept``: whether their lists must be read."""
    bounds = search.bounds()
    lead = top_k_per_group(bounds, ["run", "dataset"], [F.col("bound").desc(), F.col("block")], first, fan_in=TOPK_FAN_IN)
    best = _best(search.scores(lead), limit)
    least = (best.groupBy("run", "dataset").agg(F.count(F.lit(1)).alias("found"), F.min("metric_match").alias("least"))
             .where(F.col("found") >= limit).select("run", "dataset", "least"))
    marked = _join(bounds, lead.select("run", "dataset", "block", F.lit(True).alias("lead")), ["run", "dataset", "block"], "left")
    marked = _join(marked, least, ["run", "dataset"], "left").withColumn("lead", F.coalesce("lead", F.lit(False)))
    more = F.col("least").isNull() | (F.col("bound") >= F.col("least") - STEP)
    return best, marked.withColumn("kept", F.col("lead") | more)


def search_index(spark: SparkSession, path: str, queries: str | Sequence[str], limit: int = 10, threshold: float = 0.4,
                 first: int = FIRST) -> DataFrame:
    """Hits of one query, or of several (``run`` 1, 2, ...): keys, shown columns, metric_match, metric_thres, conference.
    At most ``limit`` rows a dataset (and run), ties by key."""
    several = not isinstance(queries, str)
    search = _Search(spark, path, list(queries) if several else [queries], threshold)
    best, blocks = _steps(search, limit, first)
    rest = search.scores(blocks.where(F.col("kept") & ~F.col("lead")))
    hits = _best(best.unionByName(rest), limit).drop("block", "pos")
    docs = spark.read.parquet(f"{path.rstrip('/')}/documents").drop("ss", "terms")
    out = _join(hits, docs, KEY)
    return out if several else out.drop("run")


def read_blocks(spark: SparkSession, path: str, query: str, limit: int = 10, threshold: float = 0.4, first: int = FIRST) -> DataFrame:
    """dataset, block, bound, kept of the blocks whose bound passes the threshold: what a search reads and what it skips."""
    search = _Search(spark, path, [query], threshold)
    return _steps(search, limit, first)[1].select("dataset", "block", "bound", "kept")
