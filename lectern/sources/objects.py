"""Large dataset files: one JSON object of any size, read by many tasks and written by many (SRC1, SRC2, SNK1).

``read_large_objects`` reads ``{"key": paper, ...}`` with Spark's own text source, whose records end at every ``}`` here, so that a
file is cut into splits like any other text and lies in any store that Spark reads.  What a split cannot know by itself is
whether it starts inside a string, and how deep.

1. Each split is scanned once under both assumptions: how the string state, the depth and the least depth come out.
2. These short summaries, one a split, are put in order (file, offset) and give the true state at each start.
3. Each split is scanned again from its true state and cut at the commas between the entries of the object.  An entry that crosses splits
   is put together from its pieces; only these pieces are shuffled.
4. Entries are parsed natively, in file order; of repeated keys the last value counts, at the place of the first.

``write_object_parts`` writes a dataset as one such object in parts: sorted by position over many tasks, the first row opens the
object, the last one closes it, so no task holds a dataset.  The parts, one after the other, are the object; ``single_files`` sends
each dataset through one task, which streams it into one file.

Defined cases: a text that is no object, or whose object is not closed, gives no rows; what follows the object is ignored; an entry that is no
JSON is left out; strings are in double quotes; an empty object or table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.ranking import dense_position
from lectern.session import scratch_table
from lectern.sources.papers import dataset_name
from lectern.sources.sinks import JSON_OPTIONS, format_timestamps

#: Characters that are scanned together, and splits whose states are broadcast (some 100 bytes each).
BUFFER, MAX_SPLITS = 1 << 20, 500_000
STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
REST_OF_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"?|[{}\[\],]', re.S)
STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def scan(text: str, inside: bool) -> tuple[bool, int, int]:
    """(inside a string at the end, change of depth, least depth on the way) of a text that starts inside a string or not."""
    if inside:
        end = REST_OF_STRING.match(text)
        if end is None:
            return True, 0, 0
        text = text[end.end():]
    bare = STRING.sub("", text)
    at = bare.find('"')
    if at >= 0:
        bare = bare[:at]
    depth = least = 0
    for c in re.findall(r"[{}\[\]]", bare):
        depth += STEP[c]
        least = min(least, depth)
    return at >= 0, depth, least


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, offset of the split), text) in reading order, a bounded number of characters at a time."""
    here, held, size = None, [], 0
    for batch in batches:
        for path, start, value in zip(*(batch.column(i) for i in range(3))):
            place = path.as_py(), start.as_py()
            if held and (place != here or size >= BUFFER):
                yield here, "".join(held)
                held, size = [], 0
            here = place
            held.append(value.as_py() + "}")
            size += len(held[-1])
    if held:
        yield here, "".join(held)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, start, and for both assumptions: inside, depth, least."""
    def row(place, states):
        flat = [x for s in states for x in s]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*place, *flat)], ["path", "start", "in0", "depth0", "least0", "in1", "depth1", "least1"])

    here, states = None, None
    for place, text in _buffers(batches):
        if place != here:
            if here is not None:
                yield row(here, states)
            here, states = place, [(False, 0, 0), (True, 0, 0)]
        for i, (inside, depth, least) in enumerate(states):
            now, more, low = scan(text, inside)
            states[i] = now, depth + more, min(least, depth + low)
    if here is not None:
        yield row(here, states)


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each split of one object; closed: the object has ended before.  Nothing if it never ends."""
    rows = rows.sort_values(["path", "start"])
    inside, depth, closed, out = False, 0, False, []
    for i, r in enumerate(rows.itertuples()):
        out.append((r.dataset, r.path, r.start, i, inside, depth, closed))
        more, least = (r.depth1, r.least1) if inside else (r.depth0, r.least0)
        closed = closed or (depth + least <= 0 and (i > 0 or depth + more <= 0 or least < 0))
        inside, depth = bool(r.in1 if inside else r.in0), depth + more
    return pd.DataFrame(out if closed else [], columns=["dataset", "path", "start", "split", "inside", "depth", "closed"])


def _entries(states):
    """(dataset, split, nth, text, last): the pieces of entries of each split, cut at the commas between entries."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        for place, text in _buffers(batches):
            if place != here:
                if state is not None:
                    yield state.rest()
                here = place
                state = _Split(*states.value[place]) if place in states.value else None
            if state is not None:
                yield state.cut(text)
        if state is not None:
            yield state.rest()

    return cut


class _Split:
    def __init__(self, dataset: str, split: int, inside: bool, depth: int, closed: bool):
        self.dataset, self.split, self.inside, self.depth = dataset, split, inside, depth
        self.ended, self.begun = closed, depth > 0 or inside
        self.nth, self.held = 0, []

    def _batch(self, rows: list) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))],
                                          ["dataset", "split", "nth", "text", "last"])

    def cut(self, text: str) -> pa.RecordBatch:
        rows: list = []
        if self.ended:
            return self._batch(rows)
        at = start = 0
        if self.inside:
            end = REST_OF_STRING.match(text)
            at = end.end() if end else len(text)
            self.inside = end is None
        if not self.begun and not self.inside:
            lead = len(text) - len(text.lstrip())
            if lead < len(text) and text[lead] != "{":
                self.ended = True  # no object
                return self._batch(rows)
        for token in TOKEN.finditer(text, at):
            c = token.group()
            if c[0] == '"':
                self.inside = len(c) == 1 or c[-1] != '"' or not STRING.fullmatch(c)
            elif c == ",":
                if self.depth == 1:
                    rows.append((self.dataset, self.split, self.nth, "".join(self.held) + text[start:token.start()], False))
                    self.held, start, self.nth = [], token.end(), self.nth + 1
            else:
                self.depth += STEP[c]
                if not self.begun:
                    self.begun, start = True, token.end()
                elif self.depth == 0:
                    rows.append((self.dataset, self.split, self.nth, "".join(self.held) + text[start:token.start()], True))
                    self.held, self.ended = [], True
                    return self._batch(rows)
        self.held.append(text[start:])
        return self._batch(rows)

    def rest(self) -> pa.RecordBatch:
        """What the split holds of an entry that goes on in the next one."""
        rows = [] if self.ended or not self.begun else [(self.dataset, self.split, self.nth, "".join(self.held), True)]
        return self._batch(rows)


def _read(spark: SparkSession, paths: str | Iterable[str], in_parts: bool) -> DataFrame:
    """dataset, pos, text of all entries."""
    raw = spark.read.text([paths] if isinstance(paths, str) else list(paths), lineSep="}", recursiveFileLookup=in_parts)
    path = F.col("_metadata.file_path")
    raw = raw.select(path.alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    if in_parts:
        # Of a part, what follows its last brace is the line end, to which no brace belongs.  (At the end of a whole file one too many does no harm.)
        raw = raw.where(F.col("value") != "\n")
    name = F.url_decode(F.url_decode(F.regexp_extract("path", r"/dataset=([^/]+)/[^/]*$", 1))) if in_parts else dataset_name(F.col("path"))
    found = raw.mapInArrow(_summaries, "path string, start bigint, in0 boolean, depth0 bigint, least0 bigint, in1 boolean, depth1 bigint, least1 bigint")
    # The parts of an object are chained in the order of their names; files are objects of their own.
    group = ["dataset"] if in_parts else ["dataset", "path"]
    chained = found.withColumn("dataset", name).groupBy(*group).applyInPandas(
        _chained, "dataset string, path string, start bigint, split bigint, inside boolean, depth bigint, closed boolean")
    starts = chained.limit(MAX_SPLITS + 1).collect()
    if len(starts) > MAX_SPLITS:
        raise ValueError("too many splits: raise spark.sql.files.maxPartitionBytes")
    states = spark.sparkContext.broadcast({(r["path"], r["start"]): (r["dataset"] if in_parts else r["path"], r["split"], r["inside"], r["depth"], r["closed"])
                                           for r in starts})
    pieces = raw.mapInArrow(_entries(states), "dataset string, split bigint, nth bigint, text string, last boolean")
    pieces = scratch_table(pieces, "object-pieces")
    # Commas in the splits before make the number of an entry.
    counts = pieces.groupBy("dataset", "split").agg(F.max("nth").alias("commas"))
    before = Window.partitionBy("dataset").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("dataset", "split", F.coalesce(F.sum("commas").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(F.broadcast(base), ["dataset", "split"]).withColumn("pos", F.col("base") + F.col("nth"))
    alone = placed.where("nth > 0 AND NOT last").select("dataset", "pos", "text")
    # First and last pieces of splits: at most two a split.
    ends = (placed.where("nth = 0 OR last").groupBy("dataset", "pos")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "").alias("text")))
    out = alone.unionByName(ends)
    return out if in_parts else out.withColumn("dataset", dataset_name(F.col("dataset")))


def read_large_objects(spark: SparkSession, paths: str | Iterable[str], in_parts: bool = False) -> DataFrame:
    """dataset, pos, paper_key, paper_json of dataset files, each one JSON object of any size (``in_parts``: of folders
    ``dataset=<name>`` that ``write_object_parts`` wrote, below ``paths``).  ``pos`` is in file order; it has gaps where repeated keys went."""
    entries = _read(spark, paths, in_parts).where("trim(text) != ''")
    parsed = entries.select("dataset", "pos", F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>")).alias("paper_key", "paper_json"))
    parsed = scratch_table(parsed, "object-entries")
    # Repeated keys are few: the values of all others are not shuffled unless there are many.
    again = parsed.groupBy("dataset", "paper_key").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("final")).where("n > 1")
    same = [F.col("dataset") == F.col("_dataset"), F.col("paper_key") == F.col("_key")]
    again = again.select(F.col("dataset").alias("_dataset"), F.col("paper_key").alias("_key"), "first", "final")
    joined = parsed.join(again, same, "left").where("final IS NULL OR pos = final")
    return joined.select("dataset", F.coalesce("first", "pos").cast("int").alias("pos"), "paper_key", "paper_json")


def write_object_parts(df: DataFrame, path: str, key: str = "paper_key", order: str = "pos", dataset: str = "dataset",
                       single_files: bool = False) -> None:
    """Write each dataset of ``df`` as one JSON object ``{key: paper}`` in the order of ``order`` (unique in a dataset), under
    ``dataset=<name>/`` as text parts that follow one another in the order of their names."""
    fields = [c for c in df.columns if c not in (dataset, key, order)]
    rows = format_timestamps(df)
    entry = F.to_json(F.create_map(F.col(key).cast("string"), F.struct(*fields)), JSON_OPTIONS)
    rows = rows.select(F.col(dataset).alias("dataset"), F.col(order).alias("_order"), F.substr(entry, F.lit(2), F.length(entry) - 2).alias("_entry"))
    placed = scratch_table(dense_position(rows, "dataset", "_order", "_at"), "object-rows")
    ends = placed.groupBy("dataset").agg(F.max("_at").alias("_end")).withColumnRenamed("dataset", "_name")
    lined = placed.join(ends, F.col("dataset").eqNullSafe(F.col("_name")))
    value = F.concat(F.when(F.col("_at") == 0, F.lit("{")).otherwise(F.lit(",")), "_entry", F.when(F.col("_at") == F.col("_end"), F.lit("}")).otherwise(F.lit("")))
    lines = lined.select("dataset", "_at", value.alias("value"))
    dealt = lines.repartition("dataset") if single_files else lines.repartitionByRange("dataset", "_at")
    (dealt.sortWithinPartitions("dataset", "_at").drop("_at").write.mode("overwrite").partitionBy("dataset").text(path))
