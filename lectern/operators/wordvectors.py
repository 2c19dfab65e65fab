"""Word vectors learned from a corpus (SIM5): co-occurrence counts, positive pointwise mutual information, randomised SVD.

1. **Terms.**  Counted by the task and then by Spark, a term with how many tokens lie up to ``window`` places from it.  All terms with
   ``least`` occurrences are rows; the ``contexts`` most frequent of them (CONTEXTS at most, a documented bound) are columns.  What kept
   terms have beside kept terms is counted in a second pass: terms are hashed to PLACES places, of which every task knows two bits, whether
   a kept term and whether another one is there.  Only a term rare in its task whose place has both travels with its few neighbours;
   no task needs the list of all kept terms.
2. **Counts.**  A task counts the contexts near each of its terms and passes them on as short lists, three bytes an entry, unless the term is surely
   not kept; a term's lists meet, sorted, in one task, which adds them up in a row of at most ``contexts`` counts.
3. **PPMI.**  max(0, log(n(a, b) * n / (n(a) * n(b)))).  Rows keep the counts whose value is positive; the value is taken as they are read.
4. **SVD.**  The column space is found by subspace iteration: every task multiplies its rows with the current basis (contexts by
   dim + EXTRA numbers, broadcast; 13 MB at most for 64 dimensions) and adds up its part of R' R Q; Spark adds the parts block by block, and the
   driver, which only ever holds the basis, orthogonalises it.
5. **Vectors.**  A term's vector is its row times the leading right singular vectors; signs are fixed by the largest entry.

Tables that only the learning reads are removed at its end; the vectors are a table.

The seed, the order of contexts and the signs are fixed, so the same corpus gives the same vectors up to rounding.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import lean_writes, release, scratch_owner, scratch_table

CONTEXTS, EXTRA, ROUNDS, BLOCK = 20_000, 16, 6, 1024
#: Tokens that a task counts at once, entries of a list on its way, rows and entries that are multiplied at once; a row is multiplied as a
#: whole if one in DENSE of its columns has an entry.
TOKENS, LIST, GROUP, PART, DENSE = 1 << 20, 256, 256, 1 << 14, 64
#: Places that terms are hashed to, and how many of them travel in a row.
PLACES, TOGETHER = 1 << 26, 1 << 16
#: Parts in which a chunk's pairs of terms and contexts are counted.
DEALS = 4


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Terms, the tokens as their places there (from 1; 0: null) and each token's text, for about TOKENS tokens at a time."""
    held, sizes, n = [], [], 0

    def encoded() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        words, size = pa.concat_arrays(held).dictionary_encode(), np.concatenate(sizes)
        return words.dictionary, words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.repeat(np.arange(len(size)), size)

    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            said = batch.column(0).slice(at, GROUP)
            held.append(said.flatten())
            sizes.append(pc.list_value_length(said).fill_null(0).to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n >= TOKENS:
                yield encoded()
                held, sizes, n = [], [], 0
    if n:
        yield encoded()


def _near(tokens: np.ndarray, text: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and those 1 to ``window`` places from them in the same text, both ways round."""
    for apart in range(1, window + 1):
        same = text[apart:] == text[:-apart]
        a, b = tokens[:-apart][same], tokens[apart:][same]
        yield a, b
        yield b, a


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _terms(window: int):
    """term, n: how many tokens are near a term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, tokens, text in _chunks(batches):
            n = np.zeros(len(names) + 1, dtype=np.int64)
            for a, _ in _near(tokens, text, window):
                n += np.bincount(a, minlength=len(n))
            yield pa.RecordBatch.from_arrays([names, pa.array(n[1:])], ["term", "n"])

    return count


def _places(terms: pa.Array) -> np.ndarray:
    return (pd.util.hash_array(np.asarray(terms.to_numpy(zero_copy_only=False), dtype=object), categorize=False) % PLACES).astype(np.int64)


def _there(enough: int):
    """block, kept, other: places, within the block, of the task's terms with ``enough`` and of those with fewer."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column("term"))
            order = np.argsort(at, kind="stable")
            at, kept = at[order], batch.column("n").to_numpy()[order] >= enough
            first = np.flatnonzero(np.r_[len(at) > 0, np.diff(at // TOGETHER) != 0])
            some = [(pa.array(at[kind] % TOGETHER, pa.int32()), np.r_[0, np.cumsum(kind)][first]) for kind in (kept, ~kept)]
            yield pa.RecordBatch.from_arrays([pa.array(at[first] // TOGETHER, pa.int32()), *(_lists(*x) for x in some)], ["block", "kept", "other"])

    return place


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, bits: two a place; rows of a block come to one task."""
    total = {}
    for batch in batches:
        for block, *kinds in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            there = total.setdefault(block, np.zeros(TOGETHER, dtype=np.uint8))
            for bit, at in enumerate(kinds):
                there[at.values.to_numpy()] |= 1 << bit
    if total:
        packed = [(x[::4] | x[1::4] << 2 | x[2::4] << 4 | x[3::4] << 6).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array(packed, pa.binary())], ["block", "bits"])


def kept_places(terms: DataFrame, enough: int) -> np.ndarray:
    """Two bits a place, four places a byte: whether a term (term, n) with ``enough`` is there, and whether another one is."""
    found = terms.mapInArrow(_there(enough), "block int, kept array<int>, other array<int>").repartition("block")
    places = np.zeros(PLACES // 4, dtype=np.uint8)
    for r in found.mapInArrow(_bits, "block int, bits binary").collect():
        places[r["block"] * (TOGETHER // 4):(r["block"] + 1) * (TOGETHER // 4)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return places


def _kinds(terms: pa.Array, places: np.ndarray) -> np.ndarray:
    """1: a kept term, 2: not kept, 3: may be either; 0 for null, which comes first."""
    at = _places(terms)
    return np.r_[0, places[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3]


def _own(window: int, enough: int, shared):
    """term, own, near, for terms that may be kept: how many surely kept terms are near a term, and, if it may be either kind, what is near it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, tokens, text in _chunks(batches):
            kind, (n, own) = _kinds(names, shared.value), np.zeros((2, len(names) + 1), dtype=np.int64)
            for a, _ in _near(tokens, text, window):
                n += np.bincount(a, minlength=len(n))
            kind[(kind == 3) & (n >= enough)] = 1
            sure, either, maybe = kind == 1, kind == 3, kind & 1 > 0
            lists = []
            for a, b in _near(tokens, text, window):
                own += np.bincount(a[sure[b]], minlength=len(n))
                some = either[a] & maybe[b]
                lists.append((a[some], b[some]))
            a, b = (np.concatenate(x) for x in zip(*lists))
            near = names.take(pa.array(b[np.argsort(a, kind="stable")] - 1))
            starts = np.r_[0, np.cumsum(np.bincount(a, minlength=len(n)))[:-1]]
            yield pa.RecordBatch.from_arrays([names, pa.array(own[1:]), _lists(near, starts[1:])], ["term", "own", "near"]).filter(pa.array(maybe[1:]))

    return count


def kept_terms(said: DataFrame, window: int, least: int) -> tuple[DataFrame, np.ndarray]:
    """term, n, own of the terms with ``least`` occurrences in ``said`` (tokens): how many tokens are at most ``window`` places from them,
    and how many of those are kept terms; and the places of terms."""
    enough, context = max(2 * window * least, 1), said.sparkSession.sparkContext
    terms = scratch_table(said.mapInArrow(_terms(window), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "vectors-terms")
    places = kept_places(terms, enough)
    found = said.mapInArrow(_own(window, enough, context.broadcast(places)), "term string, own long, near array<string>")
    found = scratch_table(found.groupBy("term").agg(F.sum("own").alias("own"), F.flatten(F.collect_list("near")).alias("near"))
                          .join(terms.where(F.col("n") >= enough), "term"), "vectors-near")
    more = found.select(F.explode("near").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("more"))
    kept = found.join(more, "term", "left").select("term", "n", (F.col("own") + F.coalesce("more", F.lit(0))).alias("own"))
    return scratch_table(kept, "vectors-kept"), places


def _listed(terms: pa.Array, width: int, pairs: np.ndarray, ns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """term, own (null), ids, ns of sorted pairs of a term's place and a context."""
    if len(pairs):
        a, ids = np.divmod(pairs, pairs.dtype.type(width))
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        starts = np.flatnonzero(place % LIST == 0)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(a[starts].astype(np.int64) - 1)), pa.nulls(len(starts), pa.int64()),
                                          _lists(pa.array(ids.astype(np.int32)), starts), _lists(pa.array(ns, pa.int64()), starts)], ["term", "own", "ids", "ns"])


def _contexts(window: int, names, places=None):
    """term, own (null), ids, ns: how often each context is near a term that may be kept, in lists of at most LIST contexts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pd.Index(names.value)
        for terms, tokens, text in _chunks(batches):
            ids = np.r_[-1, index.get_indexer(terms.to_numpy(zero_copy_only=False))]
            maybe = np.arange(len(terms) + 1) > 0 if places is None else _kinds(terms, places.value) & 1 > 0
            kind = np.uint32 if len(maybe) * len(index) < 1 << 32 else np.int64
            for deal in range(DEALS):  # terms in turn: all pairs of a chunk at once are hundreds of MB
                here = maybe & (np.arange(len(maybe)) % DEALS == deal)
                pairs = [(a[some] * len(index) + ids[b[some]]).astype(kind) for a, b in _near(tokens, text, window) for some in [(ids[b] >= 0) & here[a]]]
                yield from _listed(terms, len(index), *np.unique(np.concatenate(pairs), return_counts=True))

    return count


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def _packed(lists):
    """Lists as bytes: two for a context and one for a count; a larger count is several entries, which are added up anyway."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lists(batches):
            ids, ns = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "ns"))
            times = -(-ns // 255)
            split = np.full(times.sum(), 255, dtype=np.uint8)
            split[np.cumsum(times) - 1] = ns - 255 * (times - 1)
            size = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(times)][np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("own"), _binary(np.repeat(ids, times).astype(np.uint16), starts),
                                              _binary(split, starts)], ["term", "own", "ids", "ns"])

    return pack


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            lists = []
            for c, kind, to in (("ids", np.uint16, pa.int32()), ("ns", np.uint8, pa.int64())):
                some = batch.column(c).fill_null(b"")
                offsets = np.frombuffer(some.buffers()[1], dtype=np.int32)[some.offset:some.offset + len(some) + 1]
                held = some.buffers()[2]
                values = np.frombuffer(held, dtype=np.uint8)[offsets[0]:offsets[-1]] if held is not None and held.size else np.zeros(0, dtype=np.uint8)
                lists.append(_lists(pa.array(values.view(kind).astype(np.int64), to), (offsets[:-1] - offsets[0]) // np.dtype(kind).itemsize))
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("own"), *lists], ["term", "own", "ids", "ns"])


def _ratio(own: np.ndarray, ids: np.ndarray, ns: np.ndarray, total: int, others: np.ndarray) -> np.ndarray:
    """How many times as often as by chance."""
    return ns.astype(float) * total / (own.astype(float) * others[ids])


def _added(total: int, shared):
    """term, own, ids, ns of the kept terms, with the contexts that are near more often than by chance.  Rows come sorted by
    term, of a kept term first the one with ``own``, then its lists."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = shared.value
        last = None  # the last term so far, which may go on: its term, own, ids and ns

        def runs(batch: pa.RecordBatch):
            """Term and own of each run of a term, and run, context and count of its entries, added up."""
            terms, own, ids, ns = (batch.column(c) for c in ("term", "own", "ids", "ns"))
            new = np.r_[True, pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False)]
            size = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.repeat(np.cumsum(new) - 1, size) * len(others) + ids.flatten().to_numpy(zero_copy_only=False)
            ns, order = ns.flatten().to_numpy(zero_copy_only=False), np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[len(at) > 0, np.diff(at[order]) != 0])
            ns = np.add.reduceat(ns[order], first) if len(first) else ns
            run, ids = np.divmod(at[order][first], len(others))
            return terms.filter(pa.array(new)), own.filter(pa.array(new)).fill_null(0).to_numpy(zero_copy_only=False), run, ids, ns

        def rows(terms: pa.Array, own: np.ndarray, run: np.ndarray, ids: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
            some = own[run] > 0
            some[some] = _ratio(own[run[some]], ids[some], ns[some], total, others) > 1
            run, ids, ns = run[some], ids[some], ns[some]
            starts = np.flatnonzero(np.r_[len(run) > 0, run[1:] != run[:-1]])
            return pa.RecordBatch.from_arrays([terms.take(pa.array(run[starts])), pa.array(own[run[starts]]), _lists(pa.array(ids, pa.int32()), starts),
                                               _lists(pa.array(ns, pa.int64()), starts)], ["term", "own", "ids", "ns"])

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                if last is not None:
                    batch = pa.Table.from_batches([last, batch.cast(last.schema)]).combine_chunks().to_batches()[0]
                terms, own, run, ids, ns = runs(batch)
                end, tail = len(terms) - 1, run == len(terms) - 1
                yield rows(terms, own, run[~tail], ids[~tail], ns[~tail])
                last = pa.RecordBatch.from_arrays([terms.slice(end), pa.array(own[end:]), _lists(pa.array(ids[tail], pa.int32()), np.array([0])),
                                                   _lists(pa.array(ns[tail], pa.int64()), np.array([0]))], ["term", "own", "ids", "ns"])
        if last is not None:
            yield rows(*runs(last))

    return add


def context_rows(said: DataFrame, window: int, kept: DataFrame, names: list[str], others: np.ndarray, total: int, places: np.ndarray) -> DataFrame:
    """term, own, ids, ns of the ``kept`` terms (term, own): which contexts (``names``, of ``others`` tokens near) are near them more often than
    by chance, of ``total`` in all, and how often."""
    context = said.sparkSession.sparkContext
    schema, packed = "term string, own long, ids array<int>, ns array<long>", "term string, own long, ids binary, ns binary"
    near = said.mapInArrow(_packed(_contexts(window, context.broadcast(np.array(names, dtype=object)), context.broadcast(places))), packed)
    own = kept.select("term", "own", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("ns"))
    met = own.unionByName(near).repartition("term").sortWithinPartitions("term", F.col("own").desc_nulls_last())
    add, others = _added, context.broadcast(others)
    return met.mapInArrow(lambda batches: add(total, others)(_unpacked(batches)), schema)


def _groups(batches: Iterator[pa.RecordBatch], total: int, others: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms, sizes of their rows, and columns and values of the rows' entries, for rows with many entries and those with few apart."""
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            some = batch.slice(at, GROUP)
            size = pc.list_value_length(some.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, ns = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "ns"))
            x = np.log(_ratio(np.repeat(some.column("own").to_numpy(zero_copy_only=False), size), ids, ns, total, others))
            many = size * DENSE > len(others)
            for kind in (many, ~many):
                if kind.any():
                    entry = np.repeat(kind, size)
                    yield some.column("term").filter(pa.array(kind)), size[kind], ids[entry].astype(np.int64), x[entry]


def _times(size: np.ndarray, ids: np.ndarray, x: np.ndarray, basis: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """The rows R times the basis; ``total``, if given, gets R' R times the basis added.  Rows with many entries are multiplied as a matrix."""
    row = np.repeat(np.arange(len(size)), size)
    if len(ids) * DENSE > len(size) * len(basis):
        dense = np.zeros((len(size), len(basis)))
        dense[row, ids] = x
        out = dense @ basis
        if total is not None:
            total += dense.T @ out
        return out
    out = np.zeros((len(size), basis.shape[1]))
    for at in range(0, len(ids), PART):
        part = slice(at, at + PART)
        _add(out, row[part], x[part], basis, ids[part])
    if total is not None:
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(ids), PART):
            part = order[at:at + PART]
            _add(total, ids[part], x[part], out, row[part])
    return out


def _add(out: np.ndarray, to: np.ndarray, x: np.ndarray, values: np.ndarray, of: np.ndarray) -> None:
    """Adds x times the rows ``of`` the values to the rows ``to``, which are sorted."""
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    out[to[first]] += np.add.reduceat(x[:, None] * values[of], first, axis=0)


def _gram_step(rows: DataFrame, basis: np.ndarray, n: int, shared) -> np.ndarray:
    """R' R times the basis: tasks add up their rows' parts, Spark adds the tasks', by blocks of contexts."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        total, some = np.zeros_like(q), False
        for _, size, ids, x in _groups(batches, n, shared.value):
            _times(size, ids, x, q, total)
            some = True
        if some:
            for block in range(0, len(total), BLOCK):
                values = pa.array(total[block:block + BLOCK].ravel())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), _lists(values, np.array([0]))], ["block", "values"])

    def add(key, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "values": [np.sum(np.stack(parts["values"]), axis=0)]})

    # One row a task and block; a block of all tasks is added up in one group, BLOCK rows of the basis from each.
    summed = rows.mapInArrow(part, "block int, values array<double>").groupBy("block").applyInPandas(add, "block int, values array<double>")
    out = np.zeros_like(basis)
    for r in summed.collect():  # at most CONTEXTS / BLOCK rows, as large as the basis in all
        values = np.array(r["values"]).reshape(-1, basis.shape[1])
        out[r["block"]:r["block"] + len(values)] = values
    return out


def learn(texts: DataFrame, tokens: Column, dim: int = 64, window: int = 4, least: int = 5, contexts: int = CONTEXTS, seed: int = 1) -> DataFrame:
    """term, vector (at most ``dim`` numbers) for the terms that occur at least ``least`` times near others, and with one of the
    contexts more often than by chance."""
    if not 0 < contexts <= CONTEXTS:
        raise ValueError(f"contexts must be in 1 to {CONTEXTS}")
    spark = texts.sparkSession
    if window < 1:
        return spark.createDataFrame([], "term string, vector array<double>")
    job = f"vectors-{uuid.uuid4().hex}"
    try:
        with lean_writes(spark):
            with scratch_owner(job):
                vectors = _learned(texts.select(tokens.alias("tokens")), dim, window, least, contexts, seed)
            return scratch_table(vectors, "vectors-learned")
    finally:
        release(spark, job)


def _learned(texts: DataFrame, dim: int, window: int, least: int, contexts: int, seed: int) -> DataFrame:
    spark, said = texts.sparkSession, scratch_table(texts, "vectors-tokens")
    kept, places = kept_terms(said, window, least)
    columns = kept.orderBy(F.col("n").desc(), "term").limit(contexts).select("term", "own").collect()
    width = len(columns)
    size = min(dim + EXTRA, width)
    if not size:
        return spark.createDataFrame([], "term string, vector array<double>")
    others, total = np.array([r["own"] for r in columns], dtype=float), kept.agg(F.sum("own")).first()[0]
    rows = scratch_table(context_rows(said, window, kept, [r["term"] for r in columns], others, total, places), "vectors-rows")
    counts = spark.sparkContext.broadcast(others)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(_gram_step(rows, basis, total, counts))
    # The small matrix Q' R' R Q has the squared singular values.
    values, turn = np.linalg.eigh(basis.T @ _gram_step(rows, basis, total, counts))
    leading = np.argsort(-values, kind="stable")[:dim]
    leading = leading[values[leading] > 1e-9 * max(values.max(), 1e-300)]
    right = basis @ turn[:, leading]
    right *= np.sign(right[np.abs(right).argmax(axis=0), np.arange(right.shape[1])])
    shared = spark.sparkContext.broadcast(right)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for terms, size, ids, x in _groups(batches, total, counts.value):
            vectors = _times(size, ids, x, shared.value)
            yield pa.RecordBatch.from_arrays([terms, _lists(pa.array(vectors.ravel()), np.arange(len(terms)) * vectors.shape[1])], ["term", "vector"])

    return rows.mapInArrow(project, "term string, vector array<double>")
