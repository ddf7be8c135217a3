"""Shingle counts, unique words and similarity joins over a table of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelumen.functions import text as T
from sitelumen.operators.containment import likeness
from sitelumen.operators.store import settle, small

#: Bytes of text whose hashes fill a bucket, which is one task's work: some 4 million; hashes that a task gathers before it deals them.
BUCKET_BYTES, DEAL_HASHES = 24 << 20, 2_000_000
#: The bit that marks a hash that its text has had before.
_AGAIN = np.uint32(1 << 31)


def _buckets(texts: DataFrame, text: str) -> int:
    return max(1, -(-(texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BUCKET_BYTES))


def _listed(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of arrays, one after the other, and each array's length."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending hashes; a bucket is a range of them."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(keys)).tolist() if len(keys) else []
    return [(int(bucket[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The same rows, by some DEAL_HASHES entries of ``column`` or one batch."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(column).flatten())
        if n >= DEAL_HASHES:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _in_buckets(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """Rows of a partition as tuples, bucket by bucket; they are few and packed."""
    rows: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            rows.setdefault(row[0], []).append(row)
    while rows:
        yield rows.popitem()[1]


def _one(rows: pa.Table, name: str) -> pa.Array:
    out = rows.column(name).combine_chunks()
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def held_by(rows: DataFrame, least: int, buckets: int, made: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What ``made`` makes of batches of ``rows`` (id, n, hashes): of ids, n, the number of each one's hashes, and of those that ``least``
    rows hold or more their places in the batch, ascending, the hashes, and how many rows hold each.

    Hashes go to buckets with their places, as packed arrays; buckets send back, packed too, only the places of those that many hold. A
    hash moves once, in 12 bytes; a bucket is one task's work.
    """
    kind = f"bucket long, batch long, keys binary, places binary, docs binary, ids array<{rows.schema['id'].dataType.simpleString()}>, ns array<long>, sizes array<long>"
    names = [c.split()[0] for c in kind.split(", ")]

    def table(**columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"bucket": pa.int64(), "batch": pa.int64(), "keys": pa.binary(), "places": pa.binary(), "docs": pa.binary(), "ids": pa.list_(ids_kind[0]), "ns": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), kinds[c]) for c in names], names)

    ids_kind: list[pa.DataType] = []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, held in enumerate(_gathered(batches, "hashes")):
            ids_kind[:] = [held.schema.field("id").type]
            keys, sizes = _listed(_one(held, "hashes"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((doc, keys))
            keys, doc, place = keys[order], doc[order], order.astype(np.uint32)
            place[1:][(keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])] |= _AGAIN
            cut = _cut(keys, buckets)
            if cut:
                yield table(bucket=[x[0] for x in cut], batch=[first + k] * len(cut), keys=[keys[a:b].tobytes() for _, a, b in cut], places=[place[a:b].tobytes() for _, a, b in cut])
            yield table(bucket=[(first + k) % buckets], batch=[first + k], ids=[held.column("id").to_pylist()], ns=[held.column("n").to_pylist()], sizes=[sizes.tolist()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def through() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids_kind[:] = [batch.schema.field("ids").type.value_type]
                told.append(batch.filter(batch.column("keys").is_null()))
                yield batch.filter(batch.column("keys").is_valid())

        told: list[pa.RecordBatch] = []
        for pieces in _in_buckets(through(), "bucket", "batch", "keys", "places"):
            keys = np.frombuffer(b"".join([x[2] for x in pieces]), np.uint64)
            places = np.frombuffer(b"".join([x[3] for x in pieces]), np.uint32)
            whose = np.repeat(np.arange(len(pieces)), [len(x[2]) // 8 for x in pieces])
            order = np.argsort(keys, kind="stable")
            begin = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
            docs = np.add.reduceat((places[order] < _AGAIN).astype(np.int64), begin)
            held = np.zeros(len(keys), np.uint32)
            held[order] = np.repeat(docs, np.diff(np.append(begin, len(keys))))
            chosen = np.flatnonzero(held >= least)
            edges = np.searchsorted(whose[chosen], np.arange(len(pieces) + 1)).tolist()
            kept = [(pieces[i][1], chosen[a:b]) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            if kept:
                yield table(batch=[b for b, _ in kept], keys=[keys[x].tobytes() for _, x in kept], places=[(places[x] & ~_AGAIN).tobytes() for _, x in kept], docs=[held[x].tobytes() for _, x in kept])
        yield from told

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def through() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids_kind[:] = [batch.schema.field("ids").type.value_type]
                yield batch

        for pieces in _in_buckets(through(), "batch", "keys", "places", "docs", "ids", "ns", "sizes"):
            keys, places, docs = (np.frombuffer(b"".join([x[c] for x in pieces if x[1] is not None]), kind) for c, kind in ((1, np.uint64), (2, np.uint32), (3, np.uint32)))
            order = np.argsort(places)
            ids, ns, sizes = next(x[4:] for x in pieces if x[1] is None)
            yield made(pa.array(ids, ids_kind[0]), np.array(ns), np.array(sizes, np.int64), places[order].astype(np.int64), keys[order], docs[order])

    return rows.select("id", F.col("n").cast("long").alias("n"), "hashes").mapInArrow(deal, kind).repartition(buckets, "bucket").mapInArrow(meet, kind).repartition(buckets, "batch").mapInArrow(gather, schema)


def shingle_sets(texts: DataFrame, id: str, text: str, width: int = 5, least_words: int = 0) -> DataFrame:
    """(id, set): the hashes of each text's different shingles; texts of fewer words, or none, are left out.

    A filter on ``set`` would be pushed below it and evaluate it for every window; filter on words instead."""
    rows = texts.select(F.col(id).alias("id"), T.plain_words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    return rows.where(F.size("w") >= max(1, least_words)).select("id", T.shingles(F.col("w"), width).alias("set"))


def _known(texts: DataFrame, id: str, text: str, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(id, copy) of each text, settled, and (copy, first, copies) of each different text, settled.

    ``copy`` tells texts apart by hashes of 96 bits and the length, so that no text moves.
    """
    copy = F.struct(F.xxhash64(text).alias("h"), F.crc32(F.col(text).cast("binary")).alias("c"), F.length(text).alias("n"))
    rows = texts.where(F.col(text).isNotNull()).where(F.size(T.plain_words(F.col(text))) >= max(1, least_words))
    rows = settle(rows.select(F.col(id).alias("id"), copy.alias("copy")))
    return rows, settle(rows.groupBy("copy").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")))


def _pairs(texts: DataFrame, known: DataFrame, id: str, text: str, least: float, least_words: int, width: int) -> DataFrame:
    """(a, b, similarity), a < b, of the ``first`` ones of ``known``. Sets are worked out twice: all of them, and those that may be similar to another."""
    sets = shingle_sets(texts.where(F.col(text).isNotNull()), id, text, width, least_words)

    def prefixes(ids: pa.Array, n: np.ndarray, sizes: np.ndarray, places: np.ndarray, keys: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(sizes)), sizes)[places]
        order = np.lexsort((keys.view(np.int64), docs, doc))
        doc, keys = doc[order], keys[order].view(np.int64)
        shared = np.bincount(doc, minlength=len(sizes))
        # Hashes of one text alone join nobody; they count in the order, before all shared ones.
        first = np.maximum(0, sizes - np.ceil(least * sizes).astype(np.int64) + 1 - (sizes - shared))
        chosen = np.arange(len(doc)) - (np.cumsum(shared) - shared)[doc] < first[doc]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc[chosen])), pa.array(sizes[doc[chosen]]), pa.array(keys[chosen])], ["id", "n", "h"])

    # The set's size is not asked for beside it: a filter on it would be pushed below, and evaluate it for every window.
    kind = texts.schema[id].dataType.simpleString()
    keys = held_by(sets.select("id", F.lit(0).alias("n"), F.col("set").alias("hashes")), 2, _buckets(texts, text), prefixes, f"id {kind}, n long, h long")
    keys = settle(keys.join(known.select(F.col("first").alias("id")), "id", "left_semi"))
    a, b = (keys.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), "h") for k in "ab")
    close = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    pairs = settle(a.join(b, "h").where(close).select(F.col("a").alias("i"), F.col("b").alias("j")).distinct())
    asked = settle(pairs.select(F.explode(F.array("i", "j")).alias("_asked")).distinct())
    met = shingle_sets(texts.where(F.col(text).isNotNull()).join(small(asked), F.col(id) == F.col("_asked"), "left_semi"), id, text, width, least_words)
    return likeness(pairs, settle(met.select(F.col("id").alias("page"), "set"))).where(F.col("similarity") >= least).select(F.col("i").alias("a"), F.col("j").alias("b"), "similarity")


def similar_pairs(texts: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.7, least_words: int = 60, width: int = 5) -> DataFrame:
    """(a, b, similarity), a < b: pairs of different texts, each by its smallest id, with Jaccard similarity ``least`` or more.

    Two sets that similar share one of their first n - ceil(least * n) + 1 hashes in a common order, so only those are
    joined: no pair is lost, and equal texts are one. Ordering by rarity keeps a common passage out of those first
    hashes: it lies behind the rare ones, so hot shingles join nobody unless a text has nothing else.
    """
    return _pairs(texts, _known(texts, id, text, least_words)[1], id, text, least, least_words, width)


def most_similar(texts: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.7, least_words: int = 60, width: int = 5) -> DataFrame:
    """(id, similarity) of each text that has another one, equal or similar, of ``least`` or more: the highest similarity. ``id`` is unique."""
    rows, known = _known(texts, id, text, least_words)
    pairs = _pairs(texts, known, id, text, least, least_words, width)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("first"), "similarity").groupBy("first").agg(F.max("similarity").alias("best"))
    best = known.join(ends, "first", "left").select("copy", F.when(F.col("copies") > 1, 1.0).otherwise(F.col("best")).alias("similarity"))
    return rows.join(best.where("similarity IS NOT NULL"), "copy").select("id", "similarity")


def positions(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, pos, word): each word of each text, lower-case."""
    w = F.transform(T.words(F.col(text)), F.lower)
    return texts.select(F.col(id).alias("id"), w.alias("w")).select("id", F.size("w").alias("n"), F.posexplode_outer("w").alias("pos", "word")).where("pos IS NOT NULL")


def shingle_frequency(texts: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(shingle, docs): the number of texts that hold each window of words, by its hash. One shuffle, of packed hashes and counts."""
    buckets = _buckets(texts, text)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, "hashes"):
            keys, counts = np.unique(_listed(_one(held, "hashes"))[0], return_counts=True)
            cut, counts = _cut(keys, buckets), counts.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in cut], pa.int64()), *(pa.array([x[a:b].tobytes() for _, a, b in cut], pa.binary()) for x in (keys, counts))], ["bucket", "keys", "counts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _in_buckets(batches, "bucket", "keys", "counts"):
            keys, counts = (np.frombuffer(b"".join([x[c] for x in pieces]), kind) for c, kind in ((1, np.int64), (2, np.uint32)))
            order = np.argsort(keys)
            begin = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
            yield pa.RecordBatch.from_arrays([pa.array(keys[order][begin]), pa.array(np.add.reduceat(counts[order].astype(np.int64), begin))], ["shingle", "docs"])

    each = windows(texts, id, text, width).select(F.array_distinct("hashes").alias("hashes"))
    return each.mapInArrow(deal, "bucket long, keys binary, counts binary").repartition(buckets, "bucket").mapInArrow(meet, "shingle long, docs long")


def windows(texts: DataFrame, id: str, text: str, width: int, every: bool = False) -> DataFrame:
    """(id, n, hashes) of texts of ``width`` words or more: a 64-bit hash of each window of lower-case words, in order.
    With ``every`` other texts too, which have none.

    Words are hashed once, and a window by its words' hashes, so no window's text is ever built. The array is generated
    as a row of its own, or Spark would work it out again wherever it is used.
    """
    w = F.transform(T.words(F.col(text)), lambda x: F.xxhash64(F.lower(x)))
    rows = texts.select(F.col(id).alias("id"), F.explode(F.array(F.coalesce(w, F.array().cast("array<bigint>")) if every else w)).alias("w"))
    rows = rows if every else rows.where(F.size("w") >= width)
    hashed = F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(width))))
    hashed = F.when(F.size("w") >= width, hashed).otherwise(F.array().cast("array<bigint>")) if every else hashed
    return rows.select("id", F.size("w").alias("n"), F.explode(F.array(hashed)).alias("hashes"))


def unique_words(texts: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, rare: int = 3) -> DataFrame:
    """(id, n_words, unique_words): the words of each text that lie in a window that fewer than ``rare`` texts hold. ``id`` is unique."""

    def covered(ids: pa.Array, n: np.ndarray, sizes: np.ndarray, places: np.ndarray, keys: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        alone = np.ones(int(sizes.sum()), bool)
        alone[places] = False
        doc, at = np.repeat(np.arange(len(sizes)), sizes)[alone], np.flatnonzero(alone)
        # A rare window covers its words; two neighbouring windows at distance d add d words to what is covered.
        adds = np.append(np.where(doc[1:] == doc[:-1], np.minimum(width, np.diff(at)), width), [width] * bool(len(at)))
        return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int32)), pa.array(np.bincount(doc, adds, len(sizes)).astype(np.int32))], ["id", "n_words", "unique_words"])

    kind = texts.schema[id].dataType.simpleString()
    return held_by(windows(texts, id, text, width, every=True), rare, _buckets(texts, text), covered, f"id {kind}, n_words int, unique_words int")
