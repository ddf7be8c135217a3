"""SimHash near copies: 64-bit fingerprints of three-word shingles, compared bit plane by bit plane.

Fingerprints within a small radius agree in some of their blocks (with four blocks and radius 2, in two), so those
that share a pair of blocks are compared, and no link is lost. In a run of candidates the fingerprints are stored
vertically: a word of plane p holds bit p of 64 fingerprints. A query's plane differences are added to bitwise
counters with carry-save steps, 64 distances at a time, and a block of lanes is abandoned once all of them exceed
the radius. A run yields a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common, wordhash
from .components import components

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
BLOCKS, BLOCK_BITS = 4, 16
#: Candidates that share two blocks. Longer runs are dealt again by two of four parts of their other 32 bits; such a
#: run has 16 free bits, so 65,536 different fingerprints at most.
RUN_ROWS = 32_768
PART_BITS = 8
#: Queries that are compared at a time, and planes between two looks for lanes to abandon.
QUERIES, PLANES = 8192, 8
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """A bit is 1 if over half of the shingles' XXH64 hashes, repeats included, have it. No words: 0."""
    w = wordhash.words(texts, lower=True)
    out = np.zeros(len(texts), np.uint64)
    if not len(w.start):
        return out
    # The words again with one space between them, so that a shingle is a slice.
    lengths = w.end - w.start
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    joined = np.full(int(ends[-1]) + 1, 0x20, np.uint8)
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] = 1
    inside[w.end] -= 1
    target = np.ones(len(joined), bool)
    target[ends] = False
    joined[target] = w.data[np.cumsum(inside[:-1]).astype(bool)]
    first, counts = w.first[:-1], w.counts
    at = np.arange(len(starts))
    last = np.minimum(at + SHINGLE_WORDS, w.first[1:][w.doc]) - 1
    begins = (at + SHINGLE_WORDS <= w.first[1:][w.doc]) | (at == first[w.doc])
    buffer, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buffer[a:b], SEED) for a, b in zip(starts[begins].tolist(), ends[last[begins]].tolist(), strict=True)), np.uint64, int(begins.sum()))
    some = np.flatnonzero(counts)
    edges = np.searchsorted(w.doc[begins], some)
    n = np.diff(np.append(edges, len(hashes)))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def with_fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits): each row's fingerprint as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            made = fingerprints(batch.column("text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "bits"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, bits long")


def planes(bits: np.ndarray) -> np.ndarray:
    """A row for each bit of the fingerprints, which have a column for each 64: bit k of word j in row p is bit p of
    fingerprint 64 j + k."""
    padded = np.zeros((-(-len(bits) // 64) * 64, bits.shape[1]), np.uint64)
    padded[: len(bits)] = bits
    each = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(each.T), axis=1, bitorder="little").view(np.uint64)


def within(lanes: np.ndarray, words: np.ndarray, queries: np.ndarray, valid: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each query, which of the 64 lanes in its word of ``lanes`` differ in ``radius`` bits at most, as a mask.

    ``queries`` has a column for each 64 planes. ``valid`` masks the lanes that count. Counters are kept as bit
    slices: slice k holds bit k of 64 distances.
    """
    out = np.zeros(len(queries), np.uint64)
    alive = np.arange(len(queries))
    slices = radius.bit_length()
    counts = np.zeros((slices, len(queries)), np.uint64)
    over = ~valid
    for p in range(len(lanes)):
        carry = lanes[p, words[alive]] ^ (np.uint64(0) - ((queries[alive, p >> 6] >> np.uint64(p & 63)) & np.uint64(1)))
        for k in range(slices):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        over = over | carry
        # A counter beyond the radius stays so: it is marked at once, before it can overflow.
        beyond = np.zeros(len(alive), np.uint64)
        equal = np.full(len(alive), ALL)
        for k in reversed(range(slices)):
            if not radius >> k & 1:
                beyond |= equal & counts[k]
                equal &= ~counts[k]
            else:
                equal &= counts[k]
        over = over | beyond
        if p % PLANES == PLANES - 1:
            stay = over != ALL
            if not stay.all():
                alive, counts, over = alive[stay], counts[:, stay], over[stay]
            if not len(alive):
                return out
    out[alive] = ~over
    return out


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Link a[i] with b[i] in ``parent``, where each node points to the smallest of its set."""
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def forest(keys: np.ndarray, bits: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each candidate, the first one that it is linked with, by links between candidates of equal ``keys``, sorted."""
    n = len(bits)
    bits = bits.reshape(n, -1)
    parent = np.arange(n)
    run_end = np.searchsorted(keys, keys, "right")
    lanes = planes(bits)
    word_end = (run_end - 1) >> 6
    for start in range(0, n, QUERIES):
        i = np.arange(start, min(n, start + QUERIES))
        i = i[run_end[i] > i + 1]
        word = (i + 1) >> 6
        while len(i):
            low = np.maximum(i + 1 - (word << 6), 0).astype(np.uint64)
            high = np.minimum(run_end[i] - (word << 6), 64).astype(np.uint64)
            valid = (ALL << low) & (ALL >> (np.uint64(64) - high))
            hits = within(lanes, word, bits[i], valid, radius)
            some = np.flatnonzero(hits)
            for part in np.array_split(some, -(-len(some) // 4096) or 1):
                row, lane = np.nonzero(np.unpackbits(hits[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                _join(parent, i[part][row], (word[part][row] << 6) + lane)
            word = word + 1
            more = word <= word_end[i]
            i, word = i[more], word[more]
    return parent


def linked_runs(candidates: DataFrame, key: list[str], order: list[str], link: Callable[[np.ndarray, pa.Table], np.ndarray]) -> DataFrame:
    """Edges (u, v) between nodes of ``candidates`` that agree in ``key``: the forest that ``link`` finds in whole runs,
    given a number for each row's run and the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(rows: pa.Table) -> pa.RecordBatch:
            columns = [rows.column(k).to_numpy() for k in key]
            change = np.ones(rows.num_rows, bool)
            change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            parent = link(np.cumsum(change), rows)
            node = rows.column("node").to_numpy()
            other = np.flatnonzero(parent != np.arange(len(parent)))
            return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[parent[other]])], ["u", "v"])

        def last_start(rows: pa.Table) -> int:
            """Where the last run begins, which may go on in the next batch."""
            same = np.logical_and.reduce([rows.column(k).to_numpy() == rows.column(k)[-1].as_py() for k in key])
            return int(np.flatnonzero(same)[0])

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            if rows.num_rows and (cut := last_start(rows)):
                yield linked(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield linked(rows)

    dealt = candidates.repartition(common.wide(candidates.sparkSession), *key).sortWithinPartitions(*key, *order)
    return dealt.mapInArrow(run, "u long, v long")


def _bits(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows.column(b).to_numpy().view(np.uint64) for b in names], 1)


def _runs(candidates: DataFrame, key: list[str], bits: list[str], radius: int) -> DataFrame:
    """Edges (u, v) between nodes of ``candidates`` (key and bits columns, node): a forest of each run's links."""
    return linked_runs(candidates, key, bits, lambda keys, rows: forest(keys, _bits(rows, bits), radius))


def _pairs(bits: str, parts: int, width: int, offsets: list[int] | None = None) -> list[F.Column]:
    """Keys for each choice of two of ``parts`` blocks of ``width`` bits: the choice's number above the two blocks."""
    offsets = offsets or [width * k for k in range(parts)]
    mask = (1 << width) - 1
    block = [F.shiftrightunsigned(F.col(bits), o).bitwiseAND(F.lit(mask)) for o in offsets]
    return [F.lit(c << (2 * width)).cast("long") + F.shiftleft(block[a], width) + block[b] for c, (a, b) in enumerate(itertools.combinations(range(parts), 2))]


def near(nodes: DataFrame, radius: int = RADIUS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Edges (u, v) that connect just those of ``nodes`` (bits long, different; node long) linked within ``radius`` (2 at most)."""
    if radius > BLOCKS - 2:
        raise ValueError(f"radius must be {BLOCKS - 2} at most")
    keyed = nodes.select("bits", "node", F.explode(F.array(*_pairs("bits", BLOCKS, BLOCK_BITS))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("run")).where("run > 1")
    runs = common.settle(keyed.join(sizes, "key"))
    short = _runs(runs.where(F.col("run") <= run_rows), ["key"], ["bits"], radius)
    long_ = runs.where(F.col("run") > run_rows)
    subkeys = F.lit(None)
    for c, shared in enumerate(itertools.combinations(range(BLOCKS), 2)):
        free = [BLOCK_BITS * b + o for b in range(BLOCKS) if b not in shared for o in range(0, BLOCK_BITS, PART_BITS)]
        subkeys = F.when(F.shiftright("key", 2 * BLOCK_BITS) == c, F.array(*_pairs("bits", 4, PART_BITS, free))).otherwise(subkeys)
    split = _runs(long_.select("bits", "node", "key", F.explode(subkeys).alias("subkey")), ["key", "subkey"], ["bits"], radius)
    return short.unionByName(split)


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``.

    ``component_id`` is the smallest id that a row reaches over links of ``radius`` differing bits at most. Rows
    without words (null and empty texts too) have fingerprint zero and link like any other. Repeated rows stay.
    Rows with a null id link too, and get their component, null if no row that they reach has an id.
    Equal fingerprints are one node, so copies cost nothing beyond the first.
    """
    found = common.settle(with_fingerprint(docs, id, text))
    low, top = found.agg(F.min("doc_id"), F.max("doc_id")).first()
    # A fingerprint that only rows without an id have is a node too, numbered beyond all ids, so it names no component.
    # Where ids leave no room for that, all are numbered from half of the room below.
    down = 0 if top is None or top < 1 << 62 else 1 << 62
    if down and low < -(1 << 62):
        raise ValueError("ids take up more than three quarters of all numbers")
    own, top = F.col("id") - F.lit(down), -1 if top is None else top - down
    nodes = found.groupBy("bits").agg(F.min("doc_id").alias("id")).select("bits", F.coalesce(own, F.lit(top) + 1 + F.monotonically_increasing_id()).alias("node"))
    nodes = common.settle(nodes)
    joined = components(near(nodes, radius))
    component = F.coalesce("component", "node")
    named = nodes.join(joined, "node", "left").select("bits", F.when(component <= top, component + F.lit(down)).alias("component_id"))
    return found.join(named, "bits", "left").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


# Similar texts: longer fingerprints for a similarity, not a few bits.

#: Words of a shingle, and the least similarity (Jaccard) of shingle sets that is looked for.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: 64-bit words of a long fingerprint; of the expected distance at that similarity, the standard errors that are let
#: pass. The fingerprints only propose: a link is made by the shingle sets themselves.
LONG_WORDS, SLACK = 4, 4.0
#: Candidates share one of BANDS bands of BAND_ROWS minimal hashes: at the least similarity all but 1 in 5,000 pairs do.
BANDS, BAND_ROWS = 16, 4
#: Shingle hashes of a group that one task holds to check its links; a larger group is cut into chunks, two a task.
CELL_HASHES = 4_000_000


def similar_radius(similarity: float = SIMILARITY, words: int = LONG_WORDS, slack: float = SLACK) -> int:
    """Differing bits up to which long fingerprints are candidates.

    Shingle sets of Jaccard similarity s have a cosine of 2 s / (1 + s) or more, and a bit differs with
    probability arccos(cosine) / pi.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * words
    return int(n * share + slack * math.sqrt(n * share * (1 - share)))


def shingle_sets(texts: list[str | None], width: int = SIMILAR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the different shingles' hashes, text by text and ascending, and each text's number of them."""
    w = wordhash.words(texts, lower=True)
    hashes, at = wordhash.window_hashes(w, wordhash.word_hashes(w), width)
    return _different(hashes, w.doc[at], len(texts))


def _different(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=n)


def _features(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, bands, and of each text's shingle set the size and a hash. Texts without words: zeros."""
    w = wordhash.words(texts, lower=True)
    hashes, at = wordhash.window_hashes(w, wordhash.word_hashes(w), width)
    n = len(texts)
    bits, bands, whole = np.zeros((n, LONG_WORDS), np.uint64), np.zeros((n, BANDS), np.uint64), np.zeros(n, np.uint64)
    some = np.flatnonzero(w.counts)
    if not len(some):
        return bits, bands, np.zeros(n, np.int64), whole
    hashes, sizes = _different(hashes, w.doc[at], n)  # the rule is about sets: a repeated line counts once
    edges = (np.cumsum(sizes) - sizes)[some]
    for k in range(LONG_WORDS):
        each = np.unpackbits(wordhash.mix(hashes + np.uint64(k + 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(each, edges, axis=0, dtype=np.int64)
        bits[some, k] = np.packbits(2 * ones > sizes[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    whole[some] = np.add.reduceat(wordhash.mix(hashes), edges)
    factors = wordhash.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    for band in range(BANDS):
        key = np.full(len(some), band + 1, np.uint64)
        for factor in factors[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
            key = wordhash.mix(key + np.minimum.reduceat(hashes * factor, edges))
        bands[some, band] = key
    return bits, bands, sizes, whole


def long_fingerprints(texts: list[str | None], width: int = SIMILAR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bands): a row a text, LONG_WORDS and BANDS columns. Texts without words: zeros."""
    return _features(texts, width)[:2]


def with_long_fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SIMILAR_WORDS) -> DataFrame:
    """(doc_id, text_hash, b0 to b3, size, set_hash, bands) of each row. No shuffle."""
    names = [f"b{k}" for k in range(LONG_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            bits, bands, sizes, whole = _features(batch.column("text").to_pylist(), width)
            longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (*bits.T, sizes, whole)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *longs, pa.array(bands.view(np.int64).tolist(), pa.list_(pa.int64()))], ["doc_id", "text_hash", *names, "size", "set_hash", "bands"])

    return _keyed(docs, id, text).mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{b} long" for b in names) + ", size long, set_hash long, bands array<bigint>")


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def exact_forest(keys: np.ndarray, bits: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """For each set, the first one that it is linked with, by links between sets of equal ``keys``, sorted.

    A link is a Jaccard similarity of ``similarity`` or more among sets whose fingerprints lie within ``radius``. In
    turn each set is compared with the later ones that are not yet linked with it: copies of one cost a comparison
    each, and those that it is not similar to meet the sets after it.
    """
    parent, ends = np.arange(len(keys)), np.cumsum(sizes)
    for run in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
        if len(run) < 2:
            continue
        n, begins = sizes[run], ends[run] - ends[run[0]] + sizes[run[0]] - sizes[run]
        codes = np.unique(hashes[ends[run[0]] - n[0] : ends[run[-1]]], return_inverse=True)[1]
        mark, root, own = np.zeros(int(codes.max()) + 1, bool), np.arange(len(run)), bits[run]
        for i in range(len(run) - 1):
            others = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            others = others[np.minimum(n[others], n[i]) >= similarity * np.maximum(n[others], n[i]) - 1e-6]
            others = others[np.bitwise_count(own[others] ^ own[i]).sum(1, dtype=np.int64) <= radius]
            if not len(others):
                continue
            mark[codes[begins[i] : begins[i] + n[i]]] = True
            shared = np.zeros(len(others), np.int64)
            for part in np.split(np.arange(len(others)), np.flatnonzero(np.diff(np.cumsum(n[others]) // CELL_HASHES)) + 1):
                m = n[others[part]]
                first = np.cumsum(m) - m
                place = np.repeat(begins[others[part]] - first, m) + np.arange(int(m.sum()))
                shared[part] = np.add.reduceat(mark[codes[place]], first, dtype=np.int64)
            mark[codes[begins[i] : begins[i] + n[i]]] = False
            hit = others[shared / (n[others] + n[i] - shared) >= similarity]
            if len(hit):
                joined = np.append(root[hit], root[i])
                root[np.isin(root, joined)] = joined.min()
        parent[run] = run[root]
    return parent


def _cell(a: F.Column, b: F.Column) -> F.Column:
    """A number for two chunks, whichever comes first, of as many chunks as an int counts."""
    return F.greatest(a, b).cast("long") * F.lit(1 << 31) + F.least(a, b)


def _checked(docs: DataFrame, nodes: DataFrame, loose: DataFrame, id: str, text: str, width: int, radius: int, similarity: float, run_rows: int) -> DataFrame:
    """Edges (u, v) that connect just those nodes of each ``loose`` group (node, component) that are linked by their sets.

    One text of each node that has candidates is read again, and its set goes to the task of its group. A group of
    more than CELL_HASHES hashes or ``run_rows`` sets is cut into chunks, and every two chunks meet in some task.
    """
    names = [f"b{k}" for k in range(LONG_WORDS)]
    asked = common.settle(nodes.join(loose, "node"))
    sums = asked.groupBy("component").agg(F.sum("size").alias("hashes"), F.count(F.lit(1)).alias("sets"))
    chunks = F.ceil(F.greatest(F.col("hashes") / (CELL_HASHES // 2), F.col("sets") / (run_rows // 2))).cast("int")
    chunks = F.when((F.col("hashes") <= CELL_HASHES) & (F.col("sets") <= run_rows), 1).otherwise(chunks)
    wanted = asked.join(sums.select("component", chunks.alias("chunks")), "component").select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"), "component", "chunks", "node", *names)
    rows = _keyed(docs, id, text)
    rows = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_id"]) & (rows["text_hash"] == wanted["_hash"])).select("component", "chunks", "node", *names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.slices(batches, "text"):
            fresh = [not (v in seen or seen.add(v)) for v in batch.column("node").to_pylist()]  # rows may repeat
            batch = batch.filter(pa.array(fresh))
            hashes, sizes = shingle_sets(batch.column("text").to_pylist(), width)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "chunks", "node", *names)), sets], ["component", "chunks", "node", *names, "hashes"])

    def link(keys: np.ndarray, rows: pa.Table) -> np.ndarray:
        sets = rows.column("hashes").combine_chunks()
        sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
        sizes = sets.value_lengths().to_numpy().astype(np.int64)
        return exact_forest(keys, _bits(rows, names), sets.flatten().to_numpy().view(np.uint64), sizes, radius, similarity)

    sets = rows.mapInArrow(run, "component long, chunks int, node long, " + ", ".join(f"{b} long" for b in names) + ", hashes array<bigint>")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: _cell(k, F.col("own")))
    grid = sets.withColumn("own", own).select("component", "node", *names, "hashes", F.explode(others).alias("cell"))
    return linked_runs(grid, ["component", "cell"], ["node"], link)


def _similar_rows(docs: DataFrame, id: str, text: str, similarity: float, width: int, run_rows: int) -> DataFrame:
    """(doc_id, text_hash, component, component_id) of each row; ``component`` numbers its group."""
    names = [f"b{k}" for k in range(LONG_WORDS)]
    whole = ["size", "set_hash", *names]
    found = common.settle(with_long_fingerprint(docs, id, text, width))
    first = F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    nodes = found.groupBy(*whole).agg(F.min("doc_id").alias("id"), first.alias("first"), F.min("bands").alias("bands"))
    nodes = common.settle(nodes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select(*names, "node", F.explode("bands").alias("key")).where("key != 0")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("run")).where("run > 1")
    runs = common.settle(keyed.join(sizes, "key"))
    radius = similar_radius(similarity)
    short = _runs(runs.where(F.col("run") <= run_rows).select("key", "node", *names), ["key"], names, radius)
    chunks = F.ceil(F.col("run") / (run_rows // 2)).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: _cell(k, F.col("own")))
    grid = runs.where(F.col("run") > run_rows).withColumn("own", own).select("key", "node", *names, F.explode(others).alias("cell"))
    loose = components(short.unionByName(_runs(grid, ["key", "cell"], names, radius)))
    links = components(_checked(docs, nodes.drop("bands"), loose, id, text, width, radius, similarity, run_rows))
    named = common.settle(nodes.join(links, "node", "left").select(*whole, "id", F.coalesce("component", "node").alias("component")))
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return found.join(named.join(ids, "component"), whole, "left").select("doc_id", "text_hash", "component", "component_id")


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SIMILAR_WORDS, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, component_id): the groups of texts that are linked by a ``similarity`` of shingle sets or more.

    Candidates share a band and have near fingerprints of 64 LONG_WORDS bits, compared bit-sliced: at the least
    similarity all but 1 in 5,000 pairs do. Their sets are then compared exactly. A run of candidates longer than
    ``run_rows`` is cut into chunks, and every two of its chunks are compared by some task. Equal sets are one node;
    texts without words are alike. ``component_id`` is the smallest id of a group, null if no row of it has one.
    """
    return _similar_rows(docs, id, text, similarity, width, run_rows).select("doc_id", "component_id")


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SIMILAR_WORDS) -> DataFrame:
    """One row of each group of similar texts, with all its columns: the one of the smallest id and text.

    Rows are told apart by id and text, so those that repeat an id may lie in different groups. A row without an id
    stays only if no row of its group has one. The ids and hashes of the rows that go are sent to where the rows are,
    if they are few enough (``common.small``); otherwise rows are shuffled once to meet them.
    """
    rows = _similar_rows(docs, id, text, similarity, width, RUN_ROWS)
    rows = common.settle(rows.groupBy("doc_id", "text_hash").agg(F.first("component").alias("group"), F.first("component_id").alias("first"), F.count(F.lit(1)).alias("n")))
    leads = F.col("doc_id").eqNullSafe(F.col("first"))
    id_, hash_, group, row = common.free(docs, "_id", "_hash", "_group", "_row")
    keys = [F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)]
    gone = rows.where(~leads).select(*keys)
    several = rows.where(leads).groupBy("group").agg(F.sum("n").alias("rows")).where("rows > 1")
    several = common.settle(rows.where(leads).join(several, "group").select(*keys, F.col("group").alias(group)))
    is_row = lambda found: docs[id].cast("long").eqNullSafe(found[id_]) & (F.xxhash64(docs[text]) == found[hash_])
    if several.isEmpty():
        gone = common.small(common.settle(gone))
        return docs.join(gone, is_row(gone), "left_anti")
    others = common.small(common.settle(gone.unionByName(several.drop(group))))
    alone = docs.join(others, is_row(others), "left_anti")
    plain = lambda c, kind: F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) if re.search("map<|variant|interval", kind) else F.col(f"`{c}`")  # noqa: E731 - what has no order is ordered as text
    order = W.Window.partitionBy(group).orderBy(F.asc_nulls_first(text), *(plain(c, kind) for c, kind in sorted(docs.dtypes) if c not in (id, text)))
    few = common.small(several)
    first = docs.join(few, is_row(few)).withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    return alone.unionByName(first.select(*docs.columns))
