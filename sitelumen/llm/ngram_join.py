"""Exact Jaccard self-join of five-word shingle sets: size-banded tiles, bitmap bounds, sorted-array intersection.

1. A level is a band of set sizes and the sizes just below that can link with it. Two linked sets of a level differ in
   few shingles, say d; so of d + 1 + s parts of the hash range, s + 1 at least hold the same shingles in both. Sets of a
   level that agree in one such part are a tile. s lets a set leave out up to s empty parts, in which agreement says
   nothing; a set with more of them takes them all, so no link is lost, and no tile grows with its band.
2. In a tile, sets are compared by hashed bitmaps: a bit is the parity of the shingles that fall on it, so the bits that
   differ are at most the shingles that differ, and bound the overlap from above.
   Sets that are almost linked pass too, and chain groups that grow faster than the table; large ones are screened again by finer bitmaps.
3. What passes is grouped, and in a group each set is intersected with those that it is not yet linked with, as sorted
   arrays. Large groups are dealt to tasks, first with a few sets that all others meet. Links, not candidates, make the
   result's components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common, wordhash
from .components import components
from .simhash import linked_runs, shingle_sets

# Sets of such shingles link at such a percentage of their union.
WIDTH, PERCENT = 5, 80
#: Sizes of neighbouring levels, as a ratio in percent: of the widths tried on paper, the one with the fewest parts a shingle.
LEVEL_PERCENT = 156
#: Of so many parts, one more may be left out.
SPARE = 8
#: Bytes of text that fill a bucket of tiles, which is one task's work: some 2 million parts.
BUCKET_BYTES = 24 << 20
#: Parts that a task gathers before it deals them to buckets, and sets that it remembers having dealt.
DEAL_PARTS, REMEMBERED = 2_000_000, 1_000_000
#: Sets of a tile, and shingles of a group, that one task compares; larger ones are cut into chunks.
RUN_SETS, GROUP_SHINGLES = 32_768, 4_000_000
#: Sets of a large group that all others meet first.
PIVOTS = 48
#: Hashes that share a long of the filter of wanted texts.
FILTERED = 4
#: 64-bit words of the smallest bitmap, and shingles a word of larger ones.
LEAST_WORDS, SHINGLES_A_WORD = 8, 128
#: Shingles of a group that is screened again, and shingles a word of its finer bitmaps: 4 bits a shingle let pairs pass from a similarity of 0.79 on.
SCREENED_SHINGLES, FINE_SHINGLES_A_WORD = 1_000_000, 16


def levels(top: int) -> np.ndarray:
    """Where each level begins, up to the first one beyond ``top``."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, -(-out[-1] * LEVEL_PERCENT // 100)))
    return np.array([*out, max(out[-1] + 1, -(-out[-1] * LEVEL_PERCENT // 100))])


def most_different(total: np.ndarray) -> np.ndarray:
    """The most shingles that only one of two linked sets holds, by the sum of their sizes."""
    return total * (100 - PERCENT) // (100 + PERCENT)


def parts(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owners): a key for each part that each set takes to a tile. ``hashes``: set by set, ascending."""
    begin, doc = levels(int(sizes.max(initial=0))), np.repeat(np.arange(len(sizes)), sizes)
    keys, owners = [], []
    own = np.searchsorted(begin, sizes, "right") - 1
    for level, inside in ((own, sizes > 0), (own + 1, 100 * sizes >= PERCENT * begin[own + 1])):
        differ = most_different(2 * (begin[np.minimum(level + 1, len(begin) - 1)] - 1))
        inside = inside & (differ > 0)  # without a difference, linked sets are equal
        spare = -(-(differ + 1) // SPARE)
        count = np.where(inside, differ + 1 + spare, 0)
        offset = np.cumsum(count) - count
        here = inside[doc]
        d = doc[here]
        slot = offset[d] + ((hashes[here] >> np.uint64(32)) * count[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        held, who = slot[first], d[first]
        sums = np.add.reduceat(wordhash.mix(hashes[here]), first) if len(first) else np.zeros(0, np.uint64)
        empty = count - np.bincount(who, minlength=len(sizes))
        for i in np.flatnonzero(empty > spare).tolist():
            bare = np.setdiff1d(np.arange(offset[i], offset[i] + count[i]), held[who == i])
            held, who, sums = np.append(held, bare), np.append(who, np.full(len(bare), i)), np.append(sums, np.zeros(len(bare), np.uint64))
        place = (level[who].astype(np.uint64) << np.uint64(40)) + (held - offset[who]).astype(np.uint64)
        keys.append(wordhash.mix(sums + wordhash.mix(place + np.uint64(1))))
        owners.append(who)
    return np.concatenate(keys), np.concatenate(owners)


def bitmaps(hashes: np.ndarray, sizes: np.ndarray, shingles_a_word: int = SHINGLES_A_WORD) -> list[bytes]:
    """Each set's bitmap; its width is a power of two that grows with the set.

    Twice that where else half of the bits, in which unrelated sets differ, are less than six standard deviations above the most that linked ones differ in.
    """
    words = np.maximum(LEAST_WORDS, 1 << np.ceil(np.log2(np.maximum(sizes / shingles_a_word, 1))).astype(np.int64))
    words <<= words * 32 - 24 * np.sqrt(words) < most_different(2 * sizes)
    end = np.cumsum(words * 64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = (end - words * 64)[doc] + (wordhash.mix(hashes + np.uint64(7)) & (words * 64 - 1)[doc].astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(end[-1]) if len(end) else 0) & 1
    raw = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [raw[(e - w * 64) // 8 : e // 8] for e, w in zip(end.tolist(), words.tolist(), strict=True)]


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of several widths as rows of the least width: halves are added up, parity by parity."""
    least = min(len(m) for m in maps) // 8
    rows = [np.frombuffer(m, np.uint64) for m in maps]
    return np.stack([r if len(r) == least else np.bitwise_xor.reduce(r.reshape(-1, least)) for r in rows])


def set_names(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each set, equal for equal sets (and for different ones with the chance of equal 64-bit hashes)."""
    some = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if len(some):
        out[some] = wordhash.mix(np.add.reduceat(wordhash.mix(hashes + np.uint64(3)), (np.cumsum(sizes) - sizes)[some]) + sizes[some].astype(np.uint64))
    return out.view(np.int64)


def grouped(keys: np.ndarray, sizes: np.ndarray, maps: list[bytes], sets: tuple[np.ndarray, np.ndarray] | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """For each set, the first one that it is linked with, by links between sets of equal ``keys``, sorted.

    A link is a pair whose sizes and bitmaps allow enough overlap; with ``sets`` (hashes, and where each set begins), one
    whose intersection is large enough. Sets that are linked already, if only by others, are not compared again, nor are
    sets of the same ``side``, if that is 0 or more.
    """
    parent = np.arange(len(keys))
    for run in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
        if len(run) < 2:
            continue
        n, bits, root = sizes[run], folded([maps[i] for i in run.tolist()]), np.arange(len(run))
        apart = None if side is None or (side[run] < 0).all() else side[run]
        ranked = None if sets is None else Ranked(*sets, run, sizes)
        for i in range(len(run) - 1):
            others = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            if not len(others):
                if not root[i:].any():
                    break
                continue
            if apart is not None and apart[i] >= 0:
                others = others[apart[others] != apart[i]]
            others = others[100 * np.minimum(n[others], n[i]) >= PERCENT * np.maximum(n[others], n[i])]
            total = n[others] + n[i]
            near = np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64) <= most_different(total)
            others, total = others[near], total[near]
            if ranked is not None and len(others):
                shared = ranked.overlaps(i, others)
                others = others[100 * shared >= PERCENT * (total - shared)]
            if len(others):
                joined = np.append(root[others], root[i])
                root[np.isin(root, joined)] = joined.min()
        parent[run] = run[root]
    return parent


class Ranked:
    """The sorted arrays of a run of sets, their hashes replaced by ranks among all of the run's.

    Ranks are dense, so an array meets others by a table of its places: each step of their merge is one look at it.
    """

    def __init__(self, hashes: np.ndarray, begin: np.ndarray, run: np.ndarray, sizes: np.ndarray) -> None:
        self.n, self.begin = sizes[run], begin[run] - begin[run[0]]
        whole = hashes[begin[run[0]] : begin[run[-1]] + sizes[run[-1]]]
        self.rank = np.unique(whole, return_inverse=True)[1].astype(np.int32)
        self.inside = np.zeros(int(self.rank.max()) + 1, bool)

    def overlaps(self, one: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set ``one`` with ``others``."""
        own, out = self.rank[self.begin[one] : self.begin[one] + self.n[one]], np.zeros(len(others), np.int64)
        self.inside[own] = True
        for part in np.split(np.arange(len(others)), np.flatnonzero(np.diff(np.cumsum(self.n[others]) // (1 << 20))) + 1):
            m = self.n[others[part]]
            first = np.cumsum(m) - m
            place = np.repeat(self.begin[others[part]] - first, m) + np.arange(int(m.sum()))
            out[part] = np.add.reduceat(self.inside[self.rank[place]], first, dtype=np.int64)
        self.inside[own] = False
        return out


def with_set(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, size, node, bitmap) of each row; a text without words has size 0 and no node. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            hashes, sizes = shingle_sets(batch.column("text").to_pylist(), WIDTH)
            node = pa.array(set_names(hashes, sizes), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes.astype(np.int64)), node, pa.array(bitmaps(hashes, sizes), pa.binary())], ["doc_id", "text_hash", "size", "node", "bitmap"])

    return _keyed(docs, id, text).mapInArrow(run, "doc_id long, text_hash long, size long, node long, bitmap binary")


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def tiles(docs: DataFrame, text: str = "text") -> DataFrame:
    """(tile, node): the sets of each tile of two sets or more. Tiles of the same sets are mostly told once.

    Tasks deal the parts of their sets to buckets as packed arrays, a set only once while they remember it; a bucket
    is sorted by one task. Buckets are as many as the bytes of the texts ask for.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            keys, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)), len(order)).tolist()
            keys, nodes = keys[order].astype(np.uint32), nodes[order]
            cut = list(zip(edges[:-1], edges[1:], strict=True))
            packed = [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (keys, nodes)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][edges[:-1]]), *packed], ["bucket", "keys", "nodes"])

        for batch in common.slices(batches, "text"):
            hashes, sizes = shingle_sets(batch.column("text").to_pylist(), WIDTH)
            names = set_names(hashes, sizes)
            keys, owners = parts(hashes, sizes)
            fresh = np.array([not (v in seen or seen.add(v)) for v in names.tolist()], bool)
            if len(seen) > REMEMBERED:
                seen.clear()
            keys, owners = keys[fresh[owners]], owners[fresh[owners]]
            held.append((keys, names[owners]))
            if sum(len(k) for k, _ in held) >= DEAL_PARTS:
                yield told()
        if sum(len(k) for k, _ in held):
            yield told()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        current = None
        for batch in batches:
            for bucket, keys, nodes in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "nodes")), strict=True):
                if bucket != current and held:
                    yield _met(held)
                    held = []
                current = bucket
                held.append((keys, nodes))
        if held:
            yield _met(held)

    dealt = docs.select(F.col(text).alias("text")).mapInArrow(deal, "bucket long, keys binary, nodes binary")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "tile long, node long").distinct()


def _met(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """(tile, node) of one bucket's keys that several nodes have; of keys with the same nodes, one."""
    keys, nodes = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), (np.uint32, np.int64), strict=True))
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
    keys, nodes = keys[new], nodes[new]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(first, len(keys)))
    tile = wordhash.mix(np.add.reduceat(wordhash.mix(nodes.view(np.uint64)), first) + count.astype(np.uint64))
    _, once = np.unique(tile, return_index=True)
    chosen = np.zeros(len(first), bool)
    chosen[once] = True
    inside = np.repeat(chosen & (count > 1), count)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(tile, count)[inside].view(np.int64)), pa.array(nodes[inside])], ["tile", "node"])


def _pair(a: Column, b: Column) -> Column:
    """A number for two chunks, whichever comes first."""
    return F.greatest(a, b) * (1 << 31) + F.least(a, b)


def _cells(rows: DataFrame) -> DataFrame:
    """Rows with a ``cell`` for each two ``chunks`` of theirs that ``own`` is of, and their ``side`` there: of two chunks, each is compared with the other."""
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.struct(_pair(k, F.col("own")).alias("cell"), F.when(k == F.col("own"), -1).otherwise(F.col("own")).alias("side")))
    return rows.withColumn("m", F.explode(met)).withColumns({"cell": F.col("m.cell"), "side": F.col("m.side").cast("long")}).drop("m", "chunks", "own")


def _dealt(rows: DataFrame, chunks: Column) -> DataFrame:
    return rows.withColumn("chunks", chunks.cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _screened(keys: np.ndarray, rows: pa.Table) -> np.ndarray:
    return grouped(keys, _column(rows, "size"), rows.column("bitmap").to_pylist(), side=_column(rows, "side"))


def _intersected(keys: np.ndarray, rows: pa.Table) -> np.ndarray:
    sets = rows.column("hashes").combine_chunks()
    sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
    n = sets.value_lengths().to_numpy().astype(np.int64)
    return grouped(keys, n, rows.column("bitmap").to_pylist(), (sets.flatten().to_numpy().view(np.uint64), np.cumsum(n) - n), _column(rows, "side"))


def _in_large_groups(sets: DataFrame) -> DataFrame:
    """Edges that connect just what links connect, of groups that one task can't hold: ``sets`` (component, node, size, bitmap, hashes), settled.

    Every set of a group meets its PIVOTS first; those that so come to be linked with most others need not be compared with
    each other any more. What is left over is compared with all. So a group of near copies costs what its size
    does, and only one without such a middle grows with its square.
    """
    keep = ["component", "node", "size", "bitmap", "hashes"]
    total = sets.groupBy("component").agg(F.sum("size").alias("shingles"), F.count(F.lit(1)).alias("sets"))
    half = lambda shingles, sets: F.ceil(F.greatest(F.col(shingles) / (GROUP_SHINGLES // 2), F.col(sets) / (RUN_SETS // 2)))
    rows = _dealt(sets.join(total.select("component", half("shingles", "sets").alias("parts")), "component"), F.col("parts"))
    place = F.row_number().over(W.Window.partitionBy("component").orderBy("node"))
    pivots = rows.select("component", "node", "chunks").withColumn("place", place).where(F.col("place") <= PIVOTS)
    pivots = sets.join(pivots.select("component", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("cell")), ["component", "node"])
    met = rows.select(*keep, F.col("own").alias("cell"), F.lit(0).cast("long").alias("side")).unionByName(pivots.select(*keep, "cell", F.lit(-1).cast("long").alias("side")))
    first = common.settle(linked_runs(met, ["component", "cell"], ["side", "node"], _intersected))

    named = sets.select("component", "node", "size").join(components(first).withColumnRenamed("component", "label"), "node", "left")
    named = common.settle(named.select("component", "node", "size", F.coalesce("label", "node").alias("label")))
    middle = named.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    named = named.join(middle.withColumnRenamed("label", "middle"), "component").select("component", "node", "size", (F.col("label") == F.col("middle")).alias("inside"))
    sums = named.groupBy("component").agg(*(f.alias(f"{k}_{name}") for k, of in (("in", F.col("inside")), ("out", ~F.col("inside"))) for name, f in (("shingles", F.sum(F.when(of, F.col("size")).otherwise(0))), ("sets", F.count_if(of)))))
    sums = sums.where("out_sets > 0").select("component", F.greatest(F.lit(1), half("in_shingles", "in_sets")).alias("ins"), half("out_shingles", "out_sets").alias("outs"))
    rows = sets.join(named.select("node", "inside"), "node").join(sums, "component")
    outside = _cells(_dealt(rows.where("NOT inside"), F.col("outs")).select(*keep, "chunks", "own"))
    # Cells of those inside lie beyond the others: each chunk of theirs meets each chunk of those outside.
    meet = lambda of, many, beyond: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col(many).cast("long") - 1), beyond))
    cross = lambda i, o: (i + 1) * (1 << 40) + o
    inner = _dealt(rows.where("inside"), F.col("ins")).withColumn("cell", meet("outs", "outs", lambda o: cross(F.col("own"), o))).select(*keep, "cell", F.lit(0).cast("long").alias("side"))
    outer = _dealt(rows.where("NOT inside"), F.col("outs")).withColumn("cell", meet("ins", "ins", lambda i: cross(i, F.col("own")))).select(*keep, "cell", F.lit(1).cast("long").alias("side"))
    cells = outside.select(*keep, "cell", "side").unionByName(inner).unionByName(outer)
    return first.unionByName(linked_runs(cells, ["component", "cell"], ["node"], _intersected))


#: Columns of nodes whose texts are to be read again.
WANTED = ("first.doc_id AS _id", "first.text_hash AS _hash", "component", "node", "size", "bitmap")


def _groups(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of the ``nodes`` that bitmaps connect in the tiles (or groups) ``met``; no link is left out, but not all that is connected is linked."""
    sizes = met.groupBy("tile").agg(F.count(F.lit(1)).alias("sets"))
    rows = met.join(sizes, "tile").join(nodes.select("node", "size", "bitmap"), "node")
    chunks = F.when(F.col("sets") <= RUN_SETS, 1).otherwise(F.ceil(F.col("sets") / (RUN_SETS // 2)))
    return components(linked_runs(_cells(_dealt(rows, chunks)).select("tile", "cell", "side", "node", "size", "bitmap"), ["tile", "cell"], ["node"], _screened))


def _screened_again(docs: DataFrame, asked: DataFrame, id: str, text: str) -> DataFrame:
    """``asked``, settled, its groups of over SCREENED_SHINGLES put together again by finer bitmaps of their sets, which replace theirs.

    Each bitmap moves once, to the task of its group, or to cells of chunks of RUN_SETS. So what later moves as sets are groups about as large as those that links make, not what chance connects.
    """
    sums = asked.groupBy("component").agg(F.sum("size").alias("shingles")).where(F.col("shingles") > SCREENED_SHINGLES)
    wide = common.settle(asked.join(sums.select("component"), "component").selectExpr(*WANTED, "first"))
    if wide.isEmpty():
        return asked
    fine = common.settle(maps_of(docs, wide.drop("first"), id, text).dropDuplicates(["node"]))
    tight = fine.drop("component").join(wide.select("node", "first"), "node").join(_groups(fine.select(F.col("component").alias("tile"), "node"), fine), "node")
    return common.settle(asked.join(wide.select("node"), "node", "left_anti").unionByName(tight))


def links(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges (u, v) between the nodes of ``found`` that connect just those that links connect."""
    first = F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    nodes = common.settle(found.where("node IS NOT NULL").groupBy("node").agg(F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), first.alias("first")))
    met = common.settle(tiles(docs, text))
    asked = _screened_again(docs, common.settle(nodes.join(_groups(met, nodes), "node")), id, text)
    sums = asked.groupBy("component").agg(F.sum("size").alias("shingles"), F.count(F.lit(1)).alias("sets"))
    large = (F.col("shingles") > GROUP_SHINGLES) | (F.col("sets") > RUN_SETS)
    wanted = common.settle(asked.join(sums.select("component", large.alias("large")), "component").selectExpr(*WANTED, "large"))
    alone = sets_of(docs, wanted.where("NOT large"), id, text).select("component", F.lit(-1).cast("long").alias("side"), "node", "bitmap", "hashes")
    edges = linked_runs(alone, ["component"], ["node"], _intersected)
    if wanted.where("large").isEmpty():
        return edges
    big = common.settle(sets_of(docs, wanted.where("large"), id, text))
    if big.count() > wanted.where("large").count():  # rows repeat, in several tasks
        big = common.settle(big.dropDuplicates(["node"]))
    return edges.unionByName(_in_large_groups(big))


def _maybe_among(texts: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """The rows of ``texts`` whose hash is ``wanted``, and a few others: two bits of one long for each of ``count`` hashes, FILTERED hashes a long."""
    bit = lambda at: F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(text_hash, {at}) & 63 AS INT))")
    place = F.pmod(F.xxhash64("text_hash"), F.lit(-(-count // FILTERED)).cast("long")).alias("_place")
    mask = bit(1).bitwiseOR(bit(33)).alias("_mask")
    bits = wanted.select(place, mask).groupBy("_place").agg(F.bit_or("_mask").alias("_bits"))
    kept = texts.withColumns({"_place": place, "_mask": mask}).join(F.broadcast(bits), "_place").where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    return kept.select(*texts.columns)


def _read_again(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """(component, node, size, bitmap, text) of the ``wanted`` nodes.

    The list of what is wanted is sent to where the texts are, if it is counted to be short. A longer one is met by shuffle, but
    only by texts that a filter of some bits for each of its rows lets pass.
    """
    count, texts = wanted.count(), _keyed(docs, id, text)
    if count > common.SMALL_ROWS:
        texts = _maybe_among(texts, wanted.select(F.col("_hash").alias("text_hash")), count)
    else:
        wanted = F.broadcast(wanted)
    return texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["text_hash"] == wanted["_hash"])).select("component", "node", "size", "bitmap", "text")


def _once(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    return batch.filter(pa.array([not (v in seen or seen.add(v)) for v in batch.column("node").to_pylist()], pa.bool_()))


def sets_of(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """(component, node, size, bitmap, hashes) of the ``wanted`` nodes, whose texts are read again; of rows that repeat, one a task."""
    names = ["component", "node", "size", "bitmap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.slices(batches, "text"):
            batch = _once(batch, seen)
            hashes, sizes = shingle_sets(batch.column("text").to_pylist(), WIDTH)
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))], [*names, "hashes"])

    return _read_again(docs, wanted, id, text).mapInArrow(run, "component long, node long, size long, bitmap binary, hashes array<bigint>")


def maps_of(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """(component, node, size, bitmap) of the ``wanted`` nodes with finer bitmaps, from their texts; of rows that repeat, one a task."""
    names = ["component", "node", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.slices(batches, "text"):
            batch = _once(batch, seen)
            maps = bitmaps(*shingle_sets(batch.column("text").to_pylist(), WIDTH), FINE_SHINGLES_A_WORD)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(maps, pa.binary())], [*names, "bitmap"])

    return _read_again(docs, wanted, id, text).mapInArrow(run, "component long, node long, size long, bitmap binary")


def join(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    ``component_id`` is the smallest id that a row reaches over links, its own included. Texts without words, null and
    empty ones too, have no shingles, are linked with nothing and so have their own id. Repeated rows stay; equal sets are
    one node. Rows without an id link too; a component without any id is null.
    """
    found = common.settle(with_set(docs, id, text))
    joined = common.settle(components(links(docs, found, id, text)))
    least = found.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    least = common.settle(least)
    reached = joined.join(least, "node").groupBy("component").agg(F.min("least").alias("reached"))
    named = least.join(joined.join(reached, "component"), "node", "left").select("node", F.coalesce("reached", "least").alias("component_id"))
    return found.join(named, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
