"""Hard negatives by product quantisation with stored residual norms.

A codebook is fitted on a bounded sample; every row is then coded: for each pair of components the nearest centroid,
and for the whole row the norm of what the centroids leave over. An anchor's lookup tables give its score with a row's
centroids, and by Cauchy and Schwarz the true score lies within the anchor's norm times the row's residual norm of it.
So a row is passed over only if these bounds show that it can't be among the first ones; for the rest the exact score
is counted.

Rows and anchors meet in tiles of bounded size; each tile keeps the first few of each anchor, and windows over those
choose among tiles. The work is anchors times rows, as no row may be missed; what moves are rows times blocks of
ANCHOR_BLOCK anchors, and a few rows of each anchor and tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

#: Components become floor(SCALE * x).
SCALE = 256.0
#: Rows that the codebook is fitted on at most, those of the lowest hashed ids; every row is coded.
SAMPLE_ROWS = 8_192
PART_DIMS, CENTROIDS, FIT_ROUNDS = 2, 256, 6
#: Rows and anchors of a tile.
ROW_BLOCK, ANCHOR_BLOCK = 16_384, 8_192
#: Anchors whose scores with a tile's rows are held at a time.
ANCHORS_AT_ONCE = 48
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in percent of its positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Sums of rounded numbers may be off by so much of the product of norms.
ROUNDING = 1e-9


def parts(vectors: np.ndarray) -> np.ndarray:
    """(rows, parts, PART_DIMS): vectors cut into parts, the last filled up with zeros."""
    n, d = vectors.shape
    padded = np.zeros((n, -(-max(d, 1) // PART_DIMS) * PART_DIMS))
    padded[:, :d] = vectors
    return padded.reshape(n, padded.shape[1] // PART_DIMS, PART_DIMS)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest of ``centroids`` for each of ``points``."""
    out, norms = np.zeros(len(points), np.uint8), (centroids**2).sum(1) / 2
    for start in range(0, len(points), 4096):
        out[start : start + 4096] = np.argmax(points[start : start + 4096] @ centroids.T - norms, axis=1)
    return out


def fit_codebook(vectors: np.ndarray) -> np.ndarray:
    """(parts, CENTROIDS, PART_DIMS): centroids of each part by Lloyd's rounds. From no vectors: all zero."""
    cut = parts(vectors)
    book = np.zeros((cut.shape[1], CENTROIDS, PART_DIMS))
    for k in range(cut.shape[1] if len(cut) else 0):
        points = cut[:, k]
        book[k] = points[np.linspace(0, len(points) - 1, CENTROIDS).astype(int)]
        for _ in range(FIT_ROUNDS):
            near = nearest(points, book[k])
            held = np.bincount(near, minlength=CENTROIDS)
            for c in range(PART_DIMS):
                book[k, held > 0, c] = np.bincount(near, points[:, c], CENTROIDS)[held > 0] / held[held > 0]
    return book


def encode(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms) of vectors."""
    cut = parts(vectors)
    codes = np.stack([nearest(cut[:, k], book[k]) for k in range(cut.shape[1])], 1)
    left = cut - book[np.arange(cut.shape[1]), codes]
    return codes, np.sqrt((left**2).sum((1, 2)))


def bounds(anchors: np.ndarray, codes: np.ndarray, residuals: np.ndarray, norms: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each anchor with each coded row, by lookup tables and residual norms."""
    cut = parts(anchors)
    score = np.zeros((len(anchors), len(codes)))
    for k in range(cut.shape[1]):
        score += np.take(cut[:, k] @ book[k].T, codes[:, k], axis=1)
    own = np.sqrt((anchors**2).sum(1))[:, None]
    off = own * (residuals + ROUNDING * (norms + residuals)) + ROUNDING
    return score - off, score + off


def scores(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers. One that a long can't hold raises OverflowError."""
    if not len(rows):
        return np.zeros(0, np.int64)
    most = float(np.abs(anchor).max(initial=0.0)) * float(np.abs(rows).max(initial=0.0)) * max(len(anchor), 1)
    if most < 2**53:
        return (rows @ anchor).astype(np.int64)
    own = [int(x) for x in anchor]
    return np.array([np.int64(sum(a * int(x) for a, x in zip(own, row, strict=True))) for row in rows])


def first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Where the first n are: higher scores first, ties by smaller ids."""
    return np.lexsort((ids, -score))[:n]


def _reach(least: np.ndarray, n: int, otherwise: float) -> float:
    """A score that at least n rows surely reach: the n-th highest of their ``least`` scores."""
    return float(np.partition(least, len(least) - n)[len(least) - n]) if len(least) >= n else otherwise


def positives_of(anchor: np.ndarray, least: np.ndarray, most: np.ndarray, rows: np.ndarray, ids: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the first POSITIVES among the rows that ``may`` be taken."""
    at = np.flatnonzero(may)
    at = at[most[at] >= _reach(least[at], POSITIVES, -math.inf)]
    exact = scores(anchor, rows[at])
    order = first(exact, ids[at], POSITIVES)
    return at[order], exact[order]


def negatives_of(anchor: np.ndarray, least: np.ndarray, most: np.ndarray, rows: np.ndarray, ids: np.ndarray, may: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the first NEGATIVES from ``low`` to ``high`` among the rows that ``may`` be taken."""
    at = np.flatnonzero(may & (most >= low) & (least <= high))
    sure = at[(least[at] >= low) & (most[at] <= high)]
    at = at[most[at] >= _reach(least[sure], NEGATIVES, low)]
    exact = scores(anchor, rows[at])
    inside = (exact >= low) & (exact <= high)
    at, exact = at[inside], exact[inside]
    order = first(exact, ids[at], NEGATIVES)
    return at[order], exact[order]


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of ``dims`` numbers; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy().astype(np.int64) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def usable(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part: whole-number vectors, one row an id.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no part. Of rows that repeat
    an id, the one of the smallest label and then the smallest vector does.
    """
    one = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    one = one.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    return one.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def coded(rows: DataFrame, book: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, label, vector, code, residual, norm) of (vec_id, label, vector) rows; vectors become whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.floor(SCALE * _matrix(batch.column("vector"), dims))
            codes, left = encode(vectors, book)
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * dims)
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left), pa.array(np.sqrt((vectors**2).sum(1)))],
                ["vec_id", "label", "vector", "code", "residual", "norm"],
            )

    return rows.mapInArrow(run, "vec_id long, label long, vector array<double>, code binary, residual double, norm double")


class _Tile:
    """A tile's rows as arrays, and its anchors with their bounds a few at a time."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, book: np.ndarray, dims: int) -> None:
        self.book, self.anchors = book, anchors
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        self.vectors = _matrix(rows.column("vector"), dims)
        self.codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, len(book))
        self.residuals, self.norms = rows.column("residual").to_numpy(), rows.column("norm").to_numpy()
        self.own, self.own_ids, self.own_labels = _matrix(anchors.column("vector"), dims), anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for start in range(0, len(self.own), ANCHORS_AT_ONCE):
            some = self.own[start : start + ANCHORS_AT_ONCE]
            least, most = bounds(some, self.codes, self.residuals, self.norms, self.book)
            for k in range(len(some)):
                yield start + k, some[k], least[k], most[k]


def _tiled(rows: DataFrame, anchors: DataFrame, n: int, run, schema: str) -> DataFrame:  # noqa: ANN001
    """``run(rows, anchors)``, an Arrow table, for each tile. n: rows that there are, of which the block numbers are made."""
    row_blocks, anchor_blocks = -(-n // ROW_BLOCK) or 1, -(-anchors.count() // ANCHOR_BLOCK) or 1
    block = lambda of, k: F.pmod(F.xxhash64(F.col("vec_id"), F.lit(of)), F.lit(k))
    cell = lambda row, anchor: (row * anchor_blocks + anchor).cast("long")
    left = rows.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)), lambda a: cell(block(1, row_blocks), a))))
    right = anchors.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(row_blocks - 1)), lambda r: cell(r, block(2, anchor_blocks)))))
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, schema)


def hard_negatives(rows: DataFrame, is_anchor: str = "vec_id % 100 = 0", id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor is a row for which the SQL expression ``is_anchor`` over vec_id and label holds. Its positives are the first
    POSITIVES other rows of its label; for each of them its negatives are the first NEGATIVES rows of other labels with
    scores from LEAST_PERCENT to MOST_PERCENT of the positive's; first are higher scores, then smaller ids. Which rows take
    part, ``usable`` says. Shorter vectors count as filled up with zeros. Anchors without positives, positives without
    negatives and empty tables give no rows.
    """
    taken = common.settle(usable(rows, id, vector, label))
    n, dims = taken.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dims = max(dims or 1, 1)
    sample = taken.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()
    book = fit_codebook(np.floor(SCALE * _matrix(sample.column("vector"), dims)))
    codes = common.settle(coded(taken, book, dims))
    anchors = codes.where(is_anchor).select("vec_id", "label", "vector")

    def near(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        tile, out = _Tile(rows, anchors, book, dims), []
        for k, anchor, least, most in tile:
            at, exact = positives_of(anchor, least, most, tile.vectors, tile.ids, (tile.labels == tile.own_labels[k]) & (tile.ids != tile.own_ids[k]))
            out.append((np.full(len(at), tile.own_ids[k]), tile.ids[at], exact))
        return _columns(out, ["anchor_id", "positive_id", "positive_score"])

    found = _tiled(codes, anchors, n, near, "anchor_id long, positive_id long, positive_score long")
    order = W.Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= POSITIVES)
    pairs = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # POSITIVES at most
    asked = common.settle(anchors.join(pairs, "vec_id"))

    def hard(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        tile, out = _Tile(rows, anchors, book, dims), []
        positives = anchors.column("positives").to_pylist()
        for k, anchor, least, most in tile:
            other, known = tile.labels != tile.own_labels[k], {}
            for p in positives[k]:
                score = p["positive_score"]
                low, high = -(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100
                if (low, high) not in known:
                    known[low, high] = negatives_of(anchor, least, most, tile.vectors, tile.ids, other, low, high)
                at, exact = known[low, high]
                out.append((np.full(len(at), tile.own_ids[k]), np.full(len(at), p["positive_id"]), tile.ids[at], np.full(len(at), score), exact))
        return _columns(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    mined = _tiled(codes, asked, n, hard, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = W.Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _columns(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64) for _ in names]
    return pa.table([pa.array(c) for c in columns], names)
