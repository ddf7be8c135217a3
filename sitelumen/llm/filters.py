"""How five document filters interact in every order: what each removes, what it removes again, and what it alone removes.

A document fails a set of the filters, one of 32. A table of 32 sets by 120 orders, made once, holds the step at which
each order removes each set. Batches of documents index it, and ``np.bincount`` adds up their part, order and step;
the arrays that tasks so gather are then added up by part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

# The filters' letters and limits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = "#$%&*|"

ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_STEPS, _SETS = len(FILTERS), 1 << len(FILTERS)
#: Filter of each order and step.
_FILTER = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
#: Parts whose arrays a task holds at a time: 15 KB each.
HELD_PARTS = 2_000
#: Counts that a part's array holds: for all rows, good ones and toxic ones, removals by order and step, kept rows as the last step.
_CELLS = len(ORDERS) * (_STEPS + 1)


def first_failures() -> np.ndarray:
    """(sets, orders): the step, from 0, at which each order removes a document that fails each set; the number of steps, if none does."""
    fails = (np.arange(_SETS)[:, None, None] >> _FILTER[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), _STEPS)


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in characters]] = 1
    return out


_CAPITAL, _SYMBOL = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table(SYMBOLS)
_POINT = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)  # bytes that begin a code point


def failed(texts: list[str | None]) -> np.ndarray:
    """Which of the filters A to D each text fails, as bits. A null text is empty."""
    w = wordhash.words(texts)
    n = len(texts)
    hashes = wordhash.mix(wordhash.word_hashes(w) ^ wordhash.mix(w.doc.astype(np.uint64) + np.uint64(1)))
    _, where = np.unique(hashes, return_index=True)
    distinct = np.bincount(w.doc[where], minlength=n)
    total = lambda table: np.diff(np.append(0, np.cumsum(table[w.data]))[w.bounds])
    capitals, symbols, points = total(_CAPITAL), total(_SYMBOL), total(_POINT) - 1  # a line feed follows each text
    counts = w.counts
    rules = counts < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * counts, 100 * capitals > MOST_CAPITAL_PERCENT * points, symbols > 0
    return sum(rule.astype(np.int64) << k for k, rule in enumerate(rules))


def checked(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, part, fails) of each row: the filters that it fails, as bits.

    E fails if a row of a smaller id has the same text, told by SHA-256; a row without an id neither fails E nor makes
    others fail it. Texts are read once and don't move: their digests are grouped, and those of more than one id are
    joined back (sent to where rows are if few, otherwise by a join whose hot keys Spark splits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            made = failed(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("digest"), pa.array(made)], ["doc_id", "part", "digest", "fails"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), whole.alias("text"))
    rows = common.settle(rows.mapInArrow(run, "doc_id long, part string, digest binary, fails long"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    joined = rows.join(common.small(common.settle(first)), "digest", "left")
    again = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return joined.select("doc_id", "part", (F.col("fails") + again).alias("fails"))


def labelled(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """(doc_id, good, toxic): whether any row of the id says so."""
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    return labels.where(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def _row(part: str, cells: np.ndarray, sets: np.ndarray) -> Iterator[tuple]:
    """A part's rows of the result. cells: (3, orders, steps + 1); sets: rows by the set of filters that they fail."""
    n = sets.sum()
    bit = lambda f: (np.arange(_SETS) >> f & 1).astype(bool)
    fails = np.array([sets[bit(f)].sum() for f in range(_STEPS)])
    alone = sets[1 << np.arange(_STEPS)]
    shapley = np.bincount(_FILTER.ravel(), cells[0, :, :_STEPS].ravel(), _STEPS).astype(np.int64)
    for o, order in enumerate(ORDERS):
        kept = n
        for s, f in enumerate(_FILTER[o]):
            removed = cells[0, o, s]
            kept -= removed
            yield part, order, s + 1, int(kept), int(removed), int(fails[f] - removed), int(alone[f]), int(cells[1, o, s]), int(cells[2, o, s]), int(shapley[f])


def _counted(rows: DataFrame) -> DataFrame:
    """(part, counts): arrays that tasks have gathered from (part, fails, good, toxic) rows. A part has one a task, or several."""
    table = first_failures()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], ["part", "counts"])
            held.clear()
            return out

        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            fails = batch.column("fails").to_numpy()
            kinds = np.ones(len(part), bool), batch.column("good").to_numpy() == 1, batch.column("toxic").to_numpy() == 1
            for start in range(0, len(part), 4096):
                at = slice(start, start + 4096)
                some, own = np.unique(part[at], return_inverse=True)
                cell = (own[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (_STEPS + 1) + table[fails[at]]
                sums = [np.bincount(cell[kind[at]].ravel(), minlength=len(some) * _CELLS).reshape(len(some), -1) for kind in kinds]
                sums.append(np.bincount(own * _SETS + fails[at], minlength=len(some) * _SETS).reshape(len(some), -1))
                for k, total in zip(some.tolist(), np.concatenate(sums, 1), strict=True):
                    held[names[k]] = held[names[k]] + total if names[k] in held else total
                if len(held) > HELD_PARTS:
                    yield told()
        if held:
            yield told()

    return rows.mapInArrow(run, "part string, counts array<bigint>")


def _added(counted: DataFrame, salts: int = 1) -> DataFrame:
    """The arrays of each part, added up in turn: a task holds one part's array at a time. ``salts``: sums of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["part", "counts"])
        for batch in batches:
            for name, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                own = counts.values.to_numpy()
                if name != part:
                    if total is not None:
                        yield told()
                    part, total = name, own.copy()
                else:
                    total += own
        if total is not None:
            yield told()

    salted = counted.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    dealt = salted.repartition(common.wide(counted.sparkSession), "part", "salt").sortWithinPartitions("part")
    return dealt.select("part", "counts").mapInArrow(run, "part string, counts array<bigint>")


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A part is a source, a null one the empty string. Each has 120 orders of 5 steps, zeros included. Null texts are empty.
    Repeated rows count each; labels of a repeated id count if any row has them, and only for rows of that id. An empty
    table has no parts and gives no rows.
    """
    says = labelled(labels)
    rows = checked(docs, id, text, source)
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counted = _counted(rows.join(says, "doc_id", "left").select("part", "fails", flag("good"), flag("toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                own = counts.values.to_numpy()
                made = list(_row(part, own[: 3 * _CELLS].reshape(3, len(ORDERS), _STEPS + 1), own[3 * _CELLS :]))
                yield pa.RecordBatch.from_arrays([pa.array(c) if k < 2 else pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(zip(*made, strict=True))], names)

    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[3:])
    return _added(_added(counted, 16)).mapInArrow(run, schema)
