"""Best-fit packing of documents' tokens into sequences, bettered by swaps between underfull bins.

Pieces are dealt at random into groups of a bounded number of rows, and every group is packed by itself: best fit,
longest first, then a local search that moves a piece, exchanges one for one or two for one between underfull bins,
each step raising the sum of squared fills, until bins empty. The bins that stay underfull go on to a next
round, until one group holds all of them or the number of sequences no longer falls.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END_ID = 2
GROUP_ROWS = 16_384
#: A bin with at most this many free tokens is left alone by the search and the later rounds.
CLOSED_FREE = 0


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file. Its ids are its merge ranks, so tiktoken gives the same ones, faster."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = _byte_of()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each document's token ids and ``end_id``, cut if longer than ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers, and left out unless ``with_ids``. All pieces but the first
    hold ``capacity`` ids. A null or empty text has the one id ``end_id``. Repeated rows and null ids are documents
    like any other. No shuffle.
    """
    path = path or vocabulary_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode_to_numpy, np.array([end_id], "<u4")
        for batch in common.slices(batches, "text"):
            rows = []
            for key, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encode(t, allowed_special="all"), end], dtype="<u4") if t else end
                starts = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    held = ids[a:b].tobytes()
                    rows.append((key, piece, a, b - a, zlib.crc32(held), held))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    open_by_free: dict[int, list[int]] = defaultdict(list)
    frees = 0  # bit f is set if a bin has f free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fitting := frees >> n:
            free = n + (fitting & -fitting).bit_length() - 1
            b = open_by_free[free].pop()
            if not open_by_free[free]:
                frees ^= 1 << free
            bins[b].append(i)
            free -= n
        else:
            b, free = len(bins), capacity - n
            bins.append([i])
        if free > 0:
            open_by_free[free].append(b)
            frees |= 1 << free
    return bins


class _Index:
    """Underfull bins by their free tokens, and among those of equal free tokens by the lengths of their pieces.

    ``masks``: by free tokens, bit y is set if some such bin has a piece of y tokens; bit 0 if there is such a bin.
    """

    def __init__(self, capacity: int) -> None:
        self.masks = [0] * (capacity + 1)
        self.bins: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]

    def add(self, b: int, free: int, lengths: Iterable[int]) -> None:
        for y in {0, *lengths}:
            self.bins[free].setdefault(y, {})[b] = None
            self.masks[free] |= 1 << y

    def remove(self, b: int, free: int, lengths: Iterable[int]) -> None:
        for y in {0, *lengths}:
            del self.bins[free][y][b]
            if not self.bins[free][y]:
                del self.bins[free][y]
                self.masks[free] ^= 1 << y

    def best_step(self, giver: Counter[int], free: int) -> tuple[int, int, tuple[int, ...], int] | None:
        """The step that carries most from a bin of ``free`` to one no emptier: (tokens carried, bin, given, taken back).

        Carrying d tokens from a bin that holds g to one that holds h raises the sum of squares by 2 d (h + d - g),
        which grows with d. All bins and pieces are looked at together: bit d + y of the shifted mask is set if a bin
        with d or more free would give y back.
        """
        ones = sum(1 << x for x in giver)
        twos = 0
        for x, n in giver.items():
            twos |= (ones if n > 1 else ones ^ 1 << x) << x
        found = 0
        for d in range(free, 0, -1):
            found |= self.masks[d]
            if hit := found << d & ones:
                x = (hit & -hit).bit_length() - 1
                given: tuple[int, ...] = (x,)
            elif hit := (found & ~1) << d & twos:  # two for none: two moves do that
                x = (hit & -hit).bit_length() - 1
                one = next(v for v in giver if (x - v in giver) and (x != 2 * v or giver[v] > 1))
                given = (one, x - one)
            else:
                continue
            y = x - d
            fullest = next(f for f in range(d, free + 1) if self.masks[f] >> y & 1)
            return d, next(iter(self.bins[fullest][y])), given, y
        return None

    def sums(self) -> list[int]:
        """By free tokens: bit f + y is set if a bin of more than so many free tokens, f, has a piece of y tokens."""
        out = [0]
        for f in range(len(self.masks) - 1, 0, -1):
            out.append(out[-1] | self.masks[f] << f)
        return out[::-1]

    def step_down(self, giver: Counter[int], free: int, sums: list[int]) -> tuple[int, int, tuple[int, ...], int] | None:
        """A step from a bin of ``free`` to an emptier one that raises the sum of squares, as ``best_step`` gives it.

        Giving x for y to a bin of f raises it if f + y lies from x to less than x + free: then the taker ends fuller
        than the giver was. ``sums`` must be those of the present bins.
        """
        ones, twos = sum(1 << x for x in giver), 0
        for x, n in giver.items():
            twos |= (ones if n > 1 else ones ^ 1 << x) << x
        near, done = sums[free], 1
        while done < free:
            further = min(done, free - done)
            near, done = near | near >> further, done + further
        for sizes in (ones, twos):
            if hit := near & sizes & ~1:
                x = hit.bit_length() - 1
                total = x + ((part := sums[free] >> x) & -part).bit_length() - 1
                f = next(f for f in range(free + 1, len(self.masks)) if 0 <= total - f and self.masks[f] >> (total - f) & 1)
                y = total - f
                one = x if sizes is ones else next(v for v in giver if x - v in giver and (x != 2 * v or giver[v] > 1))
                return x - y, next(iter(self.bins[f][y])), (x,) if sizes is ones else (one, x - one), y
        return None


def swap_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Move, exchange one for one and two for one among all underfull bins, the emptiest giving first.

    Each step raises the sum of squared fills; a bin gives to fuller ones until it is empty or no step is left for it.
    When all bins have none left, fuller bins are asked for steps into emptier ones, and the passes go on from there.
    They end when there is no step either way, so no single step betters the result.
    """
    size = lengths.tolist()
    free = [capacity - sum(size[i] for i in b) for b in bins]
    index = _Index(capacity)
    of = lambda b: (size[i] for i in bins[b])
    underfull = lambda: sorted((b for b in range(len(bins)) if bins[b] and free[b] > CLOSED_FREE), key=lambda b: -free[b])

    def make(a: int, step: tuple[int, int, tuple[int, ...], int]) -> None:
        """Carry out a step of ``a``, which is not in the index."""
        d, b, given, taken = step
        index.remove(b, free[b], of(b))
        out = []
        for x in given:
            out.append(next(i for i in bins[a] if size[i] == x and i not in out))
        back = [next(i for i in bins[b] if size[i] == taken)] if taken else []
        bins[a] = [i for i in bins[a] if i not in out] + back
        bins[b] = [i for i in bins[b] if i not in back] + out
        free[a], free[b] = free[a] + d, free[b] - d
        if free[b] > CLOSED_FREE:
            index.add(b, free[b], of(b))

    for b in underfull():
        index.add(b, free[b], of(b))
    stepped = True
    while stepped:
        stepped = False
        for a in underfull():
            if free[a] <= CLOSED_FREE:
                continue  # filled in this pass
            index.remove(a, free[a], of(a))
            while bins[a] and (step := index.best_step(Counter(of(a)), free[a])):
                make(a, step)
                stepped = True
            if bins[a]:
                index.add(a, free[a], of(a))
        if not stepped:
            sums = index.sums()
            for a in underfull():
                if free[a] > CLOSED_FREE and (step := index.step_down(Counter(of(a)), free[a], sums)):
                    index.remove(a, free[a], of(a))
                    make(a, step)
                    if bins[a]:
                        index.add(a, free[a], of(a))
                    sums, stepped = index.sums(), True
    return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, bins: list[list[int]] | None = None) -> list[list[int]]:
    """The fewer bins of those searched from best fit and, if given, from ``bins``."""
    fresh = swap_search(best_fit(lengths, capacity), lengths, capacity)
    if bins is None:
        return fresh
    return min(swap_search(bins, lengths, capacity), fresh, key=len)


def _assign(columns: list[str], length: str, capacity: int, base: int, groups: int, open_name: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs one of ``groups``; sequences are numbered from ``base`` up, those of the groups in turn; ``open_name`` marks the rows of bins that stay underfull."""

    def assign(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group[length].to_numpy(np.int64)
        if not 1 <= lengths.min() <= lengths.max() <= capacity:
            raise ValueError(f"lengths must be 1 to {capacity}")
        held = group["sequence_id"].reset_index(drop=True)
        before = None if held.isna().any() else [rows.tolist() for rows in held.groupby(held).indices.values()]
        order, bins, offsets, open_ = [], [], [], []
        for b, items in enumerate(pack_lengths(lengths, capacity, before)):
            ends = np.cumsum(lengths[items])
            order += items
            bins += [base + b * groups + int(key[0])] * len(items)
            offsets += [0, *ends[:-1].tolist()]
            open_ += [capacity - int(ends[-1]) > CLOSED_FREE] * len(items)
        out = group.iloc[order][columns]
        return out.assign(**{"sequence_id": pd.Series(bins, out.index, "Int64"), "offset": pd.Series(offsets, out.index, "Int64"), open_name: pd.Series(open_, out.index, bool)})

    return assign


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each row's sequence, and its place there, gapless from 0.

    Lengths are 1 to ``capacity`` (others fail). Every row is packed, repeated rows too; what other columns hold,
    nulls included, doesn't matter, but columns of the two new names are replaced. An empty table stays empty.
    Each round packs groups of about ``group_rows`` rows in parallel and passes on only the bins that stay underfull,
    until they are one group. Rounds end before that only when one makes no fewer sequences than the round before.
    """
    pieces = pieces.drop("sequence_id", "offset")
    group, open_ = common.free(pieces, "_group", "_open")
    marks = {"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), open_: F.lit(True)}
    schema = pieces.withColumns(marks).schema
    columns = pieces.columns
    left = common.settle(pieces.withColumns(marks))
    rows, base, done, sequences = left.count(), 0, [], None
    while rows:
        groups = max(1, rows // group_rows)
        # Row numbers of a checkpoint are the same at every reading, so a task that runs again gets the same group.
        # Later rounds deal sequences whole and go on from them, so their number never rises.
        dealt = left.withColumn(group, F.pmod(F.xxhash64(F.coalesce("sequence_id", F.monotonically_increasing_id())), F.lit(groups))).repartition(common.wide(left.sparkSession), group)
        packed = common.settle(dealt.groupBy(group).applyInPandas(_assign(columns, length, capacity, base, groups, open_), schema))
        begins = F.col("offset") == 0
        made, unfilled, rows, last = packed.agg(F.count_if(begins), F.count_if(begins & F.col(open_)), F.count_if(open_), F.max("sequence_id")).first()
        if sequences is not None and made >= sequences:
            done.append(left)  # as the round before packed them
            break
        if groups == 1:
            done.append(packed)
            break
        done.append(packed.where(~F.col(open_)))
        left, sequences = packed.where(open_), unfilled
        base = last + 1
    if not done:
        done.append(left)
    return functools.reduce(DataFrame.unionByName, done).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Each document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The ids stay behind: at 100 TB the plan moves a few numbers a piece. To write sequences, join ``cut`` to this on
    (doc_id, piece), deal by ``sequence_id`` and sort by ``offset``.
    """
    return pack(cut(docs, id, text, capacity, end_id, path, with_ids=False), capacity=capacity)
