"""Sharding by Karmarkar-Karp differencing: groups of equal texts stay whole, and the shards' bytes are near equal.

A partial partition is a way to deal some groups into as many bins as there are shards. Differencing takes the two
partial partitions of the largest spread and joins them in opposite order, the fullest bin of one with the emptiest
of the other, until one is left. Here chunks of groups are differenced in parallel, which leaves each chunk one
partial partition of small spread; chunks are then joined by the same rule, a bounded number at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

SHARDS = 16
#: Groups that one task differences, partial partitions that one task joins, and rows of one numbering piece.
CHUNK_GROUPS, FAN_IN, PIECE_ROWS = 20_000, 1024, 20_000


def difference(parts: np.ndarray) -> np.ndarray:
    """From partial partitions (a row each, a column a bin), the final bin of each row's columns.

    The last partial partition's bins are numbered from the fullest down.
    """
    n, bins = parts.shape
    sums = np.sort(parts, axis=1)[:, ::-1]
    order = np.argsort(-parts, axis=1, kind="stable")  # order[i, r]: the column of part i that is in place r
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    held: dict[int, np.ndarray] = dict(enumerate(sums))
    joins: list[tuple[int, int, np.ndarray]] = []
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = held.pop(a) + held.pop(b)[::-1]
        places = np.argsort(-total, kind="stable")
        held[fresh] = total[places]
        joins.append((a, b, places))
        heapq.heappush(heap, (-int(total[places[0]] - total[places[-1]]), fresh))
        fresh += 1
    # place[x][r]: where place r of node x ends up; found from the last join back to the parts.
    place = np.empty((fresh, bins), np.int64)
    place[fresh - 1] = np.arange(bins)
    for k in reversed(range(len(joins))):
        a, b, places = joins[k]
        to = np.empty(bins, np.int64)
        to[places] = place[n + k]
        place[a], place[b] = to, to[::-1]
    final = np.empty((n, bins), np.int64)
    np.put_along_axis(final, order, place[:n], axis=1)
    return final


def _deal(shards: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Differences one chunk of groups, each a partial partition with all its bytes in one bin."""

    def deal(key: tuple, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "group"], ascending=[False, True])
        parts = np.zeros((len(groups), shards), np.int64)
        parts[:, 0] = groups["bytes"]
        return pd.DataFrame({"group": groups["group"], "bytes": groups["bytes"], "chunk": key[0], "bin": difference(parts)[:, 0]})

    return deal


def _combine(shards: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Joins the partial partitions of up to FAN_IN chunks: for each chunk and bin, the bin of the joint partition."""

    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chunks = np.sort(rows["chunk"].unique())
        parts = np.zeros((len(chunks), shards), np.int64)
        parts[np.searchsorted(chunks, rows["chunk"]), rows["bin"]] = rows["bytes"]
        return pd.DataFrame({"chunk": np.repeat(chunks, shards), "bin": np.tile(np.arange(shards), len(chunks)), "bytes": parts.ravel(), "joint": key[0], "joint_bin": difference(parts).ravel()})

    return combine


def partition(groups: DataFrame, shards: int = SHARDS, chunk_groups: int = CHUNK_GROUPS) -> DataFrame:
    """(group, shard) from (group, bytes): different groups, dealt so that the shards' bytes are near equal."""
    spark = groups.sparkSession
    chunks = max(1, -(-groups.count() // chunk_groups))
    chunk = F.pmod(F.xxhash64("group"), F.lit(chunks))
    dealt = common.settle(groups.select("group", "bytes", chunk.alias("_chunk")).repartition(common.wide(spark), "_chunk").groupBy("_chunk").applyInPandas(_deal(shards), "group binary, bytes long, chunk long, bin long"))
    sums = dealt.groupBy("chunk", "bin").agg(F.sum("bytes").alias("bytes"))
    steps = []
    while True:
        joints = max(1, -(-chunks // FAN_IN))
        step = common.settle(sums.withColumn("_joint", F.floor(F.col("chunk") / FAN_IN)).groupBy("_joint").applyInPandas(_combine(shards), "chunk long, bin long, bytes long, joint long, joint_bin long"))
        steps.append(step)
        if joints == 1:
            break
        sums = step.groupBy(F.col("joint").alias("chunk"), F.col("joint_bin").alias("bin")).agg(F.sum("bytes").alias("bytes"))
        chunks = joints
    # From the top down: what bin of the last joint partition each chunk's bin has become.
    name = steps.pop().select("chunk", "bin", F.col("joint_bin").alias("shard"))
    while steps:
        upper = name.select(F.col("chunk").alias("joint"), F.col("bin").alias("joint_bin"), "shard")
        name = steps.pop().join(upper, ["joint", "joint_bin"]).select("chunk", "bin", "shard")
    return dealt.join(name, ["chunk", "bin"]).select("group", F.col("shard").cast("int").alias("shard"))


def numbered(rows: DataFrame, by: str, order: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``rows`` with ``slot``: their place among those of equal ``by``, gapless from 0, without one task for each ``by``.

    ``rows`` must give the same rows whenever it is read. They are cut into pieces by a hash of ``order``, the
    pieces' counts add up to each piece's first slot, and only a piece is sorted. Rows that are equal in ``order``
    share a piece.
    """
    pieces = max(1, -(-rows.count() // piece_rows))
    cut = rows.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    sizes = cut.groupBy(by, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.Window.partitionBy(by).orderBy("_piece").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(by, "_piece", before.alias("_before"))
    place = F.row_number().over(W.Window.partitionBy(by, "_piece").orderBy(*order)) - 1
    return cut.withColumn("_place", place).join(starts, [by, "_piece"]).withColumn("slot", (F.col("_before") + F.col("_place")).cast("long")).drop("_piece", "_place", "_before")


def shard(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    ``size``: UTF-8 bytes and 1 more; a null text has none, and is one group with the empty ones. Rows of equal
    texts, told by SHA-256, share a shard. The law is ``bytes``: the shards' sizes are near equal, or if a group is
    larger than an even share, as near as whole groups allow. Repeated rows stay rows; ids may be null.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = common.settle(docs.select(F.col(id).cast("long").alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(whole, 256)).alias("group")))
    groups = common.settle(rows.groupBy("group").agg(F.sum("size").alias("bytes")))
    placed = common.settle(rows.join(partition(groups, shards), "group").select("doc_id", "size", "text_crc32", "shard"))
    done = numbered(placed, "shard", ["doc_id", "text_crc32", "size"])
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
