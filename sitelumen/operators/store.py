"""Results that a plan needs several times, written to the folder that all executors share; batches of bounded bytes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(rows: DataFrame) -> DataFrame:
    """``rows``, written to the folder that spark.checkpoint.dir names and read from there, so nothing above runs twice.

    Only a local session may do without that setting: a folder of its own is then made.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return rows.checkpoint(eager=True)


#: Rows up to which a settled table of keys is sent to every executor: some 20 MB.
SMALL_ROWS = 200_000


def small(rows: DataFrame) -> DataFrame:
    """Settled ``rows``, marked for broadcast if they are counted to be SMALL_ROWS at most; more are joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of which ``column`` has about ``most`` bytes, or one row if that has more."""
    for batch in batches:
        upto = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(batch.column(column)), 0), pa.int64())).to_numpy() // most
        cuts = [0, *(k + 1 for k in range(batch.num_rows - 1) if upto[k] != upto[k + 1]), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)
