"""What the operators of this subpackage share: reading, checkpoints, and slices of Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an operator turns into arrays at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so that nothing above it runs twice.

    The folder is the one that the session names in spark.checkpoint.dir. Only a local session may do without:
    a folder of its own is then made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores behind those that ``df`` has as columns, so that no column of its user is hidden."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows up to which a table of keys or thresholds, counted first, is sent to every executor: some 20 MB.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A settled ``df``, marked for broadcast if it has SMALL_ROWS rows at most; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def wide(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes at most, or one row."""
    for batch in batches:
        sizes = batch.column(column).nbytes
        if sizes <= limit:
            if batch.num_rows:
                yield batch
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
