"""Publishing: results go to a folder of their own, and a small manifest names the one that counts.

A run that fails its gate publishes nothing, and readers keep the last good result. All files are written by Spark, so
any store that it can write will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.errors import AnalysisException


class Unreliable(RuntimeError):
    """Too much of a run is missing for its result to count."""


def gate(rows: DataFrame, lost: F.Column, least: int = 3, share: float = 0.03) -> None:
    """Raise if more rows are ``lost`` than ``least`` and than ``share`` of all."""
    n, bad = rows.agg(F.count(F.lit(1)), F.count(F.when(lost, 1))).first()
    if bad > max(least, share * n):
        raise Unreliable(f"{bad} of {n} rows are lost")


def publish(rows: DataFrame, folder: str, version: str) -> None:
    """Write ``rows`` as ``version``, then make it the one that counts. Versions sort by name."""
    rows.write.mode("overwrite").parquet(f"{folder}/{version}")
    rows.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{folder}/manifest")


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The published rows; None before the first."""
    try:
        newest = spark.read.schema("version string").json(f"{folder}/manifest").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    return spark.read.parquet(f"{folder}/{newest}") if newest else None


def appended(history: DataFrame | None, rows: DataFrame, key: list[str], at: str, keep: int = 12) -> DataFrame:
    """``history`` and ``rows`` together, the newest ``keep`` of each key by ``at``."""
    both = rows if history is None else history.unionByName(rows)
    place = F.row_number().over(W.Window.partitionBy(*key).orderBy(F.desc(at)))
    return both.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def upserted(table: DataFrame | None, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of equal keys."""
    return rows if table is None else table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def overlaid(rows: DataFrame, status: DataFrame, key: str = "todo_id", default: str = "open") -> DataFrame:
    """``rows`` with the ``status`` that was set for their key, or the default."""
    return rows.join(status.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit(default)))


def fresh_or_kept(now: DataFrame, before: DataFrame, url: str = "url", digest: str = "hash", kept: str = "summary") -> DataFrame:
    """``now`` with what was made before for the same page and content; null where it must be made anew."""
    known = before.where(F.coalesce(F.col(kept), F.lit("")) != "").select(url, digest, kept).dropDuplicates([url, digest])
    return now.drop(kept).join(known, [url, digest], "left")
