"""A sweep over brands: each brand's stages run as Spark jobs of their own, and what fails is a row, not the end.

The first stage that is needed and fails ends its brand, and no other; stages that are extras may fail without that. Every
stage leaves a row (brand, stage, outcome, reason), and the rows are counted into ok, partial or failed.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sitelumen.sources.versioned import VersionedTable

#: Brands that a sweep takes, all of which the driver knows by name, and those at work at the same time.
MOST_BRANDS, AT_ONCE = 10_000, 4
#: Characters of a reason that are kept.
REASON_CHARS = 300
OUTCOMES = "brand string, place int, stage string, outcome string, reason string, rows long"


class Stage(NamedTuple):
    """``make(brand)`` gives the stage's rows of a brand, or raises; ``needed``: without it the brand has failed."""

    name: str
    make: Callable[[Row], DataFrame | None]
    needed: bool = True


def _run(spark: SparkSession, brand: Row, stages: list[Stage], keep: Callable[[Row, str, DataFrame], int]) -> list[tuple]:
    out, over = [], False
    for place, stage in enumerate(stages):
        if over:
            out.append((brand.brand, place, stage.name, "skipped", "a stage before it failed", None))
            continue
        try:
            rows = stage.make(brand)
            out.append((brand.brand, place, stage.name, "ok", None, None if rows is None else keep(brand, stage.name, rows)))
        except Exception as failure:  # noqa: BLE001 - one brand must not end the sweep
            out.append((brand.brand, place, stage.name, "failed", f"{type(failure).__name__}: {failure}"[:REASON_CHARS], None))
            over = stage.needed
    return out


def sweep(brands: DataFrame, stages: list[Stage], keep: Callable[[Row, str, DataFrame], int], at_once: int = AT_ONCE) -> DataFrame:
    """OUTCOMES of every enabled row of ``brands`` (brand, enabled, more), each of which is known by its name once.

    ``keep(brand, stage, rows)`` writes a stage's rows and gives their number; it runs only for whole stages, so a failing one
    leaves what was kept before.
    """
    spark = brands.sparkSession
    wanted = brands.where("brand IS NOT NULL").where(F.coalesce("enabled", F.lit(True))).dropDuplicates(["brand"]).orderBy("brand").limit(MOST_BRANDS + 1).collect()
    if len(wanted) > MOST_BRANDS:
        raise ValueError(f"more than {MOST_BRANDS} brands")
    with ThreadPoolExecutor(at_once) as pool:
        rows = [r for own in pool.map(lambda b: _run(spark, b, stages, keep), wanted) for r in own]
    return spark.createDataFrame(rows, OUTCOMES)


def by_brand(outcomes: DataFrame, stages: list[Stage]) -> DataFrame:
    """(brand, outcome): failed if a needed stage did, partial if another one did, else ok."""
    needed = F.col("stage").isin([s.name for s in stages if s.needed])
    failed = F.col("outcome") == "failed"
    return outcomes.groupBy("brand").agg(F.when(F.max(failed & needed), "failed").when(F.max(failed), "partial").otherwise("ok").alias("outcome"))


def summary(brands: DataFrame) -> DataFrame:
    """(brands, ok, partial, failed, status) of ``by_brand``: failed if all brands are, partial if some are, ok else and without any."""
    count = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    rows = brands.agg(F.count(F.lit(1)).alias("brands"), count("ok"), count("partial"), count("failed"))
    return rows.withColumn("status", F.when((F.col("failed") > 0) & (F.col("failed") == F.col("brands")), "failed").when(F.col("failed") > 0, "partial").otherwise("ok"))


def keep_in(spark: SparkSession, folder: str) -> Callable[[Row, str, DataFrame], int]:
    """Keeps each brand's rows of a stage as a table of versions of its own; an older version stays for those who read it."""

    def keep(brand: Row, stage: str, rows: DataFrame) -> int:
        table = VersionedTable(spark, f"{folder}/{stage}/{brand.brand}")
        done = table.change(lambda now, about: (rows, about))
        table.vacuum()
        return spark.read.parquet(done.path).count()

    return keep


def on_requests(requests: DataFrame, stages: list[Stage], folder: str, checkpoint: str, at_once: int = AT_ONCE) -> object:
    """Sweep the brands that a stream of requests names, all that there are, and end. Outcomes go to ``folder``/outcomes, a batch a folder, so a batch that comes again replaces its own."""

    def batch(rows: DataFrame, number: int) -> None:
        told = sweep(rows, stages, keep_in(rows.sparkSession, folder), at_once)
        told.write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
