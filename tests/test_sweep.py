"""Sweeps over brands whose stages fail."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelumen.sources.versioned import VersionedTable
from sitelumen.streaming import sweep


def stages_of(spark, broken):
    def rows(brand, n):
        return spark.range(n).select(F.lit(brand.brand).alias("brand"), "id")

    def crawl(brand):
        if brand.brand in broken.get("crawl", ()):
            raise RuntimeError("no answer")
        return rows(brand, 3)

    def audit(brand):
        bad = brand.brand in broken.get("audit", ())
        return rows(brand, 2).withColumn("x", F.raise_error(F.lit("bad row")) if bad else F.lit("fine"))  # fails in a task, while it is kept

    def watch(brand):
        if brand.brand in broken.get("watch", ()):
            raise ValueError("x" * 1000)

    return [sweep.Stage("crawl", crawl), sweep.Stage("audit", audit), sweep.Stage("watch", watch, needed=False)]


def brands(spark, *names):
    return spark.createDataFrame([(n, n != "off") for n in names], "brand string, enabled boolean")


def test_a_failing_brand_leaves_the_others(spark, tmp_path):
    stages = stages_of(spark, {"crawl": "a", "audit": "b", "watch": "c"})
    told = sweep.sweep(brands(spark, "a", "b", "c", "d", "d", "off", None), stages, sweep.keep_in(spark, str(tmp_path))).cache()
    got = {(r.brand, r.stage): r.outcome for r in told.collect()}
    assert got == {
        ("a", "crawl"): "failed", ("a", "audit"): "skipped", ("a", "watch"): "skipped", ("b", "crawl"): "ok", ("b", "audit"): "failed", ("b", "watch"): "skipped",
        ("c", "crawl"): "ok", ("c", "audit"): "ok", ("c", "watch"): "failed", ("d", "crawl"): "ok", ("d", "audit"): "ok", ("d", "watch"): "ok",
    }
    reason = {(r.brand, r.stage): r.reason for r in told.collect()}
    assert reason["a", "crawl"] == "RuntimeError: no answer" and "bad row" in reason["b", "audit"] and len(reason["c", "watch"]) == 300
    assert {r.brand: r.outcome for r in sweep.by_brand(told, stages).collect()} == {"a": "failed", "b": "failed", "c": "partial", "d": "ok"}
    assert tuple(sweep.summary(sweep.by_brand(told, stages)).first()) == (4, 1, 1, 2, "partial")
    assert VersionedTable(spark, str(tmp_path / "audit" / "b")).read() is None and VersionedTable(spark, str(tmp_path / "audit" / "d")).read().count() == 2


def test_what_was_kept_before_stays(spark, tmp_path):
    keep = sweep.keep_in(spark, str(tmp_path))
    sweep.sweep(brands(spark, "a"), stages_of(spark, {}), keep)
    told = sweep.sweep(brands(spark, "a"), stages_of(spark, {"audit": "a"}), keep)
    assert Counter(r.outcome for r in told.collect()) == {"ok": 1, "failed": 1, "skipped": 1}
    assert VersionedTable(spark, str(tmp_path / "audit" / "a")).read().count() == 2


@pytest.mark.parametrize(("outcomes", "status"), [([], "ok"), (["ok", "partial"], "ok"), (["ok", "failed"], "partial"), (["failed", "failed"], "failed")])
def test_status(spark, outcomes, status):
    rows = spark.createDataFrame([(str(k), o) for k, o in enumerate(outcomes)], "brand string, outcome string")
    assert sweep.summary(rows).first().status == status


def test_requests_as_a_stream(spark, tmp_path):
    for names in (("a", "b"), ("c",)):
        brands(spark, *names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("brand string, enabled boolean").parquet(str(tmp_path / "in"))
        sweep.on_requests(stream, stages_of(spark, {"crawl": "b"}), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    told = spark.read.parquet(str(tmp_path / "out" / "outcomes"))
    assert {(r.batch, r.brand, r.outcome) for r in told.where("stage = 'crawl'").collect()} == {(0, "a", "ok"), (0, "b", "failed"), (1, "c", "ok")}
