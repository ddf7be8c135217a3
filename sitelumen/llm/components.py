"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (u long, v long), the smallest node that it reaches.

    Large-star and small-star steps in turn: each links nodes to the smallest one that a neighbourhood knows, until
    every component is a star about its smallest node. Each round is written to the checkpoint folder; what the
    driver sees of it is a count and a sum. Loops and repeated edges don't matter; edges with a null are left out.
    """
    stars = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    stars, seen = common.settle(stars), None
    while True:
        told = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == seen or not told[0]:
            break
        seen = told
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
        stars = common.settle(small.select("e.u", "e.v").where("u > v").distinct())
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
