"""Windows and sessions of events, in batch form, and Core Web Vitals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.functions import scoring as S
from sitelumen.streaming import watch


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.event_windows(_events(spark, sf_dir)).select("start", "event_type", "events", F.round("total", 4).alias("total"))


EVENT_WINDOWS = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.sessions(_events(spark, sf_dir)).select("user_id", "start", "events")


USER_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n
"""


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assessment of each event type as a page: its p75 values stand for the Core Web Vitals; all three must be known and good."""
    ranked = _events(spark, sf_dir).groupBy(F.col("event_type").alias("page")).agg(F.round(F.percentile("value", 0.75) * 100, 3).alias("p75"), F.count(F.lit(1)).alias("n"))
    good, fair = S.VITALS["largest_contentful_paint"]
    return ranked.select("page", "p75", F.when(F.col("n") < 10, None).when(F.col("p75") <= good, "good").when(F.col("p75") <= fair, "needs-improvement").otherwise("poor").alias("rating"))


VITALS = "WITH r AS (SELECT event_type AS page, round(quantile_cont(value, 0.75) * 100, 3) AS p75, count(*) AS n FROM events GROUP BY 1) SELECT page, p75, CASE WHEN n < 10 THEN NULL WHEN p75 <= 2500 THEN 'good' WHEN p75 <= 4000 THEN 'needs-improvement' ELSE 'poor' END AS rating FROM r"

_ALL = (event_windows, user_sessions, vitals)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
