"""Streams: what a site has newly listed, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NEW = "domain string, url string"


def _emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A slice's URLs that weren't known; what comes with its domain's mark, in the domain's first batch, is silent."""
    known = set(state.get[0]) if state.exists else None
    seen = {u for b in batches for u in b["url"].dropna()}
    if known is not None and (fresh := sorted(seen - known)):
        yield pd.DataFrame({"domain": key[0], "url": fresh})
    state.update((sorted(seen | (known or set())),))


def new_listings(listings: DataFrame, slices: int = 64) -> DataFrame:
    """(domain, url): rows of the stream ``listings`` that their domain didn't list before; a domain's first batch is silent.

    State is kept by domain and slice of its URLs, so that no group holds a whole large site. When a domain is first
    seen, each of its slices is marked, so a slice that gets its first URL later knows that it is new. Rows with a null
    are left out.
    """
    rows = listings.where("domain IS NOT NULL AND url IS NOT NULL").select("domain", "url")
    own = rows.select("domain", F.pmod(F.xxhash64("url"), F.lit(slices)).cast("int").alias("slice"), "url")
    first = rows.select("domain").dropDuplicates(["domain"])
    marks = first.select("domain", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(None).cast("string").alias("url"))
    return own.unionByName(marks).groupBy("domain", "slice").applyInPandasWithState(_emit, NEW, "known array<string>", "append", GroupStateTimeout.NoTimeout)


def _marked(events: DataFrame, late: str) -> DataFrame:
    """``events`` with a watermark, which needs a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type and window; events later than ``late`` are dropped by the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = _marked(events, late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Each user's sessions: runs of events with no longer gap."""
    rows = _marked(events, late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return rows.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
