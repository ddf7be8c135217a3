"""Remembered focus keywords: what was once chosen for a page holds while the page is the same, and is forgotten with it.

A sighting of a page says what it looked like (``fp``), perhaps the search it earns most for (``query``), and perhaps what a
model chose for it (``keyword``). In order of time: the search comes first; else what is remembered for the same look; else the
model's choice, which is then remembered; else nothing. Every sighting keeps what is remembered alive; after KEEP_DAYS
without one it is forgotten. Times are those of the sightings, so a stream and a batch give the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: days that a page may be gone.
KEEP_DAYS = 60
SIGHTINGS = "url string, ts timestamp, fp string, query string, keyword string"
CHOSEN = "url string, ts timestamp, keyword string, source string"

#: What is remembered: keyword, look, and microseconds of the last sighting.
Memo = tuple[str, str, int]
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_KEEP = KEEP_DAYS * 86_400_000_000


def micros(at: datetime) -> int:
    return (at.astimezone(UTC) - _EPOCH) // timedelta(microseconds=1)


def seen(memo: Memo | None, ts: int, fp: str | None, query: str | None, keyword: str | None) -> tuple[Memo | None, str | None, str]:
    """(memo, keyword, source) after a sighting."""
    if memo is not None and ts - memo[2] > _KEEP:
        memo = None
    if query:
        chosen, source = query, "search-console"
    elif memo is not None and memo[1] == (fp or ""):
        chosen, source = memo[0], "remembered"
    elif keyword:
        memo, chosen, source = (keyword, fp or "", ts), keyword, "model"
    else:
        chosen, source = None, "none"
    return (None if memo is None else (memo[0], memo[1], max(ts, memo[2]))), chosen, source


def _order(rows: DataFrame) -> DataFrame:
    """Sightings that count, with the time in microseconds; a null URL or time doesn't."""
    return rows.where("url IS NOT NULL AND ts IS NOT NULL").select("url", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "fp", "query", "keyword")


def chosen(sightings: DataFrame) -> DataFrame:
    """CHOSEN of a table of SIGHTINGS. A page's sightings are read in order, one at a time, so a page may have any number of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        url, memo = None, None
        for batch in batches:
            made = []
            for r in batch.itertuples(index=False):
                if r.url != url:
                    url, memo = r.url, None
                text = lambda x: x if isinstance(x, str) else None
                memo, keyword, source = seen(memo, int(r.at), text(r.fp), text(r.query), text(r.keyword))
                made.append((r.url, r.ts, keyword, source))
            if made:
                yield pd.DataFrame(made, columns=["url", "ts", "keyword", "source"])

    dealt = _order(sightings).repartition("url").sortWithinPartitions("url", "at", F.asc_nulls_first("fp"), F.asc_nulls_first("query"), F.asc_nulls_first("keyword"))
    return dealt.mapInPandas(run, CHOSEN)


class _Remember(StatefulProcessor):
    """A page's memo as value state, and a timer that frees it when it is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.memo = handle, handle.getValueState("memo", "keyword string, fp string, at long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        held = self.memo.get() if self.memo.exists() else None
        memo, timer = (None, None) if held is None else ((held[0], held[1], held[2]), held[3])
        blank = lambda x: (x is not None, x or "")
        for r in sorted(rows, key=lambda r: (r.at, blank(r.fp), blank(r.query), blank(r.keyword))):
            memo, keyword, source = seen(memo, r.at, r.fp, r.query, r.keyword)
            yield Row(url=key[0], ts=r.ts, keyword=keyword, source=source)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if memo is None:
            self.memo.clear()
        else:
            timer = (memo[2] + _KEEP) // 1000 + 1
            self.handle.registerTimer(timer)
            self.memo.update((*memo, timer))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        self.memo.clear()
        return iter(())

    def close(self) -> None:
        pass


def chosen_stream(sightings: DataFrame, late: str = "1 day") -> DataFrame:
    """CHOSEN of a stream of SIGHTINGS that come in order of time, but for ``late``: within a batch they are put in order.

    State that forgets by the clock would make results depend on when a stream runs, so timers of event time free it. Needs
    the RocksDB state store. A page's sightings in one batch are one task's work.
    """
    marked = sightings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return _order(marked).groupBy("url").transformWithState(_Remember(), outputStructType=CHOSEN, outputMode="append", timeMode="eventtime")
