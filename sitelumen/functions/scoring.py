"""Search and audit scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Click-through rate by rounded position, and beyond.
CTR = {1: 0.28, 2: 0.15, 3: 0.11, 4: 0.08, 5: 0.069, 6: 0.052, 7: 0.041, 8: 0.032, 9: 0.027, 10: 0.023}
CTR_BEYOND = 0.015
#: Upper ends of good and of fair, by measure.
RATINGS = {"lcp_ms": (2500, 4000), "cls": (0.1, 0.25), "tbt_ms": (200, 600), "ttfb_ms": (800, 1800)}
#: The Core Web Vitals, p75 good and fair; CLS a hundredfold. The first three decide.
VITALS = {
    "largest_contentful_paint": (2500, 4000),
    "interaction_to_next_paint": (200, 500),
    "cumulative_layout_shift": (10, 25),
    "first_contentful_paint": (1800, 3000),
    "experimental_time_to_first_byte": (800, 1800),
}
CORE_VITALS = tuple(VITALS)[:3]
#: Weights of findings.
LANDING_WEIGHT = {"high": 10, "medium": 4, "low": 1, "info": 0}
URL_WEIGHT = {"high": 40, "medium": 18, "low": 5, "info": 0}
FLAT_WEIGHT = {"high": 12, "medium": 5, "low": 2, "info": 0}
AUDIT_WEIGHT = {"high": 12, "medium": 6, "low": 2}


def lookup(key: Column, table: dict, beyond: float | None = None) -> Column:
    """``table`` at ``key``; ``beyond`` elsewhere."""
    out = F.lit(beyond)
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def ctr_at(position: Column) -> Column:
    """The usual click-through rate at a position, rounded half to even, 1 at least."""
    return lookup(F.bround(F.greatest(position, F.lit(1.0))).cast("int"), CTR, CTR_BEYOND)


def rating(value: Column, measure: str) -> Column:
    """good, needs-improvement or poor; null for null."""
    good, fair = RATINGS[measure]
    return F.when(value <= good, "good").when(value <= fair, "needs-improvement").when(value.isNotNull(), "poor")


def band(position: Column) -> Column:
    """The band of a search position."""
    return F.when(position.isNull() | (position <= 0), "unranked").when(position <= 3, "top3").when(position <= 10, "page1").when(position <= 20, "page2").otherwise("beyond")


def opportunity(impressions: Column, clicks: Column, position: Column) -> Column:
    """Clicks to be won by reaching the next target position; 0 where none is in reach."""
    target = F.when(position <= 10, 3.0).otherwise(8.0)
    gain = (ctr_at(target) - ctr_at(position)) * impressions
    left = gain - F.greatest(F.lit(0.0), clicks - impressions * ctr_at(position))
    none = impressions.isNull() | (impressions <= 0) | position.isNull() | (position <= 0) | (position > 30) | (position <= target)
    return F.when(none, 0).otherwise(F.greatest(F.lit(0), F.bround(left).cast("long"))).cast("long")


def trend(now: Column, before: Column) -> Column:
    """new, rising, falling or flat; flat where there is nothing now."""
    return F.when(F.coalesce(now, F.lit(0)) == 0, "flat").when(F.coalesce(before, F.lit(0)) == 0, "new").when(now >= 1.2 * before, "rising").when(now <= 0.8 * before, "falling").otherwise("flat")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def landing_score(penalty: Column, passed: Column, failed: Column) -> Column:
    """100 less the penalty as a share of what three points a check would be; 0 at least."""
    return F.greatest(F.lit(0), F.bround(100 - penalty * 100.0 / F.greatest(F.lit(1), 3 * (passed + failed))).cast("int"))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at rank round(share * (n - 1)), half to even, of an array's sorted values."""
    return F.element_at(F.array_sort(values), F.bround(F.lit(share) * (F.size(values) - 1)).cast("int") + 1)
