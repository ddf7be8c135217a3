"""Small rules of reports, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelumen.functions import text as T

#: Openings that a keyword loses; shares of tokens that ground a keyword, and that make two phrases one.
OPENINGS = ("how to ", "what is ", "what are ", "why ", "when ", "guide to ", "prepare for ", "preparing for ", "prepare ", "crack ", "check ", "download ")
GROUNDED, OVERLAP, DRAFT_READY, DRAFT_WORK = 0.75, 0.8, 80, 60
#: Fixed value: marks of a page that says that there is none.
ERROR_PAGE = r"(?i)\b(404|not found|page not found|doesn[’']?t exist|no longer available)\b"


def clean_keyword(keyword: Column) -> Column:
    """A keyword in lower case without its openings, each taken while more than two characters stay."""
    opening = rf"^(?:(?:{'|'.join(OPENINGS)})(?=.{{3}}))+"
    return F.regexp_replace(T.squeezed(F.lower(keyword)), opening, "")


def grounded(keyword: Column, source: Column) -> Column:
    """Are most of the keyword's tokens in what the page says of itself? Not if it has none."""
    found = T.tokens(keyword, keep_years=True)
    present, _ = T.coverage(found, source)
    return (F.size(found) > 0) & (F.size(present) >= F.ceil(F.size(found) * GROUNDED))


def overlaps(a: Column, b: Column) -> Column:
    """Are a's tokens all, or OVERLAP of them, among b's? Not if either has none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) >= OVERLAP * F.size(a))


def fits(phrase: Column, least: int, most: int) -> Column:
    """A phrase without outer quotes, marks and doubled spaces, null unless its length lies within the bounds."""
    bare = F.regexp_replace(T.squeezed(phrase), r'^["?. ]+|["?. ]+$', "")
    return F.when(F.length(bare).between(least, most), bare)


def retry_after(value: Column) -> Column:
    """Seconds to wait, from 0 to 10; what is no number is 0."""
    return F.coalesce(F.least(F.lit(10.0), F.greatest(F.lit(0.0), value.try_cast("double"))), F.lit(0.0))


def tone(score: Column, good: int = 85, fair: int = 60) -> Column:
    return F.when(score >= good, "good").when(score >= fair, "fair").otherwise("poor")


def bar(value: Column, poor: Column) -> Column:
    """How much of a bar a value fills, whose end is at 1.35 of the poor end; 100 at most."""
    return F.least(F.lit(100.0), 100 * value / (1.35 * poor))


def change(now: Column, before: Column) -> Column:
    """Percent of change, halves up; null from nothing."""
    return F.when(before != 0, F.floor(100 * (now - before) / before + 0.5))


def fenced_json(reply: Column, schema: str) -> Column:
    """The object in a reply, with or without a code fence about it; null if it can't be read."""
    bare = F.regexp_replace(F.trim(reply), r"^```[a-z]*\s*|\s*```$", "")
    return F.from_json(bare, schema)


def without_scheme(url: Column) -> Column:
    """A URL's part behind its host, ``/`` if there is none."""
    return F.coalesce(F.nullif(F.regexp_replace(url, r"^https?://[^/]+", ""), F.lit("")), F.lit("/"))


def first_url(prose: Column) -> Column:
    """The first URL in a text, without the marks behind it; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(prose, r"(https?://[^\s)\]]+)", 1), r"[.,;:!?]+$", ""), F.lit(""))


def downgrades(hops: Column, last: Column) -> Column:
    """Does a chain of redirects that began on https pass through http?"""
    return F.get(hops, F.lit(0)).startswith("https://") & F.exists(F.concat(F.slice(hops, F.lit(2), F.greatest(F.lit(1), F.size(hops))), F.array(last)), lambda u: u.startswith("http://"))
