"""Keyword density: mentions of a text's keyword by windows of words, and where else the page says it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelumen.functions import text as T
from sitelumen.operators import mentions as M

# Words for each mention, the shortest last window, and when a text is stuffed; where a keyword may stand.
WINDOW_WORDS, LEAST_TAIL, STUFFED_DENSITY, STUFFED_WINDOW, EDGE_WORDS = 150, 75, 3.0, 6, 100
PLACES = ("title", "h1", "url", "meta_description", "first_100_words", "a_subheading", "image_alt", "last_100_words")


def analysed(posts: DataFrame, text: str = "text", focus: str = "focus") -> DataFrame:
    """``posts`` (title, h1, url, meta_description, subheadings and alts (arrays), ``text``, ``focus``: stems) with ``density``.

    The struct holds words, mentions, exact, required, shortfall, words_per_mention, percent, windows, covered, gaps
    (numbers of windows without a mention, from 1), max_in_window, stuffed, verdict, and ``lacking``: those of PLACES
    without the keyword. A text without words has no window and fails. Nulls count as empty.
    """
    rows = M.mentions(posts, focus, text, WINDOW_WORDS, LEAST_TAIL, EDGE_WORDS)  # whose words are those of T.words
    n = F.coalesce("mention.words", F.lit(0))
    k = F.coalesce(focus, F.array().cast("array<string>"))
    has = lambda x: (F.size(k) > 0) & (F.size(T.coverage(k, x)[1]) == 0)
    some = lambda xs: F.exists(F.coalesce(xs, F.array().cast("array<string>")), has)
    stands = {
        "title": has(F.col("title")), "h1": has(F.col("h1")), "url": has(F.translate("url", "/", " ")), "meta_description": has(F.col("meta_description")), "first_100_words": has(F.col("mention.front")),
        "a_subheading": some(F.col("subheadings")), "image_alt": some(F.col("alts")), "last_100_words": has(F.col("mention.back")),
    }
    total, windows = F.size("mention.exact") + F.size("mention.variant"), F.size("mention.counts")
    required = F.ceil(n / WINDOW_WORDS).cast("int")
    covered = F.size(F.filter("mention.counts", lambda c: c > 0))
    most = F.coalesce(F.array_max("mention.counts"), F.lit(0))
    percent = F.when(n > 0, F.round(100 * total / n, 2)).otherwise(0.0)
    verdict = F.when((n > 0) & (covered == windows), "pass").when((n > 0) & (total >= required), "pass-on-average").otherwise("fail")
    gaps = F.filter(F.transform("mention.counts", lambda c, i: F.when(c == 0, i + 1)), lambda i: i.isNotNull())
    lacking = F.filter(F.array(*(F.when(~F.coalesce(stands[p], F.lit(False)), p) for p in PLACES)), lambda p: p.isNotNull())
    density = F.struct(
        n.alias("words"), total.alias("mentions"), F.size("mention.exact").alias("exact"), required.alias("required"), F.greatest(F.lit(0), required - total).alias("shortfall"),
        F.when(total > 0, F.bround(n / total).cast("int")).alias("words_per_mention"), percent.alias("percent"), windows.alias("windows"), covered.alias("covered"), gaps.alias("gaps"),
        most.alias("max_in_window"), ((percent > STUFFED_DENSITY) | (most >= STUFFED_WINDOW)).alias("stuffed"), verdict.alias("verdict"), lacking.alias("lacking"),
    )
    return rows.withColumn("density", F.explode(F.array(density))).drop("mention")  # a generated row is worked out once, whatever reads it


BUCKETS = {"upto 150": (1, 150), "upto 300": (151, 300), "upto 600": (301, 600), "beyond 600": (601, 1 << 30)}


def summary(posts: DataFrame) -> DataFrame:
    """One row of ``analysed`` posts: verdicts, medians, missing mentions, posts by words per mention, and by place that lacks."""
    d = lambda name: F.col(f"density.{name}")
    wpm = d("words_per_mention")
    share = F.when(d("windows") > 0, F.bround(100 * d("covered") / d("windows"))).otherwise(0)
    return posts.agg(
        F.count(F.lit(1)).alias("posts"), *(F.count_if(d("verdict") == v).alias(v.replace("-", "_")) for v in ("pass", "pass-on-average", "fail")), F.count_if(d("stuffed")).alias("stuffed"),
        F.median(wpm).alias("median_words_per_mention"), F.median(share).alias("median_coverage"), F.coalesce(F.sum(d("shortfall")), F.lit(0)).alias("missing_mentions"),
        *(F.count_if(F.coalesce(wpm.between(a, b), F.lit(False))).alias(name.replace(" ", "_")) for name, (a, b) in BUCKETS.items()), F.count_if(wpm.isNull()).alias("never"),
        *(F.count_if(F.array_contains(d("lacking"), p)).alias(f"no_{p}") for p in PLACES),
    )
