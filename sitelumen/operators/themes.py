"""What others write about and a site doesn't: themes that share too few words with each of its own headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitelumen.functions import text as T

#: Fixed value: words that a heading shares with a theme that it covers.
SHARED = 2


def _pairs(text: str, kept: list[Column]) -> list[Column]:
    """``kept`` and a row for each two different tokens of ``text``, smaller first, as ``pair``."""
    return [*kept, F.explode(F.expr(f"flatten(transform({text}, (a, i) -> transform(slice({text}, i + 2, size({text})), b -> struct(least(a, b) AS a, greatest(a, b) AS b))))")).alias("pair")]


def uncovered(themes: DataFrame, headings: DataFrame, site: str = "site", theme: str = "theme", heading: str = "heading") -> DataFrame:
    """The rows of ``themes`` (site, theme, more) for which no row of ``headings`` (site, heading) of the same site shares SHARED tokens.

    Two texts share two tokens if they share a pair of tokens. So headings become an index of each site's different pairs,
    and a theme is covered if one of its own pairs is there: no theme meets a heading. However many headings have a pair, it
    stands in the index once, so a common pair joins its themes and no more. Themes without tokens say nothing and are left
    out; those with one token can't be covered. Repeated rows stay; a null site has headings of its own.
    """
    name = F.coalesce(F.col(site).cast("string"), F.lit("\0"))
    told = themes.where(F.size(T.loose_tokens(F.coalesce(F.col(theme), F.lit("")))) > 0)
    index = headings.select(name.alias("_s"), F.array_sort(T.loose_tokens(F.coalesce(F.col(heading), F.lit("")))).alias("_t"))
    index = index.where(F.size("_t") >= SHARED).distinct().select(*_pairs("_t", [F.col("_s")])).distinct()
    asked = told.select(name.alias("_s"), F.col(theme).alias("_theme")).distinct().withColumn("_t", F.array_sort(T.loose_tokens(F.col("_theme"))))
    covered = asked.where(F.size("_t") >= SHARED).select(*_pairs("_t", [F.col("_s"), F.col("_theme")])).join(index, ["_s", "pair"], "left_semi").select("_s", "_theme").distinct()
    return told.join(covered, (name == F.col("_s")) & (F.col(theme) == F.col("_theme")), "left_anti")


def suggestions(rows: DataFrame, site: str = "site", theme: str = "theme", pages: str = "pages", most: int = 5) -> DataFrame:
    """(site, theme, pages, place): of each site's uncovered themes the ``most`` that most pages have, ties by text."""
    counted = rows.groupBy(site, theme).agg(F.sum(pages).alias(pages))
    place = F.row_number().over(W.Window.partitionBy(site).orderBy(F.desc(pages), theme))
    return counted.withColumn("place", place).where(F.col("place") <= most)
