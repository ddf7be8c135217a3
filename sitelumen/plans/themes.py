"""Themes that a page doesn't cover: how the paragraphs of another page begin, against its own headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.operators import themes as H

_PARA = r"<p>(?:<b>)?([^<.]{1,200})[.<]"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(site, theme, pages) of how paragraphs of the next page begin, which stands for the one that is found first; (site, heading) of each page's own headings."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    headings = rows.select(F.col("page_id").alias("site"), F.explode(F.regexp_extract_all("html", F.lit(r"<h1>([^<]*)</h1>"), F.lit(1))).alias("heading"))
    first = F.array_join(F.slice(F.split(F.lower("para"), " "), 1, 8), " ")
    theirs = rows.select((F.col("page_id") - 1).alias("site"), F.explode(F.regexp_extract_all("html", F.lit(_PARA), F.lit(1))).alias("para"))
    return theirs.groupBy("site", first.alias("theme")).agg(F.count(F.lit(1)).alias("pages")), headings


def uncovered_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.uncovered(*_tables(spark, sf_dir))


def theme_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.suggestions(H.uncovered(*_tables(spark, sf_dir)))


def _tokens(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in H.T.LOOSE_STOP)})))"


_UNCOVERED = f"""
h AS (SELECT page_id AS site, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS heading FROM pages), hs AS (SELECT site, list({_tokens('heading')}) AS headings FROM h GROUP BY site),
a AS (SELECT site, array_to_string(string_split(lower(para), ' ')[1:8], ' ') AS theme, count(*) AS pages FROM (SELECT page_id - 1 AS site, unnest(regexp_extract_all(html, '{_PARA}', 1)) AS para FROM pages) GROUP BY ALL),
k AS (SELECT *, {_tokens('theme')} AS tokens FROM a),
o AS (SELECT k.site, theme, pages FROM k LEFT JOIN hs ON hs.site = k.site WHERE len(tokens) > 0 AND len(list_filter(coalesce(headings, []), lambda x: len(list_intersect(x, tokens)) >= 2)) = 0)
"""
UNCOVERED_THEMES = f"WITH {_UNCOVERED} SELECT * FROM o"
THEME_SUGGESTIONS = f"WITH {_UNCOVERED} SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY pages DESC, theme) AS INTEGER) AS place FROM o QUALIFY place <= 5"

_ALL = (uncovered_themes, theme_suggestions)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
