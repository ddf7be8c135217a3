"""Sitemap discovery: each host's pages are written to sitemaps by Spark, an index and files of some pages, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.functions import url as U
from sitelumen.operators.store import settle
from sitelumen.plans import site
from sitelumen.sources import sitemap as X

#: Pages of a host are dealt by id to files of so many ids, those with even and odd ids apart; every tenth page is in both.
CHUNK = 10_000


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, body): robots files, indexes that name themselves and a missing file too, and sitemaps."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", U.host(F.col("url")).alias("host"))
    own = F.concat("host", F.lit("/s-"), F.expr(f"page_id div {CHUNK}"), F.lit("-"))
    each = rows.select("host", "page_id", "url", F.explode(F.when(F.col("page_id") % 10 == 0, F.array(F.concat(own, F.lit("0.xml")), F.concat(own, F.lit("1.xml")))).otherwise(F.array(F.concat(own, F.col("page_id") % 2, F.lit(".xml"))))).alias("file"))
    day = F.when(F.col("page_id") % 7 == 0, "soon").when(F.col("page_id") % 3 == 0, F.concat(F.lit("20"), F.lpad(F.col("page_id") % 40, 2, "0"), F.lit("-01-02")))
    line = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["x"]), "\n")  # noqa: E731 - of a file's lines, which CHUNK bounds
    sets = each.groupBy("host", "file").agg(F.concat(F.lit("<urlset>"), joined(F.struct("page_id", line.alias("x"))), F.lit("</urlset>")).alias("body"))
    name = F.concat(F.lit("<sitemap><loc>https://"), "file", F.lit("</loc></sitemap>"))
    first = F.concat(F.lit("<sitemapindex><sitemap><loc>https://"), "host", F.lit("/i.xml</loc></sitemap><sitemap><loc>https://"), "host", F.lit("/gone.xml</loc></sitemap>"))
    index = sets.groupBy("host").agg(joined(F.struct("file", name.alias("x"))).alias("names")).select("host", F.concat(first, "names", F.lit("</sitemapindex>")).alias("body"))
    robots = index.select(F.concat(F.lit("https://"), "host", F.lit("/robots.txt")).alias("url"), F.concat(F.lit("User-agent: *\nSitemap: https://"), "host", F.lit("/i.xml")).alias("body"))
    files = robots.unionByName(index.select(F.concat(F.lit("https://"), "host", F.lit("/i.xml")).alias("url"), "body")).unionByName(sets.select(F.concat(F.lit("https://"), "file").alias("url"), "body"))
    return settle(files.select("url", F.lit(200).alias("status"), "body"))


def _surveyed(spark: SparkSession, sf_dir: str) -> tuple[X.Survey, DataFrame, DataFrame]:
    files = _files(spark, sf_dir)
    robots = files.where("url LIKE '%/robots.txt'")
    first = X.roots(robots, robots.select(U.host(F.col("url")).alias("domain")))
    return X.survey(first, files, most_files=None, most_urls=None), files, first


def discovered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, key, url, sitemaps, lastmod) of every listed page."""
    return _surveyed(spark, sf_dir)[0].urls.withColumn("sitemaps", F.array_join("sitemaps", " "))


def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sitemap showed: kind, entries and dates, and whether it was declared, nested or missing."""
    found, files, first = _surveyed(spark, sf_dir)
    return X.report(found, files, first, "2025-01-01").drop("bytes").fillna({"status": 0})


_LISTED = f"""{site._URLS}, v AS (SELECT page_id, url, host, {site._KEY} AS key, CASE WHEN page_id % 7 = 0 THEN 'soon' WHEN page_id % 3 = 0 THEN concat('20', lpad(CAST(page_id % 40 AS VARCHAR), 2, '0'), '-01-02') END AS lastmod FROM u),
e AS (SELECT *, concat('https://', host, '/s-', page_id // {CHUNK}, '-', unnest(CASE WHEN page_id % 10 = 0 THEN [0, 1] ELSE [page_id % 2] END), '.xml') AS file FROM v)"""
DISCOVERED_URLS = f"WITH {_LISTED} SELECT host AS domain, key, min_by(url, row(file, page_id)) AS url, string_agg(DISTINCT file, ' ' ORDER BY file) AS sitemaps, min_by(coalesce(lastmod, '-'), row(file, page_id)) AS lastmod FROM e GROUP BY host, key".replace("min_by(coalesce(lastmod, '-'), row(file, page_id)) AS lastmod", "nullif(min_by(coalesce(lastmod, '-'), row(file, page_id)), '-') AS lastmod")
DISCOVERED_FILES = f"""WITH {_LISTED}, h AS (SELECT DISTINCT host FROM v), f AS (SELECT host, file, count(*) AS n, count(lastmod) AS dated, count(*) FILTER (lastmod = 'soon') AS bad, count(*) FILTER (lastmod <> 'soon' AND lastmod > '2025-01-01') AS future FROM e GROUP BY host, file)
SELECT host AS domain, file AS sitemap, 200 AS status, false AS declared, true AS nested, false AS redirected, 'urlset' AS kind, CAST(n AS INTEGER) AS url_count, CAST(dated AS INTEGER) AS lastmod_count, CAST(bad AS INTEGER) AS lastmod_invalid, CAST(future AS INTEGER) AS lastmod_future FROM f
UNION ALL SELECT host, concat('https://', host, '/i.xml'), 200, true, true, false, 'index', 0, 0, 0, 0 FROM h UNION ALL SELECT host, concat('https://', host, '/gone.xml'), 0, false, true, false, 'error', 0, 0, 0, 0 FROM h
UNION ALL SELECT host, concat('https://', host, '/sitemap.xml'), 0, false, false, false, 'error', 0, 0, 0, 0 FROM h"""

_ALL = (discovered_urls, discovered_files)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
