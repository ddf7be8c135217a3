"""Analyses of a crawl: URLs, links, headings, findings, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitelumen.functions import scoring as S
from sitelumen.functions import text as T
from sitelumen.functions import url as U
from sitelumen.operators import dissect as D
from sitelumen.operators import mentions as M

HREF = r'<a href="([^"#][^"]*)"'


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


_BARE = "regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '')"
_HOST = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({_BARE}, '^([^/?]*)', 1)), '^.*@', ''), ':[0-9]+$', ''), '^www\\.', '')"
_PATH = f"coalesce(nullif(regexp_extract({_BARE}, '^[^/?]*(/[^?]*)', 1), ''), '/')"
_QUERY = f"regexp_extract({_BARE}, '\\?(.*)$', 1)"
_URLS = f"u AS (SELECT page_id, url, html, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages)"
_KEY = "host || coalesce(nullif(CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END, ''), '/') || CASE WHEN query <> '' THEN '?' || query ELSE '' END"


def norm_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.norm_url(F.col("url")).alias("key"), U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))


NORM_URL = f"WITH {_URLS} SELECT page_id, {_KEY} AS key, host, path FROM u"


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by type and subtype; the path's first part stands for the sitemap that lists a page."""
    kind = U.page_type(F.col("url"), F.array(U.section(F.col("url"))))
    return pages(spark, sf_dir).select(kind.alias("k")).groupBy("k.type", "k.subtype").agg(F.count(F.lit(1)).alias("pages"))


_UTILITY = U.UTILITY.replace("'", "''")
PAGE_TYPES = f"""
WITH {_URLS}, p AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM u), q AS (SELECT path, s, len(s) AS n, lower(coalesce(s[1], '')) AS first, lower(coalesce(s[-1], '')) AS last, lower(regexp_extract(path, '^/([^/]+)', 1)) AS listed FROM p),
t AS (SELECT CASE WHEN path = '/' THEN 'home/home' WHEN first = 'blog' THEN CASE WHEN NOT (contains(listed, 'category') OR contains(listed, 'tag') OR n = 1) AND (contains(listed, 'post') OR n >= 3 OR (n = 2 AND NOT contains(listed, 'category'))) THEN 'blog_post/article' ELSE 'blog_category/archive' END
  WHEN regexp_matches(path, '{_UTILITY}') THEN 'utility/utility' WHEN regexp_matches(lower(path), 'topper|result') THEN 'landing/proof' WHEN regexp_matches(lower(path), 'resource|resourse|download') THEN 'landing/resource' WHEN regexp_matches(listed, 'center|centre') THEN 'landing/centre'
  WHEN n >= 2 AND regexp_matches(last, 'coaching|classes|course') THEN 'landing/location' WHEN regexp_matches(last, 'coaching|course|classes|test-series') THEN 'landing/service' ELSE 'landing/page' END AS k FROM q)
SELECT split_part(k, '/', 1) AS type, split_part(k, '/', 2) AS subtype, count(*) AS pages FROM t GROUP BY k
"""


def url_lints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", *(v.alias(k) for k, v in U.lints(F.col("url")).items()))


URL_LINTS = f"WITH {_URLS} SELECT page_id, query <> '' AS has_query, regexp_matches(path, '[A-Z]') AS has_uppercase, contains(path, '_') AS has_underscore, starts_with(lower(trim(url)), 'http://') AS is_http, length(url) > {U.LONG_URL} AS is_long, regexp_full_match(host, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') AS is_raw_ip FROM u"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each page's different links, relative ones on its own host."""
    found = F.explode_outer(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href")
    rows = pages(spark, sf_dir).select(U.host(F.col("url")).alias("host"), U.norm_url(F.col("url")).alias("src"), found).where("href IS NOT NULL")
    full = F.when(F.col("href").startswith("/"), F.concat("host", "href")).otherwise(F.col("href"))
    return rows.select("src", U.norm_url(full).alias("dst")).distinct()


_LINKS = f"""{_URLS}, l AS (SELECT host, {_KEY} AS src, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM u),
m AS (SELECT src, CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS url FROM l),
n AS (SELECT src, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM m), e AS (SELECT DISTINCT src, {_KEY} AS dst FROM n)"""


def inlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages link to each target, itself not counted."""
    return links(spark, sf_dir).where("src <> dst").groupBy("dst").agg(F.count(F.lit(1)).alias("inlinks"))


INLINKS = f"WITH {_LINKS} SELECT dst, count(*) AS inlinks FROM e WHERE src <> dst GROUP BY dst"


def unlisted_links(spark: SparkSession, sf_dir: str, most: int = 150) -> DataFrame:
    """The linked targets that are no crawled page, the most linked ones first."""
    known = pages(spark, sf_dir).select(U.norm_url(F.col("url")).alias("dst"))
    skipped = r"(?i)\.(?:jpg|jpeg|png|gif|svg|webp|pdf|zip|css|js|xml|ico)$|\?|/wp-|/cdn-cgi/"
    rest = links(spark, sf_dir).where(~F.col("dst").rlike(skipped)).join(known, "dst", "left_anti")
    return rest.groupBy("dst").agg(F.count(F.lit(1)).alias("links")).orderBy(F.desc("links"), "dst").limit(most)


UNLISTED_LINKS = f"WITH {_LINKS} SELECT dst, count(*) AS links FROM e WHERE NOT regexp_matches(dst, '(?i)\\.(?:jpg|jpeg|png|gif|svg|webp|pdf|zip|css|js|xml|ico)$|\\?|/wp-|/cdn-cgi/') AND dst NOT IN (SELECT {_KEY} FROM u) GROUP BY dst ORDER BY links DESC, dst LIMIT 150"


def dup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of pages of one title, compared lower-case and trimmed."""
    title = F.lower(F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)))
    return pages(spark, sf_dir).select(title.alias("title"), "page_id").where("title <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


DUP_TITLES = "SELECT lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS title, count(*) AS pages, min(page_id) AS first_page FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' GROUP BY 1 HAVING count(*) > 1"


def first_n_per_section(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    """The first pages of each section, by URL."""
    rows = pages(spark, sf_dir).select(U.section(F.col("url")).alias("section"), "url")
    return rows.withColumn("place", F.row_number().over(W.Window.partitionBy("section").orderBy("url"))).where(F.col("place") <= n)


FIRST_N_PER_SECTION = f"WITH {_URLS} SELECT regexp_extract(path, '^/([^/]+)', 1) AS section, url, CAST(row_number() OVER (PARTITION BY regexp_extract(path, '^/([^/]+)', 1) ORDER BY url) AS INTEGER) AS place FROM u QUALIFY place <= 6"


def slug_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring words of titles, by the number of pages."""
    title = F.regexp_replace(F.lower(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)), "[^a-z0-9]+", "-")
    each = pages(spark, sf_dir).select("page_id", title.alias("slug")).select("page_id", F.explode_outer(T.slug_bigrams(F.col("slug"))).alias("bigram")).where("bigram IS NOT NULL")
    return each.groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


SLUG_BIGRAMS = "WITH w AS (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', '-', 'g'), '-'), lambda x: length(x) > 2) AS w FROM pages), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w) SELECT bigram, count(*) AS n FROM b GROUP BY bigram HAVING count(*) > 1"

#: The findings that a page's markup and URL show: severity, and when it fails.
def _checks() -> dict[str, tuple[str, F.Column]]:
    title, h1 = F.col("title"), F.col("h1")
    return {
        "title-missing": ("high", title == ""),
        "title-long": ("medium", F.length(title) > 60),
        "title-short": ("low", (title != "") & (F.length(title) < 30)),
        "title-duplicate": ("high", F.col("same_title") > 1),
        "h1-missing": ("high", h1 == ""),
        "thin-content": ("high", F.col("words") < 150),
        "is-http": ("high", F.col("url").startswith("http://")),
        "url-params": ("medium", F.col("url").contains("?")),
        "canonical-missing": ("medium", ~F.col("has_canonical")),
        "viewport": ("high", ~F.col("has_viewport")),
        "lang": ("low", ~F.col("has_lang")),
    }


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, subtype, check, severity, failed): every check of every page."""
    words = F.size(F.filter(F.split(F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " "), "<[^>]*>", " "), r"\s+"), lambda x: x != ""))
    rows = pages(spark, sf_dir).select("page_id", "url", "html", F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"), F.trim(F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)).alias("h1"), words.alias("words"), U.section(F.col("url")).alias("subtype"))
    # What the checks read is worked out here; no page's text goes further. Titles are counted apart, those without one once for all.
    seen = {"has_canonical": F.col("html").contains('rel="canonical"'), "has_viewport": F.col("html").contains('name="viewport"'), "has_lang": F.col("html").rlike("<html[^>]* lang=")}
    rows = rows.withColumns({**seen, "key": F.lower("title")}).drop("html")
    titles = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared, bare = titles.where("key <> ''"), F.broadcast(rows.agg(F.count_if(F.col("key") == "").alias("bare")))  # one row
    rows = rows.join(shared, "key", "left").join(bare).withColumn("same_title", F.when(F.col("key") == "", F.col("bare")).otherwise(F.coalesce("n", F.lit(1))))
    checks = F.array(*(F.struct(F.lit(k).alias("check"), F.lit(v).alias("severity"), f.alias("failed")) for k, (v, f) in _checks().items()))
    return rows.select("page_id", "subtype", F.explode(checks).alias("c")).select("page_id", "subtype", "c.*")


_FINDINGS = """
f AS (SELECT page_id, url, html, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS h1, regexp_extract(regexp_replace(url, '^[A-Za-z]+://', ''), '^[^/?#]*/([^/?#]+)', 1) AS subtype,
  len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS words FROM pages),
g AS (SELECT *, count(*) OVER (PARTITION BY lower(title)) AS same FROM f),
k AS (
  SELECT page_id, subtype, 'title-missing' AS "check", 'high' AS severity, title = '' AS failed FROM g UNION ALL
  SELECT page_id, subtype, 'title-long', 'medium', length(title) > 60 FROM g UNION ALL
  SELECT page_id, subtype, 'title-short', 'low', title <> '' AND length(title) < 30 FROM g UNION ALL
  SELECT page_id, subtype, 'title-duplicate', 'high', same > 1 FROM g UNION ALL
  SELECT page_id, subtype, 'h1-missing', 'high', h1 = '' FROM g UNION ALL
  SELECT page_id, subtype, 'thin-content', 'high', words < 150 FROM g UNION ALL
  SELECT page_id, subtype, 'is-http', 'high', starts_with(url, 'http://') FROM g UNION ALL
  SELECT page_id, subtype, 'url-params', 'medium', contains(url, '?') FROM g UNION ALL
  SELECT page_id, subtype, 'canonical-missing', 'medium', NOT contains(html, 'rel="canonical"') FROM g UNION ALL
  SELECT page_id, subtype, 'viewport', 'high', NOT contains(html, 'name="viewport"') FROM g UNION ALL
  SELECT page_id, subtype, 'lang', 'low', NOT regexp_matches(html, '<html[^>]* lang=') FROM g)
"""


def issue_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each check's failing pages and their share; ``template`` if so many fail that the template does."""
    rows = findings(spark, sf_dir).groupBy("check", "severity").agg(F.sum(F.col("failed").cast("long")).alias("pages"), F.count(F.lit(1)).alias("all"))
    return rows.where("pages > 0").select("check", "severity", "pages", F.round(F.col("pages") / F.col("all"), 3).alias("share"), ((F.col("pages") >= 8) & (F.col("pages") >= 0.8 * F.col("all"))).alias("template"))


ISSUE_MATRIX = f'WITH {_FINDINGS} SELECT "check", severity, CAST(count(*) FILTER (failed) AS BIGINT) AS pages, round(count(*) FILTER (failed) / count(*), 3) AS share, count(*) FILTER (failed) >= 8 AND count(*) FILTER (failed) >= 0.8 * count(*) AS template FROM k GROUP BY ALL HAVING count(*) FILTER (failed) > 0'


def landing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's score and grade by its findings."""
    weight = S.lookup(F.col("severity"), S.LANDING_WEIGHT, 0.0)
    each = findings(spark, sf_dir).groupBy("page_id", "subtype").agg(F.sum(F.when(F.col("failed"), weight).otherwise(0.0)).alias("penalty"), F.sum((~F.col("failed")).cast("int")).alias("passed"), F.sum(F.col("failed").cast("int")).alias("failed"))
    return each.withColumn("score", S.landing_score(F.col("penalty"), F.col("passed"), F.col("failed"))).select("page_id", "subtype", "failed", "score", S.grade(F.col("score")).alias("grade"))


_SCORES = "s AS (SELECT page_id, subtype, count(*) FILTER (failed) AS failed, CAST(greatest(0, round_even(100 - sum(CASE WHEN failed THEN CASE severity WHEN 'high' THEN 10 WHEN 'medium' THEN 4 WHEN 'low' THEN 1 ELSE 0 END ELSE 0 END) * 100.0::DOUBLE / greatest(1, 3 * count(*)), 0)) AS INTEGER) AS score FROM k GROUP BY page_id, subtype)"
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"
LANDING_SCORES = f"WITH {_FINDINGS}, {_SCORES} SELECT page_id, subtype, failed, score, {_GRADE} AS grade FROM s"


def subtype_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and mean score of each subtype."""
    return landing_scores(spark, sf_dir).groupBy("subtype").agg(F.count(F.lit(1)).alias("pages"), F.bround(F.avg("score")).cast("int").alias("score"), F.sum("failed").alias("failed"))


SUBTYPE_ROLLUP = f"WITH {_FINDINGS}, {_SCORES} SELECT subtype, count(*) AS pages, CAST(round_even(avg(score), 0) AS INTEGER) AS score, CAST(sum(failed) AS BIGINT) AS failed FROM s GROUP BY subtype"


def speed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("page"), F.col("l_returnflag").alias("type"), F.col("l_extendedprice").cast("int").alias("lcp_ms"), (F.col("l_discount") * 3).alias("cls"))


def speed_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of each page type, by ranks and counts: no array of a group's values is built."""
    rows = speed_rows(spark, sf_dir).groupBy("type", "lcp_ms").agg(F.count(F.lit(1)).alias("n"))
    upto = W.Window.partitionBy("type").orderBy("lcp_ms")
    run = rows.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(W.Window.partitionBy("type"))})
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(p * (F.col("all") - 1)), F.col("lcp_ms")))
    return run.groupBy("type").agg(F.max("all").alias("rows"), *(at(p).alias(name) for name, p in (("p50", 0.5), ("p75", 0.75), ("p95", 0.95))))


SPEED_PERCENTILES = "WITH r AS (SELECT l_returnflag AS type, CAST(trunc(l_extendedprice) AS INTEGER) AS v FROM lineitem), s AS (SELECT type, list_sort(list(v)) AS v, count(*) AS n FROM r GROUP BY type) SELECT type, n AS rows, v[CAST(round_even(0.5::DOUBLE * (n - 1), 0) AS INTEGER) + 1] AS p50, v[CAST(round_even(0.75::DOUBLE * (n - 1), 0) AS INTEGER) + 1] AS p75, v[CAST(round_even(0.95::DOUBLE * (n - 1), 0) AS INTEGER) + 1] AS p95 FROM s"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements by type and rating."""
    return speed_rows(spark, sf_dir).groupBy("type", S.rating(F.col("lcp_ms"), "lcp_ms").alias("lcp"), S.rating(F.round("cls", 4), "cls").alias("cls")).agg(F.count(F.lit(1)).alias("rows"))


RATINGS = "SELECT l_returnflag AS type, CASE WHEN CAST(trunc(l_extendedprice) AS INTEGER) <= 2500 THEN 'good' WHEN CAST(trunc(l_extendedprice) AS INTEGER) <= 4000 THEN 'needs-improvement' ELSE 'poor' END AS lcp, CASE WHEN round(l_discount * 3, 4) <= 0.1::DOUBLE THEN 'good' WHEN round(l_discount * 3, 4) <= 0.25::DOUBLE THEN 'needs-improvement' ELSE 'poor' END AS cls, count(*) AS rows FROM lineitem GROUP BY ALL"


def third_party_bytes(spark: SparkSession, sf_dir: str, most: int = 12) -> DataFrame:
    """The heaviest hosts over all pages: suppliers stand for hosts, parts' sizes for bytes."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    return items.groupBy(F.col("l_suppkey").alias("host")).agg(F.sum("p_size").alias("bytes"), F.count_distinct("l_orderkey").alias("pages")).orderBy(F.desc("bytes"), "host").limit(most)


THIRD_PARTY_BYTES = "SELECT l_suppkey AS host, CAST(sum(p_size) AS BIGINT) AS bytes, count(DISTINCT l_orderkey) AS pages FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY bytes DESC, host LIMIT 12"


def clamp_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by brand: those of gap parts (odd sizes) that reach the lowest seed score are put below it, in their order."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", (F.col("p_size") % 2 == 1).alias("gap"), F.round(F.col("p_retailprice") / 10_000, 6).alias("score"))
    floor = F.min(F.when(~F.col("gap"), F.col("score"))).over(W.Window.partitionBy("p_brand"))
    rows = part.withColumn("floor", floor).withColumn("over", F.col("gap") & (F.col("score") >= F.col("floor")))
    place = F.row_number().over(W.Window.partitionBy("p_brand", "over").orderBy(F.desc("score"), "p_partkey")) - 1
    return rows.select("p_partkey", F.round(F.when(F.col("over"), F.col("floor") - 0.001 - 0.001 * place).otherwise(F.col("score")), 6).alias("score"))


CLAMP_LADDER = """
WITH p AS (SELECT p_partkey, p_brand, p_size % 2 = 1 AS gap, round(p_retailprice / 10000, 6) AS score FROM part), f AS (SELECT *, min(score) FILTER (NOT gap) OVER (PARTITION BY p_brand) AS floor FROM p), o AS (SELECT *, coalesce(gap AND score >= floor, false) AS over_ FROM f)
SELECT p_partkey, round(CASE WHEN over_ THEN floor - 0.001::DOUBLE - 0.001::DOUBLE * (row_number() OVER (PARTITION BY p_brand, over_ ORDER BY score DESC, p_partkey) - 1) ELSE score END, 6) AS score FROM o
"""


def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of two sources, each once by lower case, as first written, in order of arrival."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    both = part.select(F.initcap("p_name").alias("shown"), F.col("p_partkey").alias("ord")).unionByName(part.select(F.upper("p_name").alias("shown"), (F.col("p_partkey") + 10_000_000).alias("ord")))
    return both.groupBy(F.lower("shown").alias("keyword")).agg(F.min_by("shown", "ord").alias("shown"), F.min("ord").alias("ord"))


ORDERED_UNION = "SELECT lower(p_name) AS keyword, array_to_string(list_transform(string_split(min_by(p_name, p_partkey), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS shown, min(p_partkey) AS ord FROM part GROUP BY 1"


def new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' parts of the last year that weren't sold before; a supplier seen for the first time has no news."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("domain"), F.col("l_partkey").alias("url"), (F.col("l_shipdate") >= F.lit("2000-11-05").cast("timestamp")).alias("now"))
    known = lines.where(~F.col("now")).select("domain", "url").distinct()
    fresh = lines.where("now").select("domain", "url").distinct().join(known, ["domain", "url"], "left_anti")
    return fresh.join(known.select("domain").distinct(), "domain", "left_semi").groupBy("domain").agg(F.count(F.lit(1)).alias("new"))


NEW_URLS = "WITH l AS (SELECT DISTINCT l_suppkey AS domain, l_partkey AS url, l_shipdate >= TIMESTAMP '2000-11-05' AS now FROM lineitem) SELECT domain, count(*) AS new FROM l a WHERE now AND NOT EXISTS (FROM l b WHERE NOT b.now AND b.domain = a.domain AND b.url = a.url) AND EXISTS (FROM l b WHERE NOT b.now AND b.domain = a.domain) GROUP BY domain"


def dissect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every page, without the text itself."""
    return D.dissect(pages(spark, sf_dir)).drop("text")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a two-word phrase in every document."""
    rows = M.mentions(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["eder", "ander"])
    return rows.select("doc_id", "mention.*")


def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword clusters of each brand's part names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("keyword"))
    return M.clusters(part, "brand")


_ALL = (norm_url, page_types, url_lints, inlinks, unlisted_links, dup_titles, first_n_per_section, slug_bigrams, issue_matrix, landing_scores, subtype_rollup, speed_percentiles, ratings, third_party_bytes, clamp_ladder, ordered_union, new_urls)
QUERIES = {f.__name__: f for f in (*_ALL, dissect, mentions, greedy_clusters)}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
