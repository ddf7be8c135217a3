"""The sitemap diagnosis: the driver's customers stand for listed URLs, its nations for files, the rest for probes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.operators import sitemaps as M
from sitelumen.sources import sitemap as X

#: Facts by a row's number k, in SQL that Spark and DuckDB share.
_TABLES = {
    "robots": ("region", "SELECT lower(r_name) AS domain, CASE r_regionkey WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS status, CAST(r_regionkey % 3 AS INTEGER) AS sitemaps FROM region"),
    "files": (
        "nation",
        """SELECT concat('https://shop.example.com/d', k, '/part-', k % 15, '.xml') AS sitemap, CASE WHEN k % 4 = 0 THEN 404 WHEN k % 7 = 0 THEN NULL ELSE 200 END AS status, k % 3 <> 0 AS declared, k % 5 = 2 AS nested,
        k % 8 = 0 AS redirected, CASE k % 6 WHEN 0 THEN 'unparseable' WHEN 1 THEN 'index' ELSE 'urlset' END AS kind, CASE WHEN k % 9 = 2 THEN 0 WHEN k = 11 THEN 60000 ELSE k * 10 END AS url_count,
        CAST(k AS BIGINT) * 3000000 AS bytes, CASE WHEN k % 2 = 0 THEN 0 ELSE k END AS lastmod_count, CASE WHEN k % 10 = 3 THEN 2 ELSE 0 END AS lastmod_invalid, CASE WHEN k % 10 = 7 THEN 1 ELSE 0 END AS lastmod_future
        FROM (SELECT CAST(n_nationkey AS INTEGER) AS k FROM nation) AS n""",
    ),
    "urls": (
        "customer",
        """SELECT concat(CASE WHEN k % 19 = 0 THEN 'http://' ELSE 'https://' END, CASE WHEN k % 29 = 0 THEN 'www.' ELSE '' END, 'shop.example.com/', CASE WHEN k % 13 = 0 THEN 'Blog' ELSE 'blog' END, '/',
          CASE WHEN k % 11 = 0 THEN 'a_page_' ELSE 'a-page-' END, CASE WHEN k % 17 = 0 THEN repeat('long-', 25) ELSE '' END, k, CASE WHEN k % 23 = 0 THEN '?p=1' ELSE '' END) AS url,
        CASE WHEN k % 31 = 0 THEN 2 ELSE 1 END AS sitemaps, k % 37 <> 0 AS found, CASE WHEN k % 37 <> 0 THEN k % 41 = 0 END AS offsite, CASE WHEN k % 37 <> 0 THEN k = 1 END AS home,
        CASE WHEN k % 37 = 0 THEN NULL WHEN k % 15 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN k % 37 <> 0 THEN k % 12 = 0 END AS redirected, CASE WHEN k % 37 <> 0 THEN k % 36 = 0 END AS downgraded,
        CASE WHEN k % 37 <> 0 THEN k % 18 = 0 END AS noindex, CASE WHEN k % 14 = 0 THEN 'other' WHEN k % 37 <> 0 THEN 'self' END AS canonical_kind, k % 43 = 0 AS robots_blocked,
        CASE WHEN k % 21 = 0 THEN 'Page not found' WHEN k % 37 <> 0 THEN c_name END AS title, CASE WHEN k % 22 = 0 THEN 'Error 404 here' END AS h1, CASE WHEN k % 25 = 0 THEN 10 WHEN k % 37 <> 0 THEN k * 31 % 700 END AS words,
        CASE WHEN k % 37 <> 0 THEN k * 31 % 700 + 50 END AS body_words, CASE WHEN k % 37 <> 0 THEN k % 16 END AS inlinks, CASE WHEN k % 10 = 0 THEN concat('h', k % 100) WHEN k % 37 <> 0 THEN concat('u', k) END AS content_hash,
        CASE WHEN k % 27 = 0 THEN 2 WHEN k % 37 <> 0 THEN 0 END AS mixed FROM (SELECT CAST(c_custkey AS INTEGER) AS k, c_name FROM customer) AS c""",
    ),
    "hosts": ("region", "SELECT concat('http://', lower(r_name), '.example.com/') AS variant, r_regionkey % 2 = 0 AS ok FROM region"),
    "security": ("region", "SELECT lower(r_name) AS host, r_regionkey <> 3 AS hsts FROM region"),
    "slashes": ("supplier", "SELECT concat('s', s_suppkey % 5) AS section, concat('https://shop.example.com/s/', s_suppkey, '/') AS variant, CASE WHEN s_suppkey % 7 = 0 THEN 404 ELSE 200 END AS status, s_suppkey % 3 = 0 AS redirects, s_suppkey % 2 = 0 AS canonical FROM supplier"),
    "unlisted": ("supplier", "SELECT concat('https://shop.example.com/u/', s_suppkey) AS url, CASE WHEN s_suppkey % 7 = 0 THEN 404 ELSE 200 END AS status, s_suppkey % 5 = 0 AS redirected, s_suppkey % 6 = 0 AS noindex, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'self' END AS canonical_kind FROM supplier"),
}


def _facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = _TABLES[name]
    return spark.sql(sql.replace(f"FROM {table}", "FROM {rows}"), rows=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {"robots": M.of_robots, "files": M.of_files, "urls": M.of_urls, "hosts": M.of_hosts, "security": M.of_security, "slashes": M.of_slashes, "unlisted": M.of_unlisted}
    return M.diagnose(*(found(_facts(spark, sf_dir, name)) for name, found in of.items()))


def sitemap_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding: (code, severity, subject)."""
    return _findings(spark, sf_dir)


def sitemap_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.issues(_findings(spark, sf_dir))


#: The parts of a site that are also scored alone.
SCOPES = {"all": "", "urls": "url-", "files": "sitemap-", "dates": "lastmod-", "slashes": "slash-"}


def sitemap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, score): of the site, and of the findings about its URLs, files, dates and slash forms alone."""
    found, urls = M.issues(_findings(spark, sf_dir)), _facts(spark, sf_dir, "urls").count()
    each = (M.score(found.where(F.col("code").startswith(prefix)), urls).select(F.lit(scope).alias("scope"), "score") for scope, prefix in SCOPES.items())
    return functools.reduce(DataFrame.unionByName, each)


def sitemap_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed URLs with problems, by how many they have."""
    rows = M.affected(_findings(spark, sf_dir))
    return rows.selectExpr("url", "array_join(problems, ', ') AS problems")


def sitemap_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dead_twins(_facts(spark, sf_dir, "files"))


#: Robots files by number, and the URLs that are asked for, in SQL that Spark and DuckDB share; chr(10) ends a line.
_ROBOTS = """SELECT concat('https://d', k, '.example.com/robots.txt') AS url, CASE WHEN k = 24 THEN 404 ELSE 200 END AS status,
  concat('User-agent: *', chr(10), 'Disallow: /a/', k % 3, CASE WHEN k % 2 = 0 THEN ' # old' ELSE '' END, chr(10), 'Allow: /b', chr(10), CASE WHEN k % 4 = 0 THEN '' ELSE concat('Disallow: /b/1', chr(10)) END, chr(10),
    CASE WHEN k % 3 = 0 THEN concat('user-agent: otherbot', chr(10), 'User-Agent: Googlebot', chr(10), 'Disallow:', CASE WHEN k % 6 = 0 THEN '' ELSE ' /c' END, chr(10), 'Disallow: /', chr(10)) ELSE '' END, 'Sitemap: https://d.example.com/s.xml') AS body
FROM (SELECT CAST(n_nationkey AS INTEGER) AS k FROM nation) AS n"""
_ASKED = "SELECT concat('https://d', c_custkey % 25, '.example.com/', CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END, '/', c_custkey % 7, '/', c_custkey) AS url FROM customer"


def robots_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, robots_blocked) by each domain's robots file."""
    shared = lambda sql, table: spark.sql(sql.replace(f"FROM {table}", "FROM {rows}"), rows=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    return X.robots_blocked(shared(_ASKED, "customer"), X.robots_rules(shared(_ROBOTS, "nation")))


ROBOTS_BLOCKED = f"""
WITH f AS ({_ROBOTS}), u AS ({_ASKED}), l AS (SELECT regexp_extract(url, '//([^/]*)', 1) AS domain, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS ord FROM f WHERE status = 200),
s AS (SELECT domain, ord, lower(regexp_extract(line, '(?i)^\\s*(user-agent|allow|disallow)\\s*:', 1)) AS field, trim(regexp_replace(regexp_replace(line, '#.*$', ''), '^[^:]*:', '')) AS value FROM l WHERE regexp_matches(line, '(?i)^\\s*(user-agent|allow|disallow)\\s*:')),
g AS (SELECT *, CASE WHEN field = 'user-agent' AND lag(field) OVER w IS DISTINCT FROM 'user-agent' THEN 1 ELSE 0 END AS b FROM s WINDOW w AS (PARTITION BY domain ORDER BY ord)), h AS (SELECT *, sum(b) OVER (PARTITION BY domain ORDER BY ord) AS grp FROM g),
c AS (SELECT domain, coalesce(min(grp) FILTER (lower(value) = 'googlebot'), min(grp) FILTER (value = '*')) AS grp FROM h WHERE field = 'user-agent' GROUP BY domain),
r AS (SELECT h.domain, ord, field = 'allow' OR value = '' AS allow, value FROM h JOIN c USING (domain, grp) WHERE field <> 'user-agent'),
m AS (SELECT url, min_by(allow, ord) AS allow FROM u JOIN r ON r.domain = regexp_extract(url, '//([^/]*)', 1) AND starts_with(regexp_extract(url, '//[^/]*(.*)$', 1), r.value) GROUP BY url)
SELECT u.url, NOT coalesce(allow, true) AS robots_blocked FROM u LEFT JOIN m USING (url)
"""

_ALIVE = "status = 200 AND found AND NOT offsite"
_PATH = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), ''), '/')"
_ERROR = M.ERROR_PAGE.replace("'", "''")
#: (table, subject, code, where)
_FLAGS = [
    ("robots", "domain", "robots-missing", "status IS DISTINCT FROM 200"),
    ("robots", "domain", "robots-no-sitemap", "status = 200 AND sitemaps = 0"),
    ("files", "sitemap", "sitemap-declared-dead", "declared AND status IS DISTINCT FROM 200"),
    ("files", "sitemap", "sitemap-child-dead", "NOT declared AND status IS DISTINCT FROM 200"),
    ("files", "sitemap", "sitemap-redirects", "redirected"),
    ("files", "sitemap", "sitemap-unparseable", "kind = 'unparseable'"),
    ("files", "sitemap", "sitemap-empty", "kind = 'urlset' AND url_count = 0"),
    ("files", "sitemap", "sitemap-oversize", "url_count > 50000 OR bytes > 52428800"),
    ("files", "sitemap", "lastmod-invalid", "lastmod_invalid > 0"),
    ("files", "sitemap", "lastmod-future", "lastmod_future > 0"),
    ("files", "sitemap", "lastmod-missing", "kind = 'urlset' AND url_count > 0 AND lastmod_count = 0"),
    ("files", "sitemap", "sitemap-nested-index", "kind = 'index' AND nested"),
    ("url", "url", "url-non200", "NOT offsite AND status <> 200"),
    ("url", "url", "url-redirect", "redirected AND NOT offsite"),
    ("url", "url", "url-redirect-downgrade", "downgraded"),
    ("url", "url", "url-noindex", "noindex"),
    ("url", "url", "url-canonical-elsewhere", "status = 200 AND canonical_kind = 'other'"),
    ("url", "url", "url-robots-blocked", "robots_blocked"),
    ("url", "url", "url-http", "starts_with(url, 'http://')"),
    ("url", "url", "url-soft404", f"{_ALIVE} AND (regexp_matches(title, '{_ERROR}') OR regexp_matches(coalesce(h1, ''), '{_ERROR}') OR (coalesce(words, 0) < 40 AND coalesce(body_words, 0) < 120))"),
    ("url", "url", "url-mixed-content", f"{_ALIVE} AND mixed > 0"),
    ("url", "url", "url-orphan", f"{_ALIVE} AND coalesce(inlinks, 0) = 0 AND NOT home"),
    ("url", "url", "url-listed-twice", "sitemaps > 1"),
    ("url", "url", "url-params", "contains(url, '?')"),
    ("url", "url", "url-uppercase", f"{_PATH} <> lower({_PATH})"),
    ("url", "url", "url-underscore", f"contains({_PATH}, '_')"),
    ("url", "url", "url-long", "length(url) > 115"),
    ("(SELECT content_hash FROM url WHERE " + _ALIVE + " AND words >= 50 GROUP BY content_hash HAVING count(*) > 1)", "content_hash", "url-duplicate-content", "content_hash IS NOT NULL"),
    ("(SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, count(DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))) OVER () AS n FROM url)", "host", "url-mixed-hosts", "n > 1"),
    ("hosts", "variant", "host-not-canonicalised", "NOT ok"),
    ("security", "host", "no-hsts", "NOT hsts"),
    ("slashes", "variant", "slash-duplicates", "status = 200 AND NOT redirects AND NOT canonical"),
    ("slashes", "variant", "slash-canonical-only", "status = 200 AND NOT redirects AND canonical"),
    ("unlisted", "url", "unlisted-live-pages", "status = 200 AND NOT redirected AND NOT noindex AND canonical_kind IS DISTINCT FROM 'other'"),
]
_BLANK = {"offsite": "false", "home": "false", "status": "0", "redirected": "false", "downgraded": "false", "noindex": "false", "canonical_kind": "''", "title": "''", "mixed": "0"}
_FOUND = f"""{', '.join(f"{name} AS ({sql})" for name, (_, sql) in _TABLES.items())},
url AS (SELECT * REPLACE ({', '.join(f"coalesce({k}, {v}) AS {k}" for k, v in _BLANK.items())}) FROM urls),
d AS ({' UNION ALL '.join(f"SELECT '{code}' AS code, '{M.SEVERITY[code]}' AS severity, {subject} AS subject FROM {table} WHERE {where}" for table, subject, code, where in _FLAGS)})"""
SITEMAP_FINDINGS = f"WITH {_FOUND} SELECT * FROM d"
SITEMAP_ISSUES = f"WITH {_FOUND} SELECT code, severity, count(*) AS count, min(subject) AS first FROM d GROUP BY code, severity"
SITEMAP_SCORE = f"""WITH {_FOUND}, i AS (SELECT code, severity, count(*) AS n FROM d GROUP BY code, severity), w AS (SELECT *, CASE severity WHEN 'high' THEN 12.0 WHEN 'medium' THEN 5.0 WHEN 'low' THEN 2.0 ELSE 0.0 END::DOUBLE AS flat, CASE severity WHEN 'high' THEN 40.0 WHEN 'medium' THEN 18.0 WHEN 'low' THEN 5.0 ELSE 0.0 END::DOUBLE AS per FROM i)
SELECT scope, CAST(greatest(0, round_even(100 - round(sum(CASE WHEN starts_with(code, 'url-') THEN per * least(1.0::DOUBLE, n / (SELECT count(*) FROM urls)) + flat / 2 ELSE flat END), 9), 0)) AS INTEGER) AS score FROM w JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SCOPES.items())}) AS s(scope, prefix) ON starts_with(code, prefix) GROUP BY scope"""
SITEMAP_AFFECTED = f"WITH {_FOUND} SELECT subject AS url, string_agg(DISTINCT code, ', ' ORDER BY code) AS problems FROM d WHERE starts_with(code, 'url-') AND code NOT IN ('url-underscore', 'url-long', 'url-duplicate-content', 'url-mixed-hosts') GROUP BY subject"
SITEMAP_TWINS = f"WITH files AS ({_TABLES['files'][1]}), n AS (SELECT *, regexp_extract(sitemap, '([^/?#]*)$', 1) AS name FROM files) SELECT a.sitemap, (SELECT max(b.sitemap) FROM n b WHERE b.status = 200 AND b.name = a.name) AS real_file FROM n a WHERE declared AND status IS DISTINCT FROM 200"

_ALL = (sitemap_findings, sitemap_issues, sitemap_score, sitemap_affected, sitemap_twins, robots_blocked)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
