"""The landing-page audit over a table of page facts: the driver's parts stand for pages, their numbers for what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.functions import text as T
from sitelumen.operators import landing as L

#: Facts of a page by its number k, in SQL that Spark and DuckDB share but for lists and for the width of products, which numbers of large tables need.
_FACTS = """
SELECT k AS page, CASE k % 7 WHEN 0 THEN 'home' WHEN 1 THEN 'location' WHEN 2 THEN 'centre' WHEN 3 THEN 'service' ELSE 'page' END AS subtype,
  concat('https://shop.example.com/', CASE WHEN k % 17 = 0 THEN 'a-rather-long-name-of-a-section-that-goes-on/and-on-for-a-good-while/' ELSE '' END, CASE WHEN k % 13 = 0 THEN 'Item' ELSE replace(p_name, ' ', '-') END, '/', k, '?x=1') AS url,
  CASE WHEN k % 23 = 0 THEN 404 ELSE 200 END AS status, k % 11 = 0 AS redirected, k % 33 = 0 AS downgraded, k % 29 = 0 AS noindex, k % 31 = 0 AS robots_blocked,
  CASE k % 9 WHEN 0 THEN 'missing' WHEN 1 THEN 'other' ELSE 'self' END AS canonical_kind, title, title AS title_words, {split}(CASE WHEN k % 41 = 0 THEN NULL ELSE p_name END, ' ') AS named,
  CASE WHEN k % 3 = 0 THEN 'url' ELSE 'h1' END AS keyword_source,
  CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN concat('Buy ', p_name) WHEN 2 THEN concat('All about the ', p_type, ' kinds of goods that our shop has, each at its own price and size: ', k) WHEN 3 THEN concat('Find every ', p_name, ' here: sizes, colours and prices of a hundred makers, delivered to your door within two days or less, with a year of warranty and free returns at any time ', k) ELSE concat('The ', p_name, ' of your choice, in each size and colour, at a fair price, number ', k) END AS description,
  CASE k % 8 WHEN 0 THEN {none} WHEN 1 THEN {open}p_name, 'More'{close} WHEN 2 THEN {open}p_type{close} ELSE {open}concat(p_name, ' ', k){close} END AS h1,
  k % 5 AS heading_skips, k % 4 AS h2, CAST(k * 37 % 900 AS INTEGER) AS words, CAST(k * 37 % 900 + k * 53 % 2500 AS INTEGER) AS body_words, CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k * 37 % 900 - k % 300 AS INTEGER) END AS own_words,
  CASE WHEN k % 4 = 0 THEN p_type ELSE concat('We make the ', p_name, ' for you') END AS intro, CASE WHEN k % 12 = 0 THEN 0.7 + CAST(k % 3 AS DOUBLE) / 10 END AS twin,
  CAST(k * 7 % 150 AS INTEGER) AS images, CAST(floor(CASE WHEN k % 2 = 0 THEN k * 7 % 150 / 3 ELSE 0 END) AS INTEGER) AS img_no_alt, CAST(floor(CASE WHEN k % 3 = 0 THEN (k * 7 % 150) * (k % 10) ELSE 0 END / 10) AS INTEGER) AS img_no_dims, k % 3 AS img_lazy,
  k % 19 AS inlinks, CASE WHEN k % 14 = 0 THEN 2 ELSE 0 END AS nofollow, k % 5 AS generic_anchors, k % 6 AS empty_anchors, CAST(k * 11 % 400 AS INTEGER) AS links,
  CASE k % 8 WHEN 0 THEN {none} WHEN 1 THEN {open}'BreadcrumbList', 'Course'{close} WHEN 2 THEN {open}'Organization', 'FAQPage'{close} WHEN 3 THEN {open}'School'{close} ELSE {open}'BreadcrumbList'{close} END AS types,
  CASE WHEN k % 21 = 0 THEN 1 ELSE 0 END AS schema_errors, k % 7 AS questions, k % 4 AS og_missing, k % 25 <> 0 AS viewport, CASE k % 15 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'en' END AS lang,
  CASE WHEN k % 16 = 0 THEN 3 ELSE 0 END AS mixed, k % 3 AS blocking_js, k % 7 AS stylesheets, CAST({k} * 1013 % 400000 AS INTEGER) AS html_bytes, CAST(k * 29 % 1200 AS INTEGER) AS ttfb_ms,
  CASE WHEN k % 6 = 5 THEN NULL ELSE CAST(k * 41 % 6000 AS INTEGER) END AS lcp_ms, CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(floor(k * 41 % 6000 / 2) AS INTEGER) END AS content_lcp_ms, k % 5 = 0 AS popup,
  CASE WHEN k % 18 = 0 THEN NULL ELSE CAST(k % 40 AS DOUBLE) / 100 END AS cls, CASE WHEN k % 26 = 0 THEN NULL ELSE CAST({k} * 9973 % 5000000 AS INTEGER) END AS bytes
FROM (SELECT CAST(p_partkey AS INTEGER) AS k, p_name, p_type, CASE WHEN p_partkey % 37 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 5 = 1 THEN concat(p_type, ' goods from many makers, and ', p_name, ' ', p_partkey)
  WHEN p_partkey % 5 = 2 THEN concat('Household goods of every kind and size at a fair price: ', p_name, ' ', p_partkey) ELSE concat(p_name, ' ', p_partkey, ' to buy online now, all kinds') END AS title FROM part) AS p
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A small file is one task's, so pages are dealt out before they are worked on.
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type").repartition("p_partkey")
    rows = spark.sql(_FACTS.format(split="split", none="CAST(array() AS ARRAY<STRING>)", open="array(", close=")", k="CAST(k AS BIGINT)").replace("FROM part)", "FROM {part})"), part=part)
    return rows.withColumn("tokens", F.coalesce("named", F.array().cast("array<string>")))


def landing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding: (page, subtype, check, group, severity)."""
    return L.audit(facts(spark, sf_dir)).where("severity IS NOT NULL")


def landing_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.matrix(L.audit(facts(spark, sf_dir)))


def landing_failing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.failing_pages(L.audit(facts(spark, sf_dir)))


def landing_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scores(L.audit(facts(spark, sf_dir)))


def landing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rollup(L.scores(L.audit(facts(spark, sf_dir))))


_RX = T.WORD.replace("'", "''")
_STOPPED = ", ".join(f"'{w}'" for w in (*T.STOP, *T.MARKETING))
_STEM = "CASE WHEN regexp_full_match(w, '[0-9]+') OR length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(sses|ches|shes|xes|zes)$') THEN left(w, -2) WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|ys)$') THEN left(w, -1) ELSE w END"


def _tokens(text: str) -> str:
    return f"list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(translate({text}, '_-', '  '), '{_RX}'), lambda w: lower(w)), lambda w: w NOT IN ({_STOPPED}) AND (NOT regexp_full_match(w, '[0-9]+') OR regexp_full_match(w, '(19|20)[0-9][0-9]'))), lambda w: {_STEM}))"


_KEY = "nullif(lower(trim({})), '')"
_GROUPS = {"same_title": "title", "same_description": "description", "same_h1": "h1[1]"}
#: (check, group, severity where it fails, where it is counted)
_CHECKS = [
    ("status", "Indexability", "CASE WHEN status <> 200 THEN 'high' END", "true"),
    ("redirect-downgrade", "Indexability", "'high'", "ok AND downgraded"),
    ("redirect", "Indexability", "CASE WHEN redirected THEN 'medium' END", "ok"),
    ("noindex", "Indexability", "CASE WHEN noindex THEN 'high' END", "ok"),
    ("robots-blocked", "Indexability", "CASE WHEN robots_blocked THEN 'high' END", "ok"),
    ("canonical-missing", "Indexability", "CASE WHEN canonical_kind = 'missing' THEN 'medium' END", "ok AND canonical_kind <> 'other'"),
    ("canonical-other", "Indexability", "'high'", "ok AND canonical_kind = 'other'"),
    ("title-missing", "Title", "CASE WHEN title = '' THEN 'high' END", "ok"),
    ("title-long", "Title", "'medium'", "ok AND length(title) > 60"),
    ("title-short", "Title", "CASE WHEN length(title) < 30 THEN 'low' END", "ok AND title <> '' AND length(title) <= 60"),
    ("title-keyword", "Title", "CASE WHEN in_title = len(tokens) THEN 'high' WHEN in_title > 0 THEN 'medium' END", "ok AND title <> '' AND len(tokens) > 0"),
    ("title-keyword-late", "Title", "CASE WHEN NOT list_contains(starts, tokens[1]) THEN 'low' END", "ok AND title <> '' AND len(tokens) > 0 AND in_title = 0"),
    ("title-duplicate", "Title", "CASE WHEN same_title > 1 THEN 'high' END", "ok AND title <> ''"),
    ("meta-missing", "Meta description", "CASE WHEN description = '' THEN 'medium' END", "ok"),
    ("meta-long", "Meta description", "'low'", "ok AND length(description) > 160"),
    ("meta-short", "Meta description", "CASE WHEN length(description) < 70 THEN 'low' END", "ok AND description <> '' AND length(description) <= 160"),
    ("meta-keyword", "Meta description", "CASE WHEN in_description > 0 THEN 'low' END", "ok AND description <> ''"),
    ("meta-duplicate", "Meta description", "CASE WHEN same_description > 1 THEN 'medium' END", "ok AND description <> ''"),
    ("h1-missing", "Headings", "CASE WHEN len(h1) = 0 THEN 'high' END", "ok"),
    ("h1-multiple", "Headings", "CASE WHEN len(h1) > 1 THEN 'medium' END", "ok AND len(h1) > 0"),
    ("h1-keyword", "Headings", "CASE WHEN in_h1 > 0 THEN 'medium' END", "ok AND len(h1) > 0"),
    ("h1-duplicate", "Headings", "CASE WHEN same_h1 > 1 THEN 'medium' END", "ok AND len(h1) > 0"),
    ("heading-skips", "Headings", "CASE WHEN heading_skips > 0 THEN 'low' END", "ok"),
    ("h2-none", "Headings", "CASE WHEN h2 = 0 AND words >= 300 THEN 'medium' END", "ok"),
    ("thin-content", "Content", "CASE WHEN least(words, coalesce(own_words, words)) < 150 THEN 'high' WHEN least(words, coalesce(own_words, words)) < 300 THEN 'medium' END", "ok"),
    ("boilerplate-heavy", "Content", "CASE WHEN body_words >= 400 AND words / body_words < 0.25 THEN 'medium' END", "ok"),
    ("keyword-intro", "Content", "CASE WHEN in_intro > 0 THEN 'medium' END", "ok AND len(tokens) > 0"),
    ("near-duplicate", "Content", "CASE WHEN twin >= 0.85 THEN 'high' WHEN twin IS NOT NULL THEN 'medium' END", "ok"),
    ("img-alt", "Images", "CASE WHEN img_no_alt > 0 THEN 'medium' END", "ok"),
    ("img-dimensions", "Images", "CASE WHEN images > 0 AND img_no_dims > 0 THEN CASE WHEN img_no_dims / images > 0.3 THEN 'medium' ELSE 'low' END END", "ok"),
    ("img-lazy", "Images", "CASE WHEN images > 20 AND img_lazy = 0 THEN 'medium' END", "ok"),
    ("img-count", "Images", "CASE WHEN images > 120 THEN 'low' END", "ok"),
    ("orphan", "Links", "'high'", "ok AND inlinks = 0 AND subtype <> 'home'"),
    ("weak-inlinks", "Links", "CASE WHEN inlinks < 3 AND subtype <> 'home' THEN 'low' END", "ok AND NOT (inlinks = 0 AND subtype <> 'home')"),
    ("nofollow-internal", "Links", "CASE WHEN nofollow > 0 THEN 'medium' END", "ok"),
    ("generic-anchors", "Links", "CASE WHEN generic_anchors >= 3 THEN 'low' END", "ok"),
    ("empty-anchors", "Links", "CASE WHEN empty_anchors >= 3 THEN 'low' END", "ok"),
    ("link-overload", "Links", "CASE WHEN links > 300 THEN 'low' END", "ok"),
    ("schema-broken", "Structured data", "CASE WHEN schema_errors > 0 THEN 'high' END", "ok"),
    ("schema-none", "Structured data", "CASE WHEN len(types) = 0 THEN 'medium' END", "ok"),
    ("schema-breadcrumblist", "Structured data", "CASE WHEN NOT list_contains(types, 'BreadcrumbList') THEN 'low' END", "ok"),
    ("schema-organization", "Structured data", "CASE WHEN NOT list_has_any(types, ['Organization', 'EducationalOrganization', 'LocalBusiness', 'WebSite']) THEN 'medium' END", "ok AND subtype = 'home'"),
    ("schema-localbusiness", "Structured data", "CASE WHEN NOT list_has_any(types, ['LocalBusiness', 'EducationalOrganization', 'School', 'CollegeOrUniversity']) THEN 'medium' END", "ok AND subtype IN ('location', 'centre')"),
    ("schema-course", "Structured data", "CASE WHEN NOT list_has_any(types, ['Course', 'Service', 'Product', 'EducationalOccupationalProgram']) THEN 'low' END", "ok AND subtype = 'service'"),
    ("schema-faq", "Structured data", "'info'", "ok AND questions >= 3 AND NOT list_contains(types, 'FAQPage')"),
    ("og-missing", "Social", "CASE WHEN og_missing > 0 THEN 'low' END", "ok"),
    ("viewport", "Technical", "CASE WHEN NOT viewport THEN 'high' END", "ok"),
    ("lang", "Technical", "CASE WHEN lang IS NULL OR lang = '' THEN 'low' END", "ok"),
    ("mixed-content", "Technical", "CASE WHEN mixed > 0 THEN 'medium' END", "ok"),
    ("render-blocking-js", "Technical", "CASE WHEN blocking_js > 0 THEN 'medium' END", "ok"),
    ("render-blocking-css", "Technical", "CASE WHEN stylesheets > 3 THEN 'low' END", "ok"),
    ("html-weight", "Technical", "CASE WHEN html_bytes > 250000 THEN 'low' END", "ok"),
    ("ttfb", "Technical", "CASE WHEN ttfb_ms > 800 THEN 'medium' END", "ok"),
    ("url-long", "URL", "CASE WHEN length(path) > 75 THEN 'low' END", "ok"),
    ("url-case", "URL", "CASE WHEN path <> lower(path) THEN 'low' END", "ok"),
    ("url-keyword", "URL", "CASE WHEN in_path = len(tokens) THEN 'low' END", "ok AND len(tokens) > 0 AND keyword_source <> 'url'"),
    ("lcp-popup", "Performance", "CASE WHEN popup THEN 'high' END", "ok AND lcp_ms IS NOT NULL"),
    ("lcp", "Performance", "CASE WHEN content > 4000 THEN 'high' WHEN content > 2500 THEN 'medium' END", "ok AND lcp_ms IS NOT NULL AND content IS NOT NULL"),
    ("cls", "Performance", "CASE WHEN cls > 0.25::DOUBLE THEN 'high' WHEN cls > 0.1::DOUBLE THEN 'medium' END", "ok AND lcp_ms IS NOT NULL AND cls IS NOT NULL"),
    ("page-weight", "Performance", "CASE WHEN bytes > 3145728 THEN 'medium' END", "ok AND lcp_ms IS NOT NULL"),
]
_LACKS = {"in_title": "title_words", "in_description": "description", "in_h1": "array_to_string(h1, ' ')", "in_intro": "intro", "in_path": "path"}
# fmt: off
def checked(facts: str) -> str:
    """The SQL of the findings k, of a table of L.FACTS with the target's tokens as ``named``."""
    return f"""
g AS (SELECT *, coalesce(named, CAST([] AS VARCHAR[])) AS tokens, status = 200 AS ok, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path, CASE WHEN popup THEN content_lcp_ms ELSE lcp_ms END AS content, {', '.join(f"count(*) FILTER (status = 200) OVER (PARTITION BY {_KEY.format(v)}) AS {k}" for k, v in _GROUPS.items())} FROM {facts}),
h AS (SELECT *, {_tokens("substr(title, 1, greatest(1, length(title) // 2))")} AS starts, {', '.join(f"len(list_filter(tokens, lambda t: NOT list_contains({_tokens(v)}, t))) AS {k}" for k, v in _LACKS.items())} FROM g),
k AS ({' UNION ALL '.join(f"SELECT page, subtype, '{c}' AS check_, '{g}' AS group_, {s} AS severity FROM h WHERE {w}" for c, g, s, w in _CHECKS)})
"""


_AUDITED = f"""
f AS ({_FACTS.format(split="string_split", none="CAST([] AS VARCHAR[])", open="[", close="]", k="k")}),
{checked("f")}"""
LANDING_AUDIT = f'WITH {_AUDITED} SELECT page, subtype, check_ AS "check", group_ AS "group", severity FROM k WHERE severity IS NOT NULL'
_SEVEREST = "CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END"
LANDING_MATRIX = f"""WITH {_AUDITED}, m AS (SELECT check_ AS "check", group_ AS "group", {_SEVEREST} AS severity, count(*) AS pages, round(count(*) / (SELECT count(DISTINCT page) FROM k), 3) AS share FROM k WHERE severity IS NOT NULL GROUP BY ALL)
SELECT *, pages >= 8 AND share >= 0.8::DOUBLE AS template FROM m"""
LANDING_FAILING_PAGES = f'WITH {_AUDITED} SELECT check_ AS "check", page, CAST(row_number() OVER (PARTITION BY check_ ORDER BY page) AS INTEGER) AS place FROM k WHERE severity IS NOT NULL QUALIFY place <= 400'
_SCORED = """s AS (SELECT page, subtype, count(*) AS checks, count(severity) AS failed, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM k GROUP BY page, subtype),
r AS (SELECT *, CAST(greatest(0, round_even(100 - (10 * high + 4 * medium + low) * 100.0::DOUBLE / greatest(1, 3 * checks), 0)) AS INTEGER) AS score FROM s),
o AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM r)"""
_GRADED = f"{_AUDITED}, {_SCORED}"
LANDING_PAGE_SCORES = f"WITH {_GRADED} SELECT * FROM o"
LANDING_ROLLUP = f"WITH {_GRADED} SELECT subtype, count(*) AS pages, CAST(round_even(avg(score), 0) AS INTEGER) AS score, CAST(sum(high) AS BIGINT) AS high, {', '.join(f"count(*) FILTER (grade = '{g}') AS {g}" for g in 'ABCDF')} FROM o GROUP BY subtype"
# fmt: on

_ALL = (landing_audit, landing_matrix, landing_failing_pages, landing_page_scores, landing_rollup)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
