"""Pages that compete for one target: the driver's parts stand for pages, their names for what pages are about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.operators import containment as C
from sitelumen.operators.store import settle
from sitelumen.plans import landing

#: Facts of a page by its number k, in SQL that Spark and DuckDB share but for ranges. ``shingles`` stand for the content.
_FACTS = """
SELECT k AS page, CASE WHEN k % 3 = 0 THEN 'blog_post' ELSE 'landing' END AS type, k % 40 AS inlinks, k * 13 % 900 AS words,
  concat('https://shop.example.com/', CASE WHEN k % 3 = 0 THEN 'blog/' ELSE '' END, CASE WHEN k % 4 = 0 THEN concat('item-', k % 50) ELSE concat(replace(p_name, ' ', '-'), CASE WHEN k % 100 = 1 THEN '' ELSE concat('-in-', lower(p_type)) END, CASE WHEN k % 5 = 1 THEN concat('-', 2000 + k % 30) ELSE concat('-', CASE k % 6 WHEN 0 THEN 'boxes' WHEN 1 THEN 'kits' ELSE concat('w', k % 29) END) END) END, '/') AS url,
  CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'Best offers | Acme' ELSE concat('Acme: ', p_type, ' ', p_name, ' w', k % 29) END AS h1, concat(p_name, ' - Acme') AS title, CASE WHEN k % 50 = 0 THEN concat('top ', p_name, ' for 2024') END AS query,
  {range} AS shingles
FROM (SELECT CAST(p_partkey AS INTEGER) AS k, p_name, p_type FROM part) AS p
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its target keyword, as a struct."""
    sql = _FACTS.format(range="sequence(CAST(k % 64 AS BIGINT), CAST(k % 64 + CASE WHEN k % 11 = 0 THEN 20 ELSE 60 END AS BIGINT))")
    rows = spark.sql(sql.replace("FROM part)", "FROM {part})"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return C.with_target(rows.withColumn("path", F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1)), brand="Acme")


def target_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("page", "target.phrase", F.array_join("target.tokens", " ").alias("tokens"), "target.source")


def _rivals(spark: SparkSession, sf_dir: str) -> C.Rivals:
    rows = facts(spark, sf_dir)
    return C.Rivals(settle(rows.select("page", "target.tokens", "type", F.col("shingles").alias("set"), C.strength(F.col("type"), F.col("inlinks"), F.col("words"), F.col("url")).alias("strength"))))


def cannibalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hub, spoke, kind, severity, similarity, keep) of each two pages that compete."""
    return _rivals(spark, sf_dir).pairs().withColumn("similarity", F.round("similarity", 6))


def competitor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rivals(spark, sf_dir).clusters()
    return rows.select("keep", "severity", "competitors", F.array_join(F.transform("pages", lambda p: p.cast("string")), " ").alias("pages"))


def healthy_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rivals(spark, sf_dir).healthy_hubs()


def competition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rivals(spark, sf_dir).counts()


def _pairs_of(text: str, numbers: str) -> str:
    """DuckDB: a list of {s: stem, w: word} of a phrase, each stem once. ``numbers``: the pattern of those that are kept."""
    words = f"list_filter(list_transform(regexp_extract_all(translate({text}, '_-', '  '), '{landing._RX}'), lambda w: lower(w)), lambda w: w NOT IN ({landing._STOPPED}) AND (NOT regexp_full_match(w, '[0-9]+') OR regexp_full_match(w, '{numbers}')))"
    made = f"list_transform({words}, lambda w: {{'s': {landing._STEM}, 'w': w}})"
    return f"list_reduce(list_transform({made}, lambda x: [x]), lambda a, x: CASE WHEN list_contains(list_transform(a, lambda y: y.s), x[1].s) THEN a ELSE a || x END, CAST([] AS STRUCT(s VARCHAR, w VARCHAR)[]))"


_BRANDLESS = "trim(regexp_replace({}, '(?i)\\s*[|\\-–—:]?\\s*Acme\\s*[|\\-–—:]?\\s*', ' ', 'g'))"
_S = "list_transform({}, lambda x: x.s)"
def targeted(h1: str, title: str) -> str:
    """The SQL of the targets t, of a table f of pages; ``h1`` and ``title`` without the brand."""
    return f"""
a AS (SELECT *, {_pairs_of("array_to_string(list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/]*([^?#]*)', 1), '/'), lambda s: s NOT IN ('', 'blog', 'category', 'tag')), ' ')", "[0-9]+")} AS slug, {_pairs_of(h1, 'x')} AS head, {_pairs_of(title, 'x')} AS head2, {_pairs_of("coalesce(query, '')", '(19|20)[0-9][0-9]')} AS asked FROM f),
b AS (SELECT * REPLACE (CASE WHEN len(head) > 0 THEN head ELSE head2 END AS head), len(list_filter(slug, lambda x: NOT regexp_full_match(x.s, '[0-9]+'))) >= 2 AS enough FROM a),
c AS (SELECT *, CASE WHEN enough OR len(head) = 0 THEN {_S.format('slug')} ELSE (list_filter({_S.format('head')} || {_S.format('slug')}, lambda x, i: list_position({_S.format('head')} || {_S.format('slug')}, x) = i))[:6] END AS chosen FROM b),
d AS (SELECT *, list_filter({_S.format('head')}, lambda t: list_contains(chosen, t)) || list_filter(chosen, lambda t: NOT list_contains({_S.format('head')}, t)) AS ordered FROM c),
t AS (SELECT *, CASE WHEN coalesce(query, '') <> '' THEN {_S.format('asked')} ELSE ordered END AS tokens,
  CASE WHEN coalesce(query, '') <> '' THEN array_to_string(list_transform(asked, lambda x: x.w), ' ') ELSE array_to_string(list_transform(ordered, lambda t: coalesce(list_filter(slug || head, lambda x: x.s = t)[1].w, t)), ' ') END AS phrase,
  CASE WHEN coalesce(query, '') <> '' THEN 'search-console' WHEN enough OR len(head) = 0 THEN 'url' WHEN len(slug) > 0 THEN 'h1+url' WHEN {h1} <> '' THEN 'h1' ELSE 'title' END AS source FROM d)
"""


_TARGETS = f"""
f AS ({_FACTS.format(range="range(CAST(k % 64 AS BIGINT), CAST(k % 64 + CASE WHEN k % 11 = 0 THEN 21 ELSE 61 END AS BIGINT))")}),
{targeted(_BRANDLESS.format("h1"), _BRANDLESS.format("title"))}"""
TARGET_KEYWORDS = f"WITH {_TARGETS} SELECT page, phrase, array_to_string(tokens, ' ') AS tokens, source FROM t"

_PAIRS = """
p AS (SELECT page, tokens, list_filter(tokens, lambda t: NOT regexp_full_match(t, '[0-9]+')) AS base, type, shingles, row(CASE WHEN type IN ('home', 'landing') THEN 1 ELSE 0 END, inlinks, words, -len(string_split(regexp_replace(url, '/+$', ''), '/'))) AS strength FROM t),
m AS (SELECT i.page AS i, j.page AS j, i.tokens AS a, j.tokens AS b, i.type AS ti, j.type AS tj, i.shingles AS si, j.shingles AS sj, i.strength >= j.strength AS i_strong, i.strength = j.strength AS alike,
  len(list_intersect(i.tokens, j.tokens)) AS shared, len(list_filter(i.tokens, lambda t: NOT list_contains(j.tokens, t))) AS only_i, len(list_filter(j.tokens, lambda t: NOT list_contains(i.tokens, t))) AS only_j, list_sort(i.base) = list_sort(j.base) AS same_base
  FROM p i JOIN p j ON i.page <> j.page AND len(i.base) >= 2 AND len(list_filter(i.base, lambda t: NOT list_contains(j.base, t))) <= CASE WHEN len(i.base) >= 7 THEN 1 ELSE 0 END),
n AS (SELECT *, only_i + only_j = 0 AS equal, same_base AND only_i + only_j > 0 AS series FROM m),
o AS (SELECT * FROM n WHERE series OR (shared >= 2 AND shared >= 0.85::DOUBLE * least(len(a), len(b))) QUALIFY row_number() OVER (PARTITION BY least(i, j), greatest(i, j) ORDER BY i) = 1),
q AS (SELECT *, CASE WHEN len(si) >= 35 AND len(sj) >= 35 THEN len(list_intersect(si, sj)) / len(list_distinct(si || sj)) END AS similarity, CASE WHEN series OR equal THEN i_strong ELSE len(a) < len(b) END AS i_hub FROM o),
r AS (SELECT *, coalesce(similarity, 0) AS sim, list_filter(CASE WHEN i_hub THEN b ELSE a END, lambda t: NOT list_contains(CASE WHEN i_hub THEN a ELSE b END, t)) AS extra FROM q),
s AS (SELECT *, CASE WHEN series THEN 'numbered-series' WHEN equal THEN 'same-target' WHEN sim >= 0.8::DOUBLE THEN 'copied-spoke' WHEN (ti IN ('home', 'landing')) <> (tj IN ('home', 'landing')) AND len(extra) <= 1 AND len(list_filter(extra, lambda t: regexp_full_match(t, '[0-9]+'))) = 0 THEN 'blog-vs-landing' WHEN sim >= 0.5::DOUBLE THEN 'hub-spoke-overlap' ELSE 'hub-spoke' END AS kind FROM r),
u AS (SELECT CASE WHEN i_hub THEN i ELSE j END AS hub, CASE WHEN i_hub THEN j ELSE i END AS spoke, kind, CASE WHEN kind IN ('same-target', 'copied-spoke') THEN 'high' WHEN kind = 'numbered-series' THEN CASE WHEN sim >= 0.8::DOUBLE THEN 'high' ELSE 'medium' END WHEN kind = 'blog-vs-landing' THEN CASE WHEN sim >= 0.5::DOUBLE THEN 'high' ELSE 'medium' END WHEN kind = 'hub-spoke-overlap' THEN 'medium' ELSE 'low' END AS severity,
  round(similarity, 6) AS similarity, CASE WHEN alike THEN CASE WHEN i_hub THEN i ELSE j END WHEN i_strong THEN i ELSE j END AS keep FROM s WHERE kind <> 'numbered-series' OR sim >= 0.5::DOUBLE)
"""
_COMPETING = f"{_TARGETS}, {_PAIRS}"
CANNIBALIZATION = f"WITH {_COMPETING} SELECT * FROM u"
COMPETITOR_CLUSTERS = f"""WITH {_COMPETING}, v AS (SELECT keep, min(CASE severity WHEN 'high' THEN 0 ELSE 1 END) AS rank, count(*) AS competitors, array_to_string(list_sort(list(DISTINCT CASE WHEN keep = hub THEN spoke ELSE hub END)), ' ') AS pages FROM u WHERE severity <> 'low' GROUP BY keep ORDER BY rank, competitors DESC, keep LIMIT 250)
SELECT keep, CASE rank WHEN 0 THEN 'high' ELSE 'medium' END AS severity, competitors, pages FROM v"""
HEALTHY_HUBS = f"WITH {_COMPETING} SELECT hub, count(*) AS spokes FROM u WHERE severity = 'low' GROUP BY hub ORDER BY spokes DESC, hub LIMIT 60"
COMPETITION_COUNTS = f"WITH {_COMPETING} SELECT k.kind, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ('high', 'medium', 'low'))} FROM (VALUES {', '.join(f"('{k}')" for k in C.KINDS)}) AS k(kind) LEFT JOIN u ON u.kind = k.kind GROUP BY k.kind"

_ALL = (target_keywords, cannibalization, competitor_clusters, healthy_hubs, competition_counts)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
