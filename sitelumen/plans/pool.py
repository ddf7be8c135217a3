"""The keyword pool over search rows, parts' names as seeds and topics and brands as clusters; to-dos from ranks of order priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitelumen.operators import pool as P
from sitelumen.operators.store import settle
from sitelumen.plans import search

#: The four sources in SQL that Spark and DuckDB share.
_SEEDS = "SELECT concat('  ', upper(p_name), ' ') AS keyword, lpad(CAST(p_partkey AS {string}), 12, '0') AS ord FROM part WHERE p_partkey % 9 = 0"
_CLUSTERS = "SELECT concat(p_name, ' ', p_type) AS keyword, CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS cluster, lpad(CAST(p_partkey AS {string}), 12, '0') AS ord FROM part WHERE p_partkey % 4 <> 3"
_TOPICS = "SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE lower(concat(p_name, ' ', p_type)) END AS keyword, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS cluster, lpad(CAST(p_partkey AS {string}), 12, '0') AS ord FROM part WHERE p_partkey % 2 = 0"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    of = lambda sql: spark.sql(sql.format(string="STRING").replace("FROM part", "FROM {part}"), part=part)
    rows = search.account(spark, sf_dir).where("period = 'current'")
    stats = rows.select("query", "page", "clicks", "impressions", "position", F.try_divide("clicks", "impressions").alias("ctr"), F.concat("page", F.lit("|"), F.lpad(F.col("impressions").cast("string"), 12, "0")).alias("ord"))
    return P.pool(stats, of(_SEEDS), of(_CLUSTERS), of(_TOPICS))


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pool, by what it promises."""
    return P.in_order(_pool(spark, sf_dir).withColumn("sources", F.array_join("sources", ",")))


def keyword_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.totals(settle(_pool(spark, sf_dir)))


def rank_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To-dos of order statuses as brands: clerks' groups are keywords, placed by their orders of a month."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("brand"), F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"), F.concat(F.lit("keyword "), F.col("o_custkey") % 40).alias("keyword"))
    counted = rows.groupBy("brand", "snapshot", "keyword").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.withColumn("place", F.row_number().over(W.Window.partitionBy("brand", "snapshot").orderBy(F.desc("n"), "keyword")))
    ranks = placed.select("brand", "snapshot", "keyword", F.when(F.col("place") <= 20, F.col("place")).alias("position"), F.array(F.lit("a.example"), F.concat(F.lit("b"), F.col("place"), F.lit(".example"))).alias("top"))
    return P.rank_todos(settle(ranks))


_STATS = f"SELECT query, page, clicks, impressions, position, clicks / nullif(impressions, 0) AS ctr, page || '|' || lpad(CAST(impressions AS VARCHAR), 12, '0') AS ord FROM ({search.account_sql('a', 'VARCHAR')}) WHERE period = 'current'"
_ROWS = f"""
st AS (SELECT lower(trim(query)) AS keyword, * EXCLUDE (query) FROM ({_STATS})), se AS (SELECT lower(trim(keyword)) AS keyword FROM ({_SEEDS.format(string='VARCHAR')})),
cl AS (SELECT lower(trim(keyword)) AS keyword, nullif(cluster, '') AS cluster, ord FROM ({_CLUSTERS.format(string='VARCHAR')})), tp AS (SELECT lower(trim(keyword)) AS keyword, nullif(cluster, '') AS cluster, ord FROM ({_TOPICS.format(string='VARCHAR')})),
m AS (SELECT keyword, max_by(page, ord) AS page, max_by(clicks, ord) AS clicks, max_by(impressions, ord) AS impressions, round(max_by(position, ord), 1) AS position, round(max_by(ctr, ord), 4) AS ctr FROM st GROUP BY keyword),
a AS (SELECT keyword, max_by(cluster, row(ord, cluster)) FILTER (cluster IS NOT NULL) AS a FROM cl GROUP BY keyword), b AS (SELECT keyword, min_by(cluster, row(ord, cluster)) FILTER (cluster IS NOT NULL) AS b FROM tp GROUP BY keyword),
k AS (SELECT keyword FROM m UNION SELECT keyword FROM se UNION SELECT keyword FROM a UNION SELECT keyword FROM b),
r AS (SELECT k.keyword, concat_ws(',', CASE WHEN m.keyword IS NOT NULL THEN 'search-console' END, CASE WHEN k.keyword IN (SELECT keyword FROM se) THEN 'seed' END, CASE WHEN a.keyword IS NOT NULL THEN 'keyword-lab' END, CASE WHEN b.keyword IS NOT NULL THEN 'blog-plan' END) AS sources,
  coalesce(a.a, b.b) AS cluster, coalesce(page, '') AS page, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, coalesce(position, 0.0::DOUBLE) AS position, coalesce(ctr, 0.0::DOUBLE) AS ctr, concat(' ', k.keyword, ' ') AS pad FROM k LEFT JOIN m USING (keyword) LEFT JOIN a USING (keyword) LEFT JOIN b USING (keyword)),
o AS (SELECT * EXCLUDE (pad), {search._INTENT} AS intent, CASE WHEN impressions <= 0 OR position <= 0 OR position > 30 OR position <= {search._TARGET} THEN 0 ELSE greatest(0, CAST(round_even(({search._ctr_sql(search._TARGET)} - {search._ctr_sql('position')}) * impressions - greatest(0.0::DOUBLE, clicks - impressions * {search._ctr_sql('position')}), 0) AS BIGINT)) END AS opportunity,
  impressions < 30 AS thin, position > 0 AS ranked, CASE WHEN position <= 0 THEN 'unranked' WHEN position <= 3 THEN 'top3' WHEN position <= 10 THEN 'page1' WHEN position <= 20 THEN 'page2' ELSE 'beyond' END AS band FROM r)
"""
KEYWORD_ROWS = f"WITH {_ROWS} SELECT * FROM o"
KEYWORD_TOTALS = f"""WITH {_ROWS}, e AS (SELECT unnest([band, 'all']) AS band, ranked, thin, clicks, impressions, opportunity FROM o)
SELECT v.band, count(e.band) AS keywords, count(*) FILTER (ranked) AS ranked, count(*) FILTER (thin) AS thin, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in ('clicks', 'impressions', 'opportunity'))} FROM (VALUES {', '.join(f"('{b}')" for b in (*P.BANDS, 'all'))}) AS v(band) LEFT JOIN e ON e.band = v.band GROUP BY v.band"""
RANK_TODOS = """
WITH c AS (SELECT o_orderstatus AS brand, strftime(o_orderdate, '%Y-%m') AS snapshot, 'keyword ' || (o_custkey % 40) AS keyword, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY brand, snapshot ORDER BY n DESC, keyword) AS place FROM c), r AS (SELECT brand, snapshot, keyword, CASE WHEN place <= 20 THEN place END AS position, 'a.example, b' || place || '.example' AS top FROM p),
s AS (SELECT brand, snapshot, row_number() OVER (PARTITION BY brand ORDER BY snapshot DESC) AS age FROM (SELECT DISTINCT brand, snapshot FROM r)),
x AS (SELECT n.brand, n.keyword, n.position, n.top, b.position AS before FROM r n JOIN s ON s.brand = n.brand AND s.snapshot = n.snapshot AND s.age = 1 LEFT JOIN s s2 ON s2.brand = n.brand AND s2.age = 2 LEFT JOIN r b ON b.brand = n.brand AND b.snapshot = s2.snapshot AND b.keyword = n.keyword),
t AS (SELECT brand, 'rank_drop' AS kind, 0 AS priority, keyword, position, 'Investigate the ranking drop for ''' || keyword || '''' AS action, 'Fell #' || before || ' → #' || position || ' since the last check — likely a competitor update or stale content' AS why FROM x WHERE position - before >= 2
UNION ALL SELECT brand, 'unranked', 2, keyword, position, 'Create or strengthen a page targeting ''' || keyword || '''', 'Not in the top 10 — currently owned by ' || top FROM x WHERE position IS NULL
UNION ALL SELECT brand, 'striking', 1, keyword, position, 'Refresh the page targeting ''' || keyword || '''', 'Ranks #' || position || ' — a content refresh can realistically reach #' || greatest(3, position - 3) FROM x WHERE position BETWEEN 4 AND 15)
SELECT brand, left(sha1(brand || '|' || kind || '||' || keyword), 12) AS todo_id, kind, keyword, CAST(coalesce(position, 0) AS INTEGER) AS position, action, why, CAST(row_number() OVER (PARTITION BY brand ORDER BY priority, coalesce(position, 99), keyword) AS INTEGER) AS place FROM t QUALIFY place <= 25
"""

_ALL = (keyword_rows, keyword_totals, rank_todos)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
