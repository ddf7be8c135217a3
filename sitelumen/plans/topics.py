"""Topics and keyword clusters: scores, tiers, plans of action."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitelumen.functions import scoring as S
from sitelumen.functions import text as T
from sitelumen.plans import search

#: Scores of trend and difficulty, weights of a topic's parts, cuts of its priority.
TREND_SCORE = {"rising": 1.0, "new": 0.7, "flat": 0.5, "falling": 0.2}
DIFFICULTY_SCORE = {"easy win": 1.0, "medium": 0.6, "hard": 0.25}
WEIGHTS, NO_VOLUME, SEED_PENALTY, CUTS = (0.4, 0.35, 0.25), 0.3, 0.08, (0.62, 0.45)
#: Factors of a cluster's coverage.
COVERAGE = {"gap": 1.0, "weak": 0.6, "ranking": 0.25}
BUYERS = ("transactional", "commercial", "local")


def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query as a topic: volume, trend, difficulty by its weak pages, score and priority."""
    rows = search.account(spark, sf_dir, "b")
    of = lambda p: F.coalesce(F.sum(F.when(F.col("period") == p, F.col("impressions"))), F.lit(0))
    weak = F.sum(((F.col("period") == "current") & (F.col("position") > 25)).cast("int"))
    each = rows.groupBy("query").agg(of("current").alias("volume"), of("previous").alias("before"), weak.alias("weak"))
    top = each.agg(F.max("volume").alias("top"))
    each = each.join(F.broadcast(top)).withColumns({"trend": S.trend(F.col("volume"), F.col("before")), "difficulty": F.when(F.col("weak") >= 3, "easy win").when(F.col("weak") >= 1, "medium").otherwise("hard")})  # one row
    share = F.when(F.col("top") > 0, F.col("volume") / F.col("top")).otherwise(NO_VOLUME)
    seed = F.col("query").startswith("red")
    score = WEIGHTS[0] * S.lookup(F.col("difficulty"), DIFFICULTY_SCORE, 0.5) + WEIGHTS[1] * S.lookup(F.col("trend"), TREND_SCORE) + WEIGHTS[2] * share - F.when(seed, SEED_PENALTY).otherwise(0.0)
    rated = each.withColumn("score", F.round(score, 6))
    return rated.select("query", "volume", "trend", "difficulty", "score", F.when(F.col("score") >= CUTS[0], "high").when(F.col("score") >= CUTS[1], "medium").otherwise("low").alias("priority"))


TOPIC_SCORES = f"""
WITH {search._oracle('b')}, t AS (SELECT query, CAST(coalesce(sum(impressions) FILTER (period = 'current'), 0) AS BIGINT) AS volume, CAST(coalesce(sum(impressions) FILTER (period = 'previous'), 0) AS BIGINT) AS before, count(*) FILTER (period = 'current' AND position > 25) AS weak FROM g GROUP BY query),
k AS (SELECT *, CASE WHEN volume = 0 THEN 'flat' WHEN before = 0 THEN 'new' WHEN volume >= 1.2::DOUBLE * before THEN 'rising' WHEN volume <= 0.8::DOUBLE * before THEN 'falling' ELSE 'flat' END AS trend, CASE WHEN weak >= 3 THEN 'easy win' WHEN weak >= 1 THEN 'medium' ELSE 'hard' END AS difficulty, max(volume) OVER () AS top FROM t),
s AS (SELECT *, round(0.4::DOUBLE * CASE difficulty WHEN 'easy win' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.25 END + 0.35::DOUBLE * CASE trend WHEN 'rising' THEN 1.0 WHEN 'new' THEN 0.7 WHEN 'flat' THEN 0.5 ELSE 0.2 END + 0.25::DOUBLE * (CASE WHEN top > 0 THEN volume / top ELSE 0.3::DOUBLE END) - CASE WHEN starts_with(query, 'red') THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM k)
SELECT query, volume, trend, difficulty, score, CASE WHEN score >= 0.62::DOUBLE THEN 'high' WHEN score >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END AS priority FROM s
"""


def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by the first word of their keywords: volume, best place, coverage, opportunity, tier."""
    rows = search._now(search.account(spark, sf_dir, "b"))
    each = rows.groupBy(F.regexp_extract("query", r"^(\S+)", 1).alias("cluster")).agg(F.count_distinct("query").alias("keywords"), F.sum("impressions").alias("volume"), F.min("position").alias("best"))
    coverage = F.when(F.col("best") > 20, "gap").when(F.col("best") > 8, "weak").otherwise("ranking")
    rated = each.withColumns({"coverage": coverage, "intent": T.intent(F.col("cluster"))})
    tier = F.when(F.col("coverage") == "ranking", "watch").when(F.col("intent").isin(*BUYERS), "high").otherwise("medium")
    return rated.select("cluster", "keywords", "volume", F.round("best", 4).alias("best"), "coverage", "intent", F.round(F.when(F.col("volume") == 0, 10).otherwise(F.col("volume")) * S.lookup(F.col("coverage"), COVERAGE), 4).alias("opportunity"), tier.alias("tier"))


CLUSTER_SCORES = f"""
WITH {search._oracle('b')}, e AS (SELECT regexp_extract(query, '^(\\S+)', 1) AS cluster, count(DISTINCT query) AS keywords, CAST(sum(impressions) AS BIGINT) AS volume, min(position) AS best FROM c GROUP BY 1),
k AS (SELECT *, CASE WHEN best > 20 THEN 'gap' WHEN best > 8 THEN 'weak' ELSE 'ranking' END AS coverage, concat(' ', lower(cluster), ' ') AS pad FROM e), i AS (SELECT *, {search._INTENT} AS intent FROM k)
SELECT cluster, keywords, volume, round(best, 4) AS best, coverage, intent, round(CASE WHEN volume = 0 THEN 10 ELSE volume END * CAST(CASE coverage WHEN 'gap' THEN 1.0 WHEN 'weak' THEN 0.6 ELSE 0.25 END AS DOUBLE), 4) AS opportunity, CASE WHEN coverage = 'ranking' THEN 'watch' WHEN intent IN ('transactional', 'commercial', 'local') THEN 'high' ELSE 'medium' END AS tier FROM i
"""


def todo_list(spark: SparkSession, sf_dir: str, most: int = search.TODOS) -> DataFrame:
    """The to-dos of all kinds with the largest estimates."""
    striking = search.todos_striking(spark, sf_dir).select(F.lit("striking").alias("kind"), "query", "page", "estimate")
    gap = search.todos_ctr_gap(spark, sf_dir).select(F.lit("ctr_gap").alias("kind"), "query", "page", F.greatest(F.lit(1), F.bround("gain").cast("int")).alias("estimate"))
    decay = search.todos_decay(spark, sf_dir).select(F.lit("decay").alias("kind"), "query", "page", "estimate")
    return striking.unionByName(gap).unionByName(decay).orderBy(F.desc("estimate"), "kind", "query", "page").limit(most)


TODO_LIST = f"""
WITH s AS ({search.TODOS_STRIKING}), g AS ({search.TODOS_CTR_GAP}), d AS ({search.TODOS_DECAY})
SELECT * FROM (SELECT 'striking' AS kind, query, page, estimate FROM s UNION ALL SELECT 'ctr_gap', query, page, greatest(1, CAST(round_even(gain, 0) AS INTEGER)) FROM g UNION ALL SELECT 'decay', query, page, estimate FROM d) ORDER BY estimate DESC, kind, query, page LIMIT 25
"""


def link_candidates(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """For each cluster, the pages with the most clicks from queries that share a word with its name."""
    rows = search._now(search.account(spark, sf_dir, "b")).withColumn("token", F.explode(T.loose_tokens(F.col("query"))))
    clusters = rows.select(F.col("token").alias("cluster")).distinct()
    each = clusters.join(rows, F.col("cluster") == F.col("token")).groupBy("cluster", "page").agg(F.sum("clicks").alias("clicks"))
    place = F.row_number().over(W.Window.partitionBy("cluster").orderBy(F.desc("clicks"), "page"))
    return each.withColumn("place", place).where(F.col("place") <= most)


LINK_CANDIDATES = f"""
WITH {search._oracle('b')}, t AS (SELECT DISTINCT query, page, clicks, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({search._LOOSE}))) AS cluster FROM c)
SELECT cluster, page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(row_number() OVER (PARTITION BY cluster ORDER BY sum(clicks) DESC, page) AS INTEGER) AS place FROM t GROUP BY cluster, page QUALIFY place <= 3
"""

_ALL = (topic_scores, cluster_scores, todo_list, link_candidates)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
