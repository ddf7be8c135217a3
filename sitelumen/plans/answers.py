"""Search answers: JSON that Spark writes of what suppliers sold, some of it broken, read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitelumen.operators.store import settle
from sitelumen.sources import answers as A


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body): for each supplier an answer with the parts that it sold most of, up to twelve; some are cut off, or of another shape."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q")).withColumn("n", F.row_number().over(W.Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey"))).where("n <= 12")
    rows = sold.join(part, F.col("l_partkey") == F.col("p_partkey"))
    one = F.struct("n", F.struct(F.concat(F.lit("https://shop.example.com/"), "p_partkey").alias("link"), F.col("p_name").alias("title"), F.when(F.col("n") % 3 != 0, F.col("n")).alias("position")).alias("r"), F.struct(F.when(F.col("n") % 4 != 0, F.col("p_type")).alias("query")).alias("s"), F.struct(F.concat(F.lit("what is "), "p_name", F.lit("?")).alias("question")).alias("p"))
    lists = rows.groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("l"))  # twelve a supplier
    take = lambda field, n: F.transform(F.slice("l", 1, n), lambda x: x[field])
    whole = F.to_json(F.struct(take("r", 12).alias("organic"), take("s", 4).alias("relatedSearches"), take("p", 3).alias("peopleAlsoAsk"), F.when(F.col("id") % 2 == 0, F.struct(F.lit("said").alias("text"))).alias("aiOverview")))
    k = F.col("id")
    body = F.when(k % 11 == 0, F.substring(whole, 1, 40)).when(k % 13 == 0, '{"organic": {"link": "x"}}').when(k % 17 == 0, "[1, 2]").when(k % 19 == 0, "").otherwise(whole)
    return lists.select("id", body.alias("body"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.parsed(settle(_answers(spark, sf_dir)))


def answer_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.organic(_parsed(spark, sf_dir))


def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.asked(_parsed(spark, sf_dir))


def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by outcome, and those with an overview."""
    return A.overviews(_parsed(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("answers"), F.count_if("ai_overview").alias("overviews"))


_SOLD = """
s AS (SELECT l_suppkey AS id, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q DESC, l_partkey) AS n FROM s QUALIFY n <= 12), r AS (SELECT * FROM n JOIN part ON p_partkey = l_partkey),
o AS (SELECT DISTINCT id, CASE WHEN id % 11 = 0 THEN 'broken' WHEN id % 13 = 0 OR id % 17 = 0 THEN 'wrong shape' WHEN id % 19 = 0 THEN 'no answer' ELSE 'ok' END AS outcome FROM s)
"""
ANSWER_RESULTS = f"WITH {_SOLD} SELECT id, CAST(n AS INTEGER) AS position, 'https://shop.example.com/' || p_partkey AS link, p_name AS title FROM r JOIN o USING (id) WHERE outcome = 'ok' AND n <= 10"
ANSWER_QUESTIONS = f"""WITH {_SOLD} SELECT id, 'related' AS kind, CAST(n - 1 AS INTEGER) AS ord, p_type AS text FROM r JOIN o USING (id) WHERE outcome = 'ok' AND n <= 4 AND n % 4 <> 0
UNION ALL SELECT id, 'question', CAST(n - 1 AS INTEGER), 'what is ' || p_name || '?' FROM r JOIN o USING (id) WHERE outcome = 'ok' AND n <= 3"""
ANSWER_OUTCOMES = f"WITH {_SOLD} SELECT outcome, count(*) AS answers, count(*) FILTER (outcome = 'ok' AND id % 2 = 0) AS overviews FROM o GROUP BY outcome"

_ALL = (answer_results, answer_questions, answer_outcomes)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
