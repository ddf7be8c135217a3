"""Analyses of search performance rows: query, page, clicks, impressions, position, by period.

The driver's order lines stand for two such accounts: in the first, queries are part types and pages are suppliers; in
the second, queries are part names and pages are part types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitelumen.functions import scoring as S
from sitelumen.functions import text as T
from sitelumen.operators import containment

LEAST_IMPRESSIONS, LEAST_GAIN, TODOS = 100, 5, 25
LEAST_SPLIT_IMPRESSIONS, LEAST_SPLIT_SHARE, CLOSE_POSITIONS = 50, 0.10, 5
THIN_IMPRESSIONS = 30

ACCOUNTS = {
    "a": ("concat(lower(p_type), ' parts')", "concat('https://shop.example.com/s/', CAST(l_suppkey AS {string}))"),
    "b": ("p_name", "concat('https://shop.example.com/', lower(p_type))"),
}


def account_sql(name: str, string: str = "STRING") -> str:
    """The rows of an account in two periods of 365 days, in SQL that Spark and DuckDB share."""
    query, page = ACCOUNTS[name]
    page = page.format(string=string)
    return f"""
    SELECT period, query, page, CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linenumber <= 3 THEN l_linenumber ELSE 0 END) AS BIGINT) AS clicks,
      CAST(sum(l_quantity) AS BIGINT) AS impressions, 1 + (CAST(sum(l_orderkey) AS BIGINT) % 350) / CAST(10.0 AS DOUBLE) AS position
    FROM (SELECT *, {query} AS query, {page} AS page, CASE WHEN l_shipdate >= TIMESTAMP '2000-11-05 00:00:00' THEN 'current' ELSE 'previous' END AS period
          FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1999-11-06 00:00:00' AND l_shipdate <= TIMESTAMP '2001-11-04 00:00:00') AS x
    GROUP BY period, query, page
    """


def account(spark: SparkSession, sf_dir: str, name: str = "a") -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")}
    return spark.sql(account_sql(name).replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"), **tables)


def _oracle(name: str) -> str:
    return f"g AS ({account_sql(name, 'VARCHAR')}), c AS (SELECT * FROM g WHERE period = 'current'), v AS (SELECT * FROM g WHERE period = 'previous')"


def _now(rows: DataFrame) -> DataFrame:
    return rows.where("period = 'current'")


def _ctr_sql(position: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in S.CTR.items())
    return f"CAST(CASE CAST(round_even(greatest({position}, 1.0), 0) AS INTEGER) {cases} ELSE {S.CTR_BEYOND} END AS DOUBLE)"


def ctr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and real clicks by rounded position."""
    rows = _now(account(spark, sf_dir))
    return rows.groupBy(F.bround("position").cast("int").alias("rank")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.round(F.sum(F.col("impressions") * S.ctr_at(F.col("position"))), 4).alias("expected"))


CTR_CURVE = f"WITH {_oracle('a')} SELECT CAST(round_even(position, 0) AS INTEGER) AS rank, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round(sum(impressions * {_ctr_sql('position')}), 4) AS expected FROM c GROUP BY 1"


def account_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and impression-weighted position of each period."""
    return account(spark, sf_dir).groupBy("period").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.count_distinct("query").alias("queries"), F.count_distinct("page").alias("pages"), F.round(F.coalesce(F.try_divide(F.sum(F.col("position") * F.col("impressions")), F.sum("impressions")), F.lit(0.0)), 6).alias("position"))


ACCOUNT_SUMMARY = f"WITH {_oracle('a')} SELECT period, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, count(DISTINCT query) AS queries, count(DISTINCT page) AS pages, round(sum(position * impressions) / sum(impressions), 6) AS position FROM g GROUP BY period"


def top_query_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query with the most impressions of each page; the first by name of equal ones."""
    best = F.min_by("query", F.struct(-F.col("impressions"), "query"))
    return _now(account(spark, sf_dir)).groupBy("page").agg(best.alias("query"), F.max("impressions").alias("impressions"))


TOP_QUERY_PER_PAGE = f"WITH {_oracle('a')} SELECT page, query, impressions FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY impressions DESC, query) = 1"


def confirmed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that two pages compete for: the runner-up has a tenth of the impressions, and both lie close or not."""
    ranked = W.Window.partitionBy("query").orderBy(F.desc("impressions"), "page")
    rows = _now(account(spark, sf_dir, "b")).withColumn("r", F.row_number().over(ranked))
    of = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    each = rows.groupBy("query").agg(F.sum("impressions").alias("total"), F.count(F.lit(1)).alias("pages"), of("page", 1).alias("first"), of("page", 2).alias("second"), of("impressions", 2).alias("i2"), of("position", 1).alias("p1"), of("position", 2).alias("p2"))
    kept = each.where((F.col("total") >= LEAST_SPLIT_IMPRESSIONS) & (F.col("pages") >= 2) & (F.col("i2") >= LEAST_SPLIT_SHARE * F.col("total")))
    return kept.select("query", "total", "pages", "first", "second", F.when(F.abs(F.col("p1") - F.col("p2")) < CLOSE_POSITIONS, "high").otherwise("medium").alias("severity"))


CONFIRMED_SPLIT = f"""
WITH {_oracle('b')}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page) AS r FROM c),
e AS (SELECT query, CAST(sum(impressions) AS BIGINT) AS total, count(*) AS pages, max(page) FILTER (r = 1) AS first, max(page) FILTER (r = 2) AS second, max(impressions) FILTER (r = 2) AS i2, max(position) FILTER (r = 1) AS p1, max(position) FILTER (r = 2) AS p2 FROM r GROUP BY query)
SELECT query, total, pages, first, second, CASE WHEN abs(p1 - p2) < 5 THEN 'high' ELSE 'medium' END AS severity FROM e WHERE total >= 50 AND pages >= 2 AND i2 >= 0.10 * total
"""


def _todo_id(kind: str, *parts: str) -> F.Column:
    return T.short_hash(F.lit(kind), *(F.col(p) for p in parts))


def _striking(rows: DataFrame) -> DataFrame:
    near = rows.where((F.col("impressions") >= LEAST_IMPRESSIONS) & F.col("position").between(4, 15))
    target = F.greatest(F.lit(3.0), F.bround("position") - 3)
    return near.withColumn("gain", F.col("impressions") * (S.ctr_at(target) - S.ctr_at(F.col("position")))).where(F.col("gain") >= LEAST_GAIN)


def todos_striking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries just off the first places, with the clicks to be won by three places."""
    return _striking(_now(account(spark, sf_dir))).select(_todo_id("striking", "query", "page").alias("todo_id"), "query", "page", F.greatest(F.lit(1), F.bround("gain").cast("int")).alias("estimate"))


_STRIKING = f"""SELECT *, impressions * ({_ctr_sql('greatest(3.0, round_even(position, 0) - 3)')} - {_ctr_sql('position')}) AS gain FROM c WHERE impressions >= 100 AND position BETWEEN 4 AND 15"""
TODOS_STRIKING = f"WITH {_oracle('a')} SELECT left(sha1(concat_ws('|', 'striking', query, page)), 12) AS todo_id, query, page, greatest(1, CAST(round_even(gain, 0) AS INTEGER)) AS estimate FROM ({_STRIKING}) WHERE gain >= 5"


def todos_ctr_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in the first places that are clicked half as often as usual there."""
    ctr = F.col("clicks") / F.col("impressions")
    usual = S.ctr_at(F.col("position"))
    rows = _now(account(spark, sf_dir)).where((F.col("impressions") >= LEAST_IMPRESSIONS) & (F.col("position") < 4) & (ctr < 0.5 * usual))
    gain = F.col("impressions") * (0.8 * usual - ctr)
    return rows.withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN).select(_todo_id("ctr_gap", "query", "page").alias("todo_id"), "query", "page", F.round("gain", 4).alias("gain"))


TODOS_CTR_GAP = f"WITH {_oracle('a')}, x AS (SELECT *, impressions * (0.8::DOUBLE * {_ctr_sql('position')} - clicks / impressions) AS gain FROM c WHERE impressions >= 100 AND position < 4 AND clicks / impressions < 0.5::DOUBLE * {_ctr_sql('position')}) SELECT left(sha1(concat_ws('|', 'ctr_gap', query, page)), 12) AS todo_id, query, page, round(gain, 4) AS gain FROM x WHERE gain >= 5"


def todos_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that had 30 clicks and lost three tenths of them, with their most seen query."""
    rows = account(spark, sf_dir)
    was = rows.where("period = 'previous'").groupBy("page").agg(F.sum("clicks").alias("was"))
    now = _now(rows).groupBy("page").agg(F.sum("clicks").alias("now"), F.min_by("query", F.struct(-F.col("impressions"), "query")).alias("query"))
    lost = was.where("was >= 30").join(now, "page", "left").withColumn("now", F.coalesce("now", F.lit(0))).where(F.col("now") < 0.7 * F.col("was"))
    return lost.select("page", F.coalesce("query", F.lit("(overall)")).alias("query"), "was", "now", F.greatest(F.lit(1), F.bround(0.7 * (F.col("was") - F.col("now"))).cast("int")).alias("estimate"))


TODOS_DECAY = f"""
WITH {_oracle('a')}, w AS (SELECT page, CAST(sum(clicks) AS BIGINT) AS was FROM v GROUP BY page), n AS (SELECT page, CAST(sum(clicks) AS BIGINT) AS now, min_by(query, (-impressions, query)) AS query FROM c GROUP BY page)
SELECT w.page, coalesce(query, '(overall)') AS query, was, coalesce(now, 0) AS now, greatest(1, CAST(round_even(0.7::DOUBLE * (was - coalesce(now, 0)), 0) AS INTEGER)) AS estimate FROM w LEFT JOIN n USING (page) WHERE was >= 30 AND coalesce(now, 0) < 0.7::DOUBLE * was
"""


def keyword_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a keyword over search rows and planned ones: metrics, sources, band, opportunity."""
    seen = _now(account(spark, sf_dir)).unionByName(_now(account(spark, sf_dir, "b")))
    best = seen.groupBy(F.lower("query").alias("keyword")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.min_by("position", F.struct(-F.col("impressions"), "page")).alias("position"))
    planned = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("keyword")).distinct()
    rows = best.withColumn("seen", F.lit(True)).join(planned.withColumn("planned", F.lit(True)), "keyword", "full")
    rows = rows.select("keyword", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("clicks", "impressions", "position")), F.concat_ws(",", F.when(F.col("seen"), "search"), F.when(F.col("planned"), "plan")).alias("sources"))
    return rows.select("keyword", "clicks", "impressions", F.round("position", 4).alias("position"), "sources", S.band(F.col("position")).alias("band"), (F.col("impressions") < THIN_IMPRESSIONS).alias("thin"), T.intent(F.col("keyword")).alias("intent"), S.opportunity(F.col("impressions"), F.col("clicks"), F.col("position")).alias("opportunity"))


def _any(text: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")"


_INTENT = f"CASE WHEN {_any('pad', T.LOCAL)} THEN 'local' WHEN {_any('pad', T.TRANSACTIONAL)} THEN 'transactional' WHEN {_any('pad', T.COMMERCIAL)} THEN 'commercial' ELSE 'informational' END"
_TARGET = "CASE WHEN position <= 10 THEN 3.0 ELSE 8.0 END"
KEYWORD_POOL = f"""
WITH ga AS ({account_sql('a', 'VARCHAR')}), gb AS ({account_sql('b', 'VARCHAR')}), s AS (SELECT * FROM ga WHERE period = 'current' UNION ALL SELECT * FROM gb WHERE period = 'current'),
b AS (SELECT lower(query) AS keyword, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, min_by(position, (-impressions, page)) AS position, true AS seen FROM s GROUP BY 1),
p AS (SELECT DISTINCT lower(concat_ws(' ', p_name, p_type)) AS keyword, true AS planned FROM part),
r AS (SELECT keyword, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, coalesce(position, 0.0::DOUBLE) AS position, concat_ws(',', CASE WHEN seen THEN 'search' END, CASE WHEN planned THEN 'plan' END) AS sources, concat(' ', keyword, ' ') AS pad FROM b FULL JOIN p USING (keyword))
SELECT keyword, clicks, impressions, round(position, 4) AS position, sources, CASE WHEN position <= 0 THEN 'unranked' WHEN position <= 3 THEN 'top3' WHEN position <= 10 THEN 'page1' WHEN position <= 20 THEN 'page2' ELSE 'beyond' END AS band, impressions < 30 AS thin, {_INTENT} AS intent,
  CASE WHEN impressions <= 0 OR position <= 0 OR position > 30 OR position <= {_TARGET} THEN 0 ELSE greatest(0, CAST(round_even(({_ctr_sql(_TARGET)} - {_ctr_sql('position')}) * impressions - greatest(0.0::DOUBLE, clicks - impressions * {_ctr_sql('position')}), 0) AS BIGINT)) END AS opportunity
FROM r
"""


def pool_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's keywords by band, empty bands too."""
    counts = keyword_pool(spark, sf_dir).groupBy("band").agg(F.count(F.lit(1)).alias("keywords"), F.sum("opportunity").alias("opportunity"))
    bands = spark.createDataFrame([(b,) for b in ("unranked", "top3", "page1", "page2", "beyond")], "band string")
    return bands.join(counts, "band", "left").select("band", F.coalesce("keywords", F.lit(0)).alias("keywords"), F.coalesce("opportunity", F.lit(0)).alias("opportunity"))


POOL_BANDS = f"WITH k AS ({KEYWORD_POOL}) SELECT band, count(keyword) AS keywords, CAST(coalesce(sum(opportunity), 0) AS BIGINT) AS opportunity FROM (VALUES ('unranked'), ('top3'), ('page1'), ('page2'), ('beyond')) AS x(band) LEFT JOIN k USING (band) GROUP BY band"


def page_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by path over three sources: a crawl, visits and search rows; absent numbers are 0, absent names null."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    crawl = suppliers.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("/s/"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").alias("title"))
    visits = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.concat(F.lit("/s/"), F.col("user_id").cast("string")).alias("path")).agg(F.count(F.lit(1)).alias("views"), F.count_distinct("event_type").alias("sessions"))
    path = F.regexp_extract("page", r"^https?://[^/]*(/.*)$", 1)
    found = _now(account(spark, sf_dir)).groupBy(path.alias("path")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.min_by("query", F.struct(-F.col("clicks"), -F.col("impressions"), "query")).alias("best_query"))
    rows = crawl.withColumn("crawled", F.lit(True)).join(visits, "path", "full").join(found, "path", "full")
    return rows.select("path", "title", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("views", "sessions", "clicks", "impressions")), "best_query", F.when(F.col("crawled"), "").otherwise("not-crawled").alias("flag"))


PAGE_INTEL = f"""
WITH {_oracle('a')}, w AS (SELECT '/s/' || CAST(s_suppkey AS VARCHAR) AS path, s_name AS title, true AS crawled FROM supplier WHERE s_suppkey % 3 <> 0),
e AS (SELECT '/s/' || CAST(user_id AS VARCHAR) AS path, count(*) AS views, count(DISTINCT event_type) AS sessions FROM events GROUP BY 1),
f AS (SELECT regexp_extract(page, '^https?://[^/]*(/.*)$', 1) AS path, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, min_by(query, (-clicks, -impressions, query)) AS best_query FROM c GROUP BY 1)
SELECT path, title, coalesce(views, 0) AS views, coalesce(sessions, 0) AS sessions, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, best_query, CASE WHEN crawled THEN '' ELSE 'not-crawled' END AS flag FROM w FULL JOIN e USING (path) FULL JOIN f USING (path)
"""


def token_match_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions that match each candidate phrase: one's tokens are all among the other's.

    Each side meets the other by its rarest token; no row of one side meets all of the other.
    """
    rows = _now(account(spark, sf_dir, "b")).groupBy("query").agg(F.sum("impressions").alias("impressions"))
    candidates = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("phrase")).distinct()
    of = lambda rows, key, set_: rows.select(F.col(key), T.loose_tokens(F.col(key)).alias(set_))
    narrow = containment.holders(of(candidates.withColumnRenamed("phrase", "i"), "i", "a"), of(rows.withColumnRenamed("query", "j"), "j", "b")).select(F.col("i").alias("phrase"), F.col("j").alias("query"))
    wide = containment.holders(of(rows.withColumnRenamed("query", "i"), "i", "a"), of(candidates.withColumnRenamed("phrase", "j"), "j", "b")).select(F.col("j").alias("phrase"), F.col("i").alias("query"))
    total = narrow.unionByName(wide).distinct().join(rows, "query").groupBy("phrase").agg(F.sum("impressions").alias("volume"))
    return candidates.join(total, "phrase", "left").select("phrase", F.coalesce("volume", F.lit(0)).alias("volume"))


_LOOSE = ", ".join(f"'{w}'" for w in T.LOOSE_STOP)
TOKEN_MATCH_VOLUME = f"""
WITH {_oracle('b')}, q AS (SELECT query, CAST(sum(impressions) AS BIGINT) AS impressions, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_LOOSE}))) AS t FROM c GROUP BY query),
k AS (SELECT DISTINCT concat_ws(' ', p_name, lower(p_type)) AS phrase FROM part), p AS (SELECT phrase, list_distinct(list_filter(regexp_split_to_array(lower(phrase), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_LOOSE}))) AS t FROM k)
SELECT phrase, CAST(coalesce(sum(impressions) FILTER (len(p.t) > 0 AND len(q.t) > 0 AND (list_has_all(q.t, p.t) OR list_has_all(p.t, q.t))), 0) AS BIGINT) AS volume FROM p CROSS JOIN q GROUP BY phrase
"""


def keyword_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's impressions in both periods, its trend and what kind of article would answer it."""
    of = lambda p: F.coalesce(F.sum(F.when(F.col("period") == p, F.col("impressions"))), F.lit(0))
    rows = account(spark, sf_dir, "b").groupBy("query").agg(of("current").alias("now"), of("previous").alias("before"))
    return rows.select("query", "now", "before", S.trend(F.col("now"), F.col("before")).alias("trend"), T.angle(F.col("query")).alias("angle"))


KEYWORD_TRENDS = f"""
WITH {_oracle('b')}, t AS (SELECT query, CAST(coalesce(sum(impressions) FILTER (period = 'current'), 0) AS BIGINT) AS now, CAST(coalesce(sum(impressions) FILTER (period = 'previous'), 0) AS BIGINT) AS before FROM g GROUP BY query)
SELECT query, now, before, CASE WHEN now = 0 THEN 'flat' WHEN before = 0 THEN 'new' WHEN now >= 1.2::DOUBLE * before THEN 'rising' WHEN now <= 0.8::DOUBLE * before THEN 'falling' ELSE 'flat' END AS trend,
  CASE WHEN {' OR '.join(f"starts_with(lower(query), '{m}')" for m in T.QUESTION)} OR lower(query) LIKE '%?' THEN 'FAQ answer' WHEN contains(' ' || lower(query) || ' ', ' vs ') OR contains(lower(query), 'best ') THEN 'comparison' WHEN regexp_matches(lower(query), 'cost|price|pricing|salary|rates') THEN 'pricing guide' ELSE 'how-to guide' END AS angle FROM t
"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank snapshots: each month, order priorities by their number of orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"), F.col("o_orderpriority").alias("keyword")).agg(F.count(F.lit(1)).alias("n"))
    return orders.withColumn("position", F.row_number().over(W.Window.partitionBy("snapshot").orderBy(F.desc("n"), "keyword")))


_RANKS = "r AS (SELECT strftime(o_orderdate, '%Y-%m') AS snapshot, o_orderpriority AS keyword, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY count(*) DESC, o_orderpriority) AS position FROM orders GROUP BY 1, 2)"


def rank_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyword's places won since the snapshot before; null if it wasn't in that one."""
    ranks = _ranks(spark, sf_dir)
    order = ranks.select("snapshot").distinct().withColumn("before", F.lag("snapshot").over(W.Window.partitionBy(F.lit(0)).orderBy("snapshot")))  # a row a snapshot
    was = ranks.select(F.col("snapshot").alias("before"), "keyword", F.col("position").alias("was"))
    return ranks.join(order, "snapshot").join(was, ["before", "keyword"], "left").select("snapshot", "keyword", "position", (F.col("was") - F.col("position")).alias("shift"))


RANK_SHIFTS = f"WITH {_RANKS}, o AS (SELECT snapshot, lag(snapshot) OVER (ORDER BY snapshot) AS before FROM (SELECT DISTINCT snapshot FROM r)) SELECT r.snapshot, r.keyword, CAST(r.position AS INTEGER) AS position, CAST(w.position - r.position AS INTEGER) AS shift FROM r JOIN o USING (snapshot) LEFT JOIN r w ON w.snapshot = o.before AND w.keyword = r.keyword"


def rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot's keywords in the first places, and those that moved."""
    return rank_shifts(spark, sf_dir).groupBy("snapshot").agg(F.count(F.lit(1)).alias("tracked"), F.sum((F.col("position") <= 3).cast("long")).alias("top3"), F.coalesce(F.sum((F.col("shift") > 0).cast("long")), F.lit(0)).alias("up"), F.coalesce(F.sum((F.col("shift") < 0).cast("long")), F.lit(0)).alias("down"), F.round(F.avg("position"), 6).alias("average"))


RANK_SUMMARY = f"WITH s AS ({RANK_SHIFTS}) SELECT snapshot, count(*) AS tracked, CAST(count(*) FILTER (position <= 3) AS BIGINT) AS top3, CAST(count(*) FILTER (shift > 0) AS BIGINT) AS up, CAST(count(*) FILTER (shift < 0) AS BIGINT) AS down, round(avg(position), 6) AS average FROM s GROUP BY snapshot"


def rank_history(spark: SparkSession, sf_dir: str, keep: int = 12) -> DataFrame:
    """The last ``keep`` snapshots of each keyword."""
    newest = W.Window.partitionBy("keyword").orderBy(F.desc("snapshot"))
    return _ranks(spark, sf_dir).withColumn("age", F.row_number().over(newest)).where(F.col("age") <= keep).select("keyword", "snapshot", "position", "age")


RANK_HISTORY = f"WITH {_RANKS} SELECT keyword, snapshot, CAST(position AS INTEGER) AS position, CAST(row_number() OVER (PARTITION BY keyword ORDER BY snapshot DESC) AS INTEGER) AS age FROM r QUALIFY age <= 12"


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a competitor: the share of queries in whose first five pages it appears, and its mean place there."""
    rows = _now(account(spark, sf_dir, "b")).withColumn("place", F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("impressions"), "page"))).where("place <= 5")
    tracked = rows.agg(F.count_distinct("query").alias("tracked"))
    each = rows.groupBy("page").agg(F.count(F.lit(1)).alias("appearances"), F.round(F.avg("place"), 6).alias("average"))
    return each.join(F.broadcast(tracked)).select("page", "appearances", "average", F.bround(100.0 * F.col("appearances") / F.col("tracked")).cast("int").alias("visibility"))  # one row


VISIBILITY = f"WITH {_oracle('b')}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page) AS place FROM c QUALIFY place <= 5) SELECT page, count(*) AS appearances, round(avg(place), 6) AS average, CAST(round_even(100.0::DOUBLE * count(*) / (SELECT count(DISTINCT query) FROM r), 0) AS INTEGER) AS visibility FROM r GROUP BY page"


def ga_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of each channel in two periods of 15 days, side by side."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("period", F.when(F.col("ts") >= F.lit("2024-01-16").cast("timestamp"), "current").otherwise("previous"))
    rows = events.groupBy(F.col("event_type").alias("channel")).pivot("period", ["current", "previous"]).agg(F.count(F.lit(1)))
    return rows.select("channel", F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("previous", F.lit(0)).alias("previous"))


GA_PIVOT = "SELECT event_type AS channel, CAST(count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS BIGINT) AS current, CAST(count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS BIGINT) AS previous FROM events GROUP BY 1"

def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and types as targets: ordered pairs of different targets of which one contains the other."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    phrases = part.select(F.explode(F.array(F.col("p_name"), F.concat_ws(" ", "p_name", F.lower("p_type")))).alias("page")).distinct()
    return containment.contained(phrases.withColumn("tokens", T.tokens(F.col("page"), keep_numbers=True))).select("i", "j", "n_i", "n_j", "shared")


_STOPPED = ", ".join(f"'{w}'" for w in (*T.STOP, *T.MARKETING))
CONTAINMENT_PAIRS = f"""
WITH f AS (SELECT DISTINCT unnest([p_name, concat_ws(' ', p_name, lower(p_type))]) AS page FROM part),
w AS (SELECT page, unnest(regexp_extract_all(lower(translate(page, '_-', '  ')), '[a-z0-9]+')) AS w FROM f),
t AS (SELECT DISTINCT page, CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(sses|ches|shes|xes|zes)$') THEN left(w, -2) WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|ys)$') THEN left(w, -1) ELSE w END AS token FROM w WHERE w NOT IN ({_STOPPED}) AND NOT regexp_full_match(w, '[0-9]+')),
n AS (SELECT page, count(*) AS n FROM t GROUP BY page)
SELECT x.page AS i, y.page AS j, CAST(any_value(a.n) AS INTEGER) AS n_i, CAST(any_value(b.n) AS INTEGER) AS n_j, count(*) AS shared FROM t x JOIN t y ON x.token = y.token AND x.page <> y.page JOIN n a ON a.page = x.page JOIN n b ON b.page = y.page
WHERE a.n >= 2 GROUP BY x.page, y.page HAVING count(*) >= any_value(a.n) - CASE WHEN any_value(a.n) >= 7 THEN 1 ELSE 0 END
"""

_ALL = (ctr_curve, account_summary, top_query_per_page, confirmed_split, todos_striking, todos_ctr_gap, todos_decay, keyword_pool, pool_bands, page_intel, token_match_volume, keyword_trends, containment_pairs, rank_shifts, rank_summary, rank_history, visibility, ga_pivot)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
