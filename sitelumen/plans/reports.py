"""Reports on speed, vitals, competitors, drafts and channels. The driver's tables stand for measurements and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitelumen.functions import rules as R
from sitelumen.functions import scoring as S
from sitelumen.functions import text as T
from sitelumen.functions import url as U
from sitelumen.plans import site

#: How many of the largest a report shows.
HOSTS, MOVERS, ELEMENTS, HEAVIEST, THEMES, DOMAINS = 12, 8, 10, 8, 12, 8
_MEASURED = ("signup", "click", "purchase", "error", "view")  # stand for the vitals, in their order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vitals_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, measures, good_core, assessment): each page's Core Web Vitals by the p75 of its measurements.

    A page passes if all three core measures are known and good; one that lacks any has insufficient data.
    """
    scale = F.create_map(*(F.lit(x) for e, (good, _) in zip(_MEASURED, S.VITALS.values(), strict=True) for x in (e, good / 60)))
    rows = _table(spark, sf_dir, "events").withColumn("v", F.col("value") * scale[F.col("event_type")])
    each = rows.groupBy(F.col("user_id").alias("page"), "event_type").agg(F.round(F.percentile("v", 0.75), 4).alias("p75"), F.count(F.lit(1)).alias("n")).where("n >= 8")
    limit = lambda k: F.create_map(*(F.lit(x) for e, t in zip(_MEASURED, S.VITALS.values(), strict=True) for x in (e, float(t[k]))))[F.col("event_type")]
    core = F.col("event_type").isin(*_MEASURED[: len(S.CORE_VITALS)])
    rated = each.withColumn("rating", F.when(F.col("p75") <= limit(0), "good").when(F.col("p75") <= limit(1), "fair").otherwise("poor"))
    of = lambda cond: F.count_if(core & cond)
    pages = rated.groupBy("page").agg(F.count(F.lit(1)).alias("measures"), of(F.lit(True)).alias("known"), of(F.col("rating") == "good").alias("good_core"), of(F.col("rating") == "poor").alias("poor_core"))
    n = len(S.CORE_VITALS)
    assessment = F.when(F.col("known") < n, "insufficient-data").when(F.col("good_core") == n, "passing").when(F.col("poor_core") > 0, "failing").otherwise("needs-improvement")
    return pages.select("page", "measures", "good_core", assessment.alias("assessment"))


_NAMES = tuple(S.VITALS)
_CASE = lambda k: "CASE event_type " + " ".join(f"WHEN '{e}' THEN {float(t[k])}" for e, t in zip(_MEASURED, S.VITALS.values(), strict=True)) + " END::DOUBLE"
VITALS_ASSESSMENT = f"""
WITH e AS (SELECT user_id AS page, event_type, round(quantile_cont(value * ({_CASE(0)} / 60), 0.75), 4) AS p75 FROM events GROUP BY ALL HAVING count(*) >= 8),
r AS (SELECT *, CASE WHEN p75 <= {_CASE(0)} THEN 'good' WHEN p75 <= {_CASE(1)} THEN 'fair' ELSE 'poor' END AS rating, event_type IN {_MEASURED[:3]} AS core FROM e),
p AS (SELECT page, count(*) AS measures, count(*) FILTER (core) AS known, count(*) FILTER (core AND rating = 'good') AS good_core, count(*) FILTER (core AND rating = 'poor') AS poor_core FROM r GROUP BY page)
SELECT page, measures, good_core, CASE WHEN known < 3 THEN 'insufficient-data' WHEN good_core = 3 THEN 'passing' WHEN poor_core > 0 THEN 'failing' ELSE 'needs-improvement' END AS assessment FROM p
"""

#: A measurement by an order line, in SQL that Spark and DuckDB share.
_SPEED = """
SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS page, l_returnflag AS type, l_linenumber = 7 AS error, l_tax > 0.075 AS degraded, CAST(floor(l_extendedprice / 8) AS INTEGER) AS lcp_ms, l_linestatus = 'F' AS popup,
  CAST(floor(l_extendedprice / 16) AS INTEGER) AS content_ms, CAST(l_discount AS DOUBLE) * 3 AS cls, l_partkey % 40 AS element, l_suppkey % 30 AS node, CAST(l_quantity AS INTEGER) * 1000 AS bytes, l_suppkey AS host, l_orderkey AS load,
  ((CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS INTEGER) AS t
FROM lineitem
"""


def _speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPEED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_table(spark, sf_dir, "lineitem"))


def _usable(rows: DataFrame) -> DataFrame:
    """Measurements that count: no error, not degraded, something painted."""
    return rows.where("NOT error AND NOT degraded AND lcp_ms > 0")


def speed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By page type: usable measurements, ratings of LCP and CLS, and how many LCPs are a popup whose page's content was good."""
    rows = _usable(_speed(spark, sf_dir)).withColumns({"lcp": S.rating(F.col("lcp_ms"), "lcp_ms"), "shift": S.rating(F.round("cls", 4), "cls"), "content": S.rating(F.col("content_ms"), "lcp_ms")})
    of = lambda name, value: F.count_if(F.col(name) == value).alias(f"{name}_{value.replace('-', '_')}")
    counts = [of(name, value) for name in ("lcp", "shift") for value in ("good", "needs-improvement", "poor")]
    popup = [F.count_if("popup").alias("popups"), F.count_if(F.col("popup") & (F.col("content") == "good")).alias("popup_over_good")]
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("pages"), *counts, *popup)


_RATE = lambda v, good, fair: f"CASE WHEN {v} <= {good} THEN 'good' WHEN {v} <= {fair} THEN 'needs-improvement' ELSE 'poor' END"
_USABLE = f"s AS ({_SPEED}), u AS (SELECT *, {_RATE('lcp_ms', 2500, 4000)} AS lcp, {_RATE('round(cls, 4)', '0.1::DOUBLE', '0.25::DOUBLE')} AS shift, {_RATE('content_ms', 2500, 4000)} AS content FROM s WHERE NOT error AND NOT degraded AND lcp_ms > 0)"
SPEED_SUMMARY = f"""WITH {_USABLE} SELECT type, count(*) AS pages, {', '.join(f"count(*) FILTER ({n} = '{v}') AS {n}_{v.replace('-', '_')}" for n in ('lcp', 'shift') for v in ('good', 'needs-improvement', 'poor'))},
  count(*) FILTER (popup) AS popups, count(*) FILTER (popup AND content = 'good') AS popup_over_good FROM u GROUP BY type"""


def shift_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that moved most over all shifts, and on how many page loads."""
    rows = _usable(_speed(spark, sf_dir)).where("cls > 0")
    return rows.groupBy("node").agg(F.round(F.sum("cls"), 4).alias("moved"), F.count_distinct("load").alias("loads")).orderBy(F.desc("moved"), "node").limit(MOVERS)


SHIFT_MOVERS = f"WITH {_USABLE} SELECT node, round(sum(cls), 4) AS moved, count(DISTINCT load) AS loads FROM u WHERE cls > 0 GROUP BY node ORDER BY moved DESC, node LIMIT {MOVERS}"


def lcp_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements that are most often what paints last."""
    return _usable(_speed(spark, sf_dir)).groupBy("element").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "element").limit(ELEMENTS)


LCP_ELEMENTS = f"WITH {_USABLE} SELECT element, count(*) AS pages FROM u GROUP BY element ORDER BY pages DESC, element LIMIT {ELEMENTS}"


def lcp_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each load, the last candidate, and the last that is no popup (null if all are)."""
    rows = _speed(spark, sf_dir).groupBy("load").agg(F.max_by("element", "t").alias("last"), F.max_by(F.when(~F.col("popup"), F.col("element")), F.when(~F.col("popup"), F.col("t"))).alias("content"))
    return rows


LCP_TIMELINE = f"WITH s AS ({_SPEED}) SELECT load, max_by(element, t) AS last, max_by(element, t) FILTER (NOT popup) AS content FROM s GROUP BY load"


def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each load: bytes, requests, bytes from other hosts, and the heaviest host. Of a URL's timings the last counts."""
    timings = _speed(spark, sf_dir).groupBy("load", "host").agg(F.max_by("bytes", "t").alias("bytes"))
    own = F.col("host") % 3 == 0
    return timings.groupBy("load").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("requests"), F.sum(F.when(~own, F.col("bytes")).otherwise(0)).alias("third_party"), F.max_by("host", F.struct("bytes", "host")).alias("heaviest"))


PAGE_RESOURCES = f"WITH s AS ({_SPEED}), t AS (SELECT load, host, max_by(bytes, t) AS bytes FROM s GROUP BY load, host) SELECT load, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS requests, CAST(sum(CASE WHEN host % 3 <> 0 THEN bytes ELSE 0 END) AS BIGINT) AS third_party, max_by(host, row(bytes, host)) AS heaviest FROM t GROUP BY load"


def heaviest_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page type, the heaviest responses."""
    place = F.row_number().over(W.Window.partitionBy("type").orderBy(F.desc("bytes"), "page"))
    return _speed(spark, sf_dir).select("type", "page", "bytes", place.alias("place")).where(F.col("place") <= HEAVIEST)


HEAVIEST_RESOURCES = f"WITH s AS ({_SPEED}) SELECT type, page, bytes, CAST(row_number() OVER (PARTITION BY type ORDER BY bytes DESC, page) AS INTEGER) AS place FROM s QUALIFY place <= {HEAVIEST}"

_ORDER = "CASE type WHEN 'home' THEN 0 WHEN 'landing' THEN 1 WHEN 'blog_post' THEN 2 ELSE 3 END"


def speed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages to be measured, each once by its key, by type and URL."""
    rows = _table(spark, sf_dir, "pages").select("page_id", "url", U.norm_url(F.col("url")).alias("key"), U.page_type(F.col("url"))["type"].alias("type"))
    first = F.row_number().over(W.Window.partitionBy("key").orderBy("page_id"))
    return rows.where((F.col("page_id") % 10 != 0) & ~U.host(F.col("url")).startswith("m.")).withColumn("r", first).where("r = 1").select("key", "url", "type", F.expr(_ORDER).alias("rank"))


_TYPED = site.PAGE_TYPES.partition("SELECT split_part(k")[0].replace("lower(regexp_extract(path, '^/([^/]+)', 1)) AS listed", "'' AS listed").replace("q AS (SELECT path, s,", "q AS (SELECT page_id, url, host, query, path, s,").replace("t AS (SELECT CASE", "t AS (SELECT page_id, url, host, query, path, CASE")
SPEED_QUEUE = f"""{_TYPED}, r AS (SELECT page_id, url, {site._KEY} AS key, split_part(k, '/', 1) AS type FROM t WHERE page_id % 10 <> 0 AND NOT starts_with(host, 'm.'))
SELECT key, url, type, {_ORDER} AS rank FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1"""


def serp_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domains that stand in most results, one's own left out."""
    rows = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("d"), F.col("l_suppkey") % 40, F.lit(".example.com")).alias("domain")).where("domain <> 'd7.example.com'")
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("results")).orderBy(F.desc("results"), "domain").limit(DOMAINS)


SERP_DOMAINS = f"SELECT concat('d', l_suppkey % 40, '.example.com') AS domain, count(*) AS results FROM lineitem WHERE l_suppkey % 40 <> 7 GROUP BY 1 ORDER BY results DESC, domain LIMIT {DOMAINS}"


def heading_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of two or more pages: headings that have the same words, each page once; shown as first written."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 100).alias("page"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("heading"))
    rows = rows.withColumn("theme", F.array_join(F.array_sort(T.loose_tokens(F.col("heading"))), " ")).where("theme <> ''")
    return rows.groupBy("theme").agg(F.count_distinct("page").alias("pages"), F.min_by("heading", "ord").alias("heading")).where("pages >= 2").orderBy(F.desc("pages"), "theme").limit(THEMES)


_STOPS = ", ".join(f"'{w}'" for w in T.LOOSE_STOP)
_LOOSE = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOPS})))"
HEADING_THEMES = f"WITH r AS (SELECT p_partkey AS ord, p_partkey % 100 AS page, concat_ws(' ', p_name, lower(p_type)) AS heading FROM part), t AS (SELECT *, array_to_string(list_sort({_LOOSE('heading')}), ' ') AS theme FROM r) SELECT theme, count(DISTINCT page) AS pages, min_by(heading, ord) AS heading FROM t WHERE theme <> '' GROUP BY theme HAVING count(DISTINCT page) >= 2 ORDER BY pages DESC, theme LIMIT {THEMES}"


def theme_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three or more headings, the most frequent ones."""
    rows = _table(spark, sf_dir, "part").select(F.explode(T.loose_tokens(F.concat_ws(" ", "p_name", F.lower("p_type")))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("headings")).where("headings >= 3").orderBy(F.desc("headings"), "term").limit(15)


THEME_TERMS = f"WITH t AS (SELECT unnest({_LOOSE('concat_ws(chr(32), p_name, lower(p_type))')}) AS term FROM part) SELECT term, count(*) AS headings FROM t GROUP BY term HAVING count(*) >= 3 ORDER BY headings DESC, term LIMIT 15"


def covered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, page): the first page that already covers a topic, by four fifths of its words; query before title.

    Topics meet pages by their rarest words: a page that covers one has all its words but a fifth.
    """
    part = _table(spark, sf_dir, "part")
    topics = part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("topic")).distinct().withColumn("a", T.loose_tokens(F.col("topic")))
    fields = part.where("p_partkey % 7 = 0").select("p_partkey", F.explode(F.array(F.struct(F.lit(0).alias("f"), F.col("p_name").alias("x")), F.struct(F.lit(1).alias("f"), F.concat_ws(" ", F.lower("p_type"), F.lit("goods")).alias("x")))).alias("s"))
    pages = fields.select("p_partkey", "s.f", T.loose_tokens(F.col("s.x")).alias("b"))
    # Of n words a page may lack n - ceil(0.8 n), so it has one of the rarest words of one more; common words join nobody else.
    each = pages.select("p_partkey", "f", "b", F.explode("b").alias("t"))
    frequency = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = topics.select("topic", "a", F.explode("a").alias("t")).join(frequency, "t", "left").groupBy("topic").agg(F.first("a").alias("a"), F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("r"))
    rare = ranked.select("topic", "a", F.explode(F.slice("r", F.lit(1), (F.size("a") - F.ceil(0.8 * F.size("a")) + 1).cast("int"))).alias("k")).select("topic", "a", F.col("k.t").alias("t"))
    met = rare.join(each, "t").where(R.overlaps(F.col("a"), F.col("b")))
    found = met.groupBy("topic").agg(F.min(F.struct("p_partkey", "f")).alias("m"))
    return topics.select("topic").join(found, "topic", "left").select("topic", F.col("m.p_partkey").alias("page"), F.col("m.f").alias("field"))


COVERED_TOPICS = f"""
WITH k AS (SELECT DISTINCT concat_ws(' ', p_name, lower(p_type)) AS topic FROM part), a AS (SELECT topic, {_LOOSE('topic')} AS a FROM k),
p AS (SELECT p_partkey, 0 AS f, {_LOOSE('p_name')} AS b FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 1, {_LOOSE("concat_ws(' ', lower(p_type), 'goods')")} FROM part WHERE p_partkey % 7 = 0),
m AS (SELECT topic, min(row(p_partkey, f)) AS m FROM a JOIN p ON len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) >= 0.8::DOUBLE * len(a) GROUP BY topic)
SELECT a.topic, struct_extract(m, 1) AS page, struct_extract(m, 2) AS field FROM a LEFT JOIN m USING (topic)
"""


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(competitor, keywords, reach): visits that a competitor's positions may bring."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("competitor"), F.col("l_quantity").alias("volume"), (F.col("l_linenumber") + F.col("l_partkey") % 9).cast("double").alias("position"))
    return rows.groupBy("competitor").agg(F.count(F.lit(1)).alias("keywords"), F.sum(F.bround(F.round(F.col("volume") * S.ctr_at(F.col("position")), 6))).cast("long").alias("reach"))


_CTR = "CASE p " + " ".join(f"WHEN {p} THEN {v}" for p, v in S.CTR.items()) + f" ELSE {S.CTR_BEYOND} END::DOUBLE"
REACH = f"SELECT competitor, count(*) AS keywords, CAST(sum(round_even(round(volume * ({_CTR}), 6), 0)) AS BIGINT) AS reach FROM (SELECT l_suppkey % 20 AS competitor, l_quantity AS volume, l_linenumber + l_partkey % 9 AS p FROM lineitem) GROUP BY competitor"


def channel_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by events of the later half, their rank, and the change in percent from the earlier half."""
    rows = _table(spark, sf_dir, "events")
    late = F.col("event_id") % 2 == 1
    each = rows.groupBy(F.col("event_type").alias("channel")).agg(F.count_if(late).alias("now"), F.count_if(~late).alias("before"))
    return each.withColumns({"rank": F.rank().over(W.Window.orderBy(F.desc("now"))), "change": R.change(F.col("now"), F.col("before"))})  # a row a channel


CHANNEL_RANKS = "WITH e AS (SELECT event_type AS channel, count(*) FILTER (event_id % 2 = 1) AS now, count(*) FILTER (event_id % 2 = 0) AS before FROM events GROUP BY 1) SELECT *, CAST(1 + (SELECT count(*) FROM e b WHERE b.now > e.now) AS INTEGER) AS rank, CASE WHEN before <> 0 THEN CAST(floor(100 * (now - before) / before + 0.5) AS BIGINT) END AS change FROM e"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects read from replies with a code fence, without one, and broken ones (null)."""
    fence = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit("{broken"))
    return _table(spark, sf_dir, "events").select("event_id", R.fenced_json(fence, "k int")["k"].alias("k"), F.substring(F.to_json(F.struct("event_id", "event_type")), 1, 20).alias("context"))


REPLIES = "SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k, left('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}', 20) AS context FROM events"


def keyword_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned keywords, whether the page grounds them, whether their length fits, and what they were decided from."""
    k = F.col("p_partkey")
    asked = F.concat(F.when(k % 4 == 0, "How to  check ").when(k % 4 == 1, "what is ").otherwise(""), F.col("p_name"), F.when(k % 3 == 0, " guide?").otherwise(""), F.when(k % 5 == 0, F.concat(F.lit(" near "), F.lower("p_type"))).otherwise(""))
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", asked.alias("asked"))
    clean = R.clean_keyword(F.col("asked"))
    page = F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")))
    return rows.select("p_partkey", clean.alias("keyword"), R.grounded(clean, page).alias("grounded"), R.fits(F.col("asked"), 6, 24).alias("fitting"), F.substring(F.sha1(F.concat_ws("|", "p_name", "p_type")), 1, 16).alias("decided_from"))


def _stems(x: str) -> str:
    from sitelumen.plans import landing

    return landing._tokens(x)


KEYWORD_CHECKS = f"""
WITH r AS (SELECT *, concat(CASE p_partkey % 4 WHEN 0 THEN 'How to  check ' WHEN 1 THEN 'what is ' ELSE '' END, p_name, CASE WHEN p_partkey % 3 = 0 THEN ' guide?' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN concat(' near ', lower(p_type)) ELSE '' END) AS asked FROM part),
c AS (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(lower(asked), '\\s+', ' ', 'g')), '^(how to |what is )', ''), '^check ', '') AS keyword, concat_ws(' ', p_name, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END) AS page FROM r),
t AS (SELECT *, {_stems('keyword')} AS k, {_stems('page')} AS s, regexp_replace(trim(regexp_replace(asked, '\\s+', ' ', 'g')), '^["?. ]+|["?. ]+$', '', 'g') AS bare FROM c)
SELECT p_partkey, keyword, len(k) > 0 AND len(list_intersect(k, s)) >= ceil(len(k) * 0.75::DOUBLE) AS grounded, CASE WHEN length(bare) BETWEEN 6 AND 24 THEN bare END AS fitting, left(sha1(p_name || '|' || p_type), 16) AS decided_from FROM t
"""


def draft_scores(spark: SparkSession, sf_dir: str, keyword: str = "then", brand: str = "the", words: int = 300) -> DataFrame:
    """(doc_id, n_words, headings, passed, score, verdict): how well a text targets a keyword.

    Words in front and in a heading, length and sentences weigh; the text's lines that begin with a hash are headings.
    """
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = rows.withColumn("p", F.explode(F.array(F.struct(w.alias("w"), F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]{0,3}#{1,4}[ \t]+([^\n]+)$"), F.lit(1)).alias("h"), F.size(F.filter(F.split("text", r"[.!?]+\s"), lambda x: F.trim(x) != "")).alias("s")))))
    n, target = F.size("p.w"), T.loose_tokens(F.lit(keyword))
    front = T.loose_tokens(F.array_join(F.slice("p.w", 1, 100), " "))
    sentence = F.when(F.col("p.s") > 0, n / F.col("p.s")).otherwise(0.0)
    checks = [
        (F.size(F.array_except(target, front)) == 0, 2), (F.exists("p.h", lambda h: F.arrays_overlap(target, T.loose_tokens(h))), 2), (F.size("p.h") >= 3, 1),
        (n >= 0.7 * words, 2), ((sentence > 0) & (sentence <= 28), 1), (F.lower("text").contains(brand), 1),
    ]
    earned = sum((F.when(ok, weight).otherwise(0) for ok, weight in checks), F.lit(0))
    rows = rows.select("doc_id", n.alias("n_words"), F.size("p.h").alias("headings"), sum((ok.cast("int") for ok, _ in checks), F.lit(0)).alias("passed"), F.bround(100 * earned / sum(v for _, v in checks)).cast("int").alias("score"))
    return rows.withColumn("verdict", F.when(F.col("score") >= R.DRAFT_READY, "publish-ready").when(F.col("score") >= R.DRAFT_WORK, "needs work").otherwise("rework"))


DRAFT_SCORES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, regexp_extract_all(text, '(?m)^[ \\t]{{0,3}}#{{1,4}}[ \\t]+([^\\n]+)$', 1) AS h, len(list_filter(regexp_split_to_array(text, '[.!?]+\\s'), lambda x: trim(x) <> '')) AS s FROM d),
c AS (SELECT doc_id, len(w) AS n_words, len(h) AS headings, list_contains({_LOOSE("array_to_string(w[:100], ' ')")}, 'then') AS a, len(list_filter(h, lambda x: list_contains({_LOOSE('x')}, 'then'))) > 0 AS b, len(h) >= 3 AS c, len(w) >= 0.7::DOUBLE * 300 AS d, s > 0 AND len(w) > 0 AND len(w) / s <= 28 AS e, contains(lower(text), 'the') AS f FROM p),
r AS (SELECT doc_id, n_words, headings, CAST(a AS INTEGER) + b::INTEGER + c::INTEGER + d::INTEGER + e::INTEGER + f::INTEGER AS passed, CAST(round_even(100.0::DOUBLE * (2 * a::INTEGER + 2 * b::INTEGER + c::INTEGER + 2 * d::INTEGER + e::INTEGER + f::INTEGER) / 9, 0) AS INTEGER) AS score FROM c)
SELECT *, CASE WHEN score >= 80 THEN 'publish-ready' WHEN score >= 60 THEN 'needs work' ELSE 'rework' END AS verdict FROM r
"""


def listing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(what, value, urls): listed URLs by type and by status, and how many have a date."""
    from sitelumen.plans import sitemaps

    rows = sitemaps._facts(spark, sf_dir, "urls").select(F.when(F.col("url").contains("/blog/"), "blog").otherwise("other").alias("type"), F.coalesce("status", F.lit(0)).cast("string").alias("status"), (F.col("sitemaps") > 1).cast("string").alias("twice"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("type", "status", "twice")))).alias("e")
    return rows.select(each).groupBy("e.what", "e.value").agg(F.count(F.lit(1)).alias("urls"))


def _listing_counts() -> str:
    from sitelumen.plans import sitemaps

    return f"WITH u AS ({sitemaps._TABLES['urls'][1]}), r AS (SELECT CASE WHEN contains(url, '/blog/') THEN 'blog' ELSE 'other' END AS type, CAST(coalesce(status, 0) AS VARCHAR) AS status, CAST(sitemaps > 1 AS VARCHAR) AS twice FROM u) SELECT 'type' AS what, type AS value, count(*) AS urls FROM r GROUP BY type UNION ALL SELECT 'status', status, count(*) FROM r GROUP BY status UNION ALL SELECT 'twice', twice, count(*) FROM r GROUP BY twice"


LISTING_COUNTS = _listing_counts()

_ALL = (vitals_assessment, speed_queue, speed_summary, shift_movers, lcp_elements, lcp_timeline, page_resources, heaviest_resources, serp_domains, heading_themes, theme_terms, covered_topics, reach, channel_ranks, replies, keyword_checks, draft_scores, listing_counts)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
