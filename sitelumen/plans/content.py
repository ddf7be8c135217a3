"""Analyses of page texts. The driver's documents stand for a site's texts, one a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.functions import text as T
from sitelumen.operators import density, shingles

WINDOW_WORDS, LEAST_TAIL, FOCUS = 150, 75, "then"
STUFFING_DENSITY, STUFFING_WINDOW = 3.0, 6
#: What a word is, as in the text functions.
RX = T.WORD.replace("'", "''")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.words(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n_words"), F.array_join(F.slice("w", 1, 3), " ").alias("first_words"), F.size(F.array_distinct("w")).alias("n_different"))


WORDS_COUNT = f"""
SELECT doc_id, len(w) AS n_words, array_to_string(w[1:3], ' ') AS first_words, len(list_distinct(w)) AS n_different
FROM (SELECT doc_id, regexp_extract_all(text, '{RX}') AS w FROM documents)
"""


def window_of(pos: F.Column, n: F.Column) -> F.Column:
    """The window of a word: a tail shorter than LEAST_TAIL belongs to the window before it."""
    last = F.greatest(F.lit(0), F.floor((n - 1) / WINDOW_WORDS) - F.when((n % WINDOW_WORDS > 0) & (n % WINDOW_WORDS < LEAST_TAIL), 1).otherwise(0))
    return F.least(F.floor(pos / WINDOW_WORDS), last)


def density_windows(spark: SparkSession, sf_dir: str, focus: str = FOCUS) -> DataFrame:
    """(doc_id, window, words, mentions): words and mentions of one keyword in each 150-word window."""
    each = shingles.positions(documents(spark, sf_dir))
    return each.groupBy(F.col("id").alias("doc_id"), window_of(F.col("pos"), F.col("n")).cast("int").alias("window")).agg(F.count(F.lit(1)).alias("words"), F.sum((F.col("word") == focus).cast("long")).alias("mentions"))


_WINDOWED = f"""
w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{RX}'), lambda x: lower(x)) AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS pos, unnest(w) AS word FROM w),
k AS (SELECT doc_id, n, word, CAST(least(pos // {WINDOW_WORDS}, greatest(0, (n - 1) // {WINDOW_WORDS} - CASE WHEN n % {WINDOW_WORDS} > 0 AND n % {WINDOW_WORDS} < {LEAST_TAIL} THEN 1 ELSE 0 END)) AS INTEGER) AS "window" FROM p),
d AS (SELECT doc_id, any_value(n) AS n, "window", count(*) AS words, CAST(sum(CASE WHEN word = '{FOCUS}' THEN 1 ELSE 0 END) AS BIGINT) AS mentions FROM k GROUP BY doc_id, "window")
"""
DENSITY_WINDOWS = f'WITH {_WINDOWED} SELECT doc_id, "window", words, mentions FROM d'


def density_verdicts(spark: SparkSession, sf_dir: str, focus: str = FOCUS) -> DataFrame:
    """Each document's mentions against one in 150 words: on average, and in every window."""
    by_window = density_windows(spark, sf_dir, focus)
    total = by_window.groupBy("doc_id").agg(
        F.sum("words").alias("words"), F.sum("mentions").alias("mentions"), F.count(F.lit(1)).alias("windows"),
        F.sum((F.col("mentions") > 0).cast("long")).alias("covered"), F.max("mentions").alias("max_in_window"),
    )
    required = F.ceil(F.col("words") / WINDOW_WORDS)
    verdict = F.when(F.col("covered") == F.col("windows"), "pass").when(F.col("mentions") >= required, "pass-on-average").otherwise("fail")
    stuffing = (100 * F.col("mentions") > STUFFING_DENSITY * F.col("words")) | (F.col("max_in_window") >= STUFFING_WINDOW)
    return total.select("doc_id", "words", "mentions", required.alias("required"), F.greatest(F.lit(0), required - F.col("mentions")).alias("shortfall"), "windows", "covered", stuffing.alias("stuffing"), verdict.alias("verdict"))


DENSITY_VERDICTS = f"""
WITH {_WINDOWED}, t AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS words, CAST(sum(mentions) AS BIGINT) AS mentions, count(*) AS windows, CAST(count(*) FILTER (mentions > 0) AS BIGINT) AS covered, max(mentions) AS m FROM d GROUP BY doc_id)
SELECT doc_id, words, mentions, CAST((words + {WINDOW_WORDS - 1}) // {WINDOW_WORDS} AS BIGINT) AS required, greatest(0, CAST((words + {WINDOW_WORDS - 1}) // {WINDOW_WORDS} AS BIGINT) - mentions) AS shortfall,
  windows, covered, (100 * mentions > 3 * words OR m >= {STUFFING_WINDOW}) AS stuffing,
  CASE WHEN covered = windows THEN 'pass' WHEN mentions >= (words + {WINDOW_WORDS - 1}) // {WINDOW_WORDS} THEN 'pass-on-average' ELSE 'fail' END AS verdict
FROM t
"""


def density_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, stuffed ones and median coverage of each verdict."""
    rows = density_verdicts(spark, sf_dir)
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("stuffing").cast("long")).alias("stuffed"), F.sum("shortfall").alias("missing_mentions"), F.round(F.median(F.col("covered") / F.col("windows")), 6).alias("median_coverage"))


DENSITY_SUMMARY = f"SELECT verdict, count(*) AS docs, CAST(count(*) FILTER (stuffing) AS BIGINT) AS stuffed, CAST(sum(shortfall) AS BIGINT) AS missing_mentions, round(median(covered / windows), 6) AS median_coverage FROM ({DENSITY_VERDICTS}) GROUP BY verdict"


def identical_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of 50 words or more: smallest id, size."""
    rows = documents(spark, sf_dir).where(F.size(T.words(F.col("text"))) >= 50)
    return rows.groupBy(F.sha1("text").alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs")).where("docs > 1")


IDENTICAL_CONTENT = f"SELECT sha1(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS docs FROM documents WHERE len(regexp_extract_all(text, '{RX}')) >= 50 GROUP BY sha1(text) HAVING count(*) > 1"


def shingle_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shingles are held by how many documents."""
    return shingles.shingle_frequency(documents(spark, sf_dir)).groupBy("docs").agg(F.count(F.lit(1)).alias("shingles"))


_SHINGLED = f"""
w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{RX}'), lambda x: lower(x)) AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, unnest(range(len(w) - 4)) AS start, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS shingle FROM w WHERE len(w) >= 5),
f AS (SELECT shingle, count(DISTINCT doc_id) AS docs FROM s GROUP BY shingle)
"""
SHINGLE_DF = f"WITH {_SHINGLED} SELECT docs, count(*) AS shingles FROM f GROUP BY docs"


def unique_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.unique_words(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


UNIQUE_WORDS = f"""
WITH {_SHINGLED}, u AS (SELECT DISTINCT s.doc_id, s.start + k AS pos FROM s JOIN f USING (shingle) CROSS JOIN range(5) AS r(k) WHERE f.docs < 3)
SELECT w.doc_id, CAST(len(w.w) AS INTEGER) AS n_words, CAST(count(u.pos) AS INTEGER) AS unique_words FROM w LEFT JOIN u ON u.doc_id = w.doc_id GROUP BY w.doc_id, len(w.w)
"""


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts of 60 words or more with a similarity of 0.7 or more."""
    return shingles.similar_pairs(documents(spark, sf_dir)).select("a", "b", F.round("similarity", 6).alias("similarity"))


NEAR_DUPLICATES = """
WITH o AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM o),
s AS (SELECT DISTINCT id, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS h FROM w WHERE len(w) >= 60),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.id < y.id GROUP BY x.id, y.id)
SELECT a, b, round(c / (na.n + nb.n - c), 6) AS similarity FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c / (na.n + nb.n - c) >= 0.7
"""


def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword tokens of each part's name and type."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    phrase = F.concat_ws(" ", F.lit("Best"), "p_name", F.lit("boxes for 2026 classes"), "p_type")
    return part.select("p_partkey", F.array_join(F.sort_array(T.tokens(phrase, keep_years=True)), " ").alias("tokens"))


_STOPPED = ", ".join(f"'{w}'" for w in (*T.STOP, *T.MARKETING))
STEM_TOKENS = f"""
WITH w AS (SELECT p_partkey, unnest(list_transform(regexp_extract_all(translate(concat_ws(' ', 'Best', p_name, 'boxes for 2026 classes', p_type), '_-', '  '), '{RX}'), lambda x: lower(x))) AS w FROM part),
k AS (SELECT p_partkey, w FROM w WHERE w NOT IN ({_STOPPED}) AND (NOT regexp_full_match(w, '[0-9]+') OR regexp_full_match(w, '(19|20)[0-9][0-9]'))),
s AS (SELECT DISTINCT p_partkey, CASE WHEN regexp_full_match(w, '[0-9]+') OR length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(sses|ches|shes|xes|zes)$') THEN left(w, -2) WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|ys)$') THEN left(w, -1) ELSE w END AS t FROM k)
SELECT p_partkey, string_agg(t, ' ' ORDER BY t) AS tokens FROM s GROUP BY p_partkey
"""

QUERIES = {f.__name__: f for f in (words_count, density_windows, density_verdicts, density_summary, identical_content, shingle_df, unique_words, near_duplicates, stem_tokens)}
ORACLE_SQL = {"words_count": WORDS_COUNT, "density_windows": DENSITY_WINDOWS, "density_verdicts": DENSITY_VERDICTS, "density_summary": DENSITY_SUMMARY, "identical_content": IDENTICAL_CONTENT, "shingle_df": SHINGLE_DF, "unique_words": UNIQUE_WORDS, "near_duplicates": NEAR_DUPLICATES, "stem_tokens": STEM_TOKENS}


#: A one-word keyword for each language, and stand-ins for what a page has besides its text.
_KEYWORDS = {"en": "tion", "de": "sch", "fr": "eau", "es": "que"}


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, most = F.coalesce("text", F.lit("")), max(density.EDGE_WORDS, 65)
    first = T.words(F.substring(text, 1, 20 * most))
    # Of a text's beginning, all words but the last are whole; where it has too few, the whole text is read.
    w = F.when((F.size(first) > most) | (F.length(text) <= 20 * most), first).otherwise(T.words(text))
    words = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    focus = F.coalesce(*(F.when(F.col("lang") == k, F.array(F.lit(v))) for k, v in _KEYWORDS.items()))
    rows = documents(spark, sf_dir).select("doc_id", "text", focus.alias("focus"), "source", F.explode(F.array(w)).alias("w"))
    return rows.select("doc_id", "text", "focus", words(1, 8).alias("title"), words(1, 4).alias("h1"), F.col("source").alias("url"), words(9, 12).alias("meta_description"), F.array(words(21, 5), words(41, 5)).alias("subheadings"), F.array(words(61, 5)).alias("alts"))


def keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's mentions of its keyword against one in 150 words, and the places that lack it."""
    rows = density.analysed(_posts(spark, sf_dir))
    names = ("words", "mentions", "exact", "required", "shortfall", "words_per_mention", "percent", "windows", "covered", "max_in_window", "stuffed", "verdict")
    return rows.select("doc_id", *(f"density.{c}" for c in names), F.array_join(F.transform("density.gaps", lambda g: g.cast("string")), " ").alias("gaps"), F.array_join("density.lacking", " ").alias("lacking"))


def keyword_density_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.summary(density.analysed(_posts(spark, sf_dir)))


def _has(x: str) -> str:
    from sitelumen.plans import landing

    return f"focus IS NOT NULL AND list_contains({landing._tokens(x)}, focus)"


def _density_sql() -> str:
    from sitelumen.plans import landing

    stem = landing._STEM.replace("regexp_full_match(w, '[0-9]+') OR ", "")
    focus = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KEYWORDS.items()) + " END"
    places = {"title": "array_to_string(w[1:8], ' ')", "h1": "array_to_string(w[1:4], ' ')", "url": "replace(source, '/', ' ')", "meta_description": "array_to_string(w[9:20], ' ')", "first_100_words": "array_to_string(w[:100], ' ')"}
    either = {"a_subheading": ("array_to_string(w[21:25], ' ')", "array_to_string(w[41:45], ' ')"), "image_alt": ("array_to_string(w[61:65], ' ')",), "last_100_words": ("array_to_string(w[-100:], ' ')",)}
    lacks = [f"CASE WHEN NOT coalesce({_has(x)}, false) THEN '{p}' END" for p, x in places.items()] + [f"CASE WHEN NOT coalesce({' OR '.join(f'({_has(x)})' for x in xs)}, false) THEN '{p}' END" for p, xs in either.items()]
    return f"""
t AS (SELECT doc_id, {focus} AS focus, source, regexp_extract_all(coalesce(text, ''), '{RX}') AS w FROM documents),
p AS (SELECT doc_id, focus, n, pos, unnest(list_filter(string_split(regexp_replace(lower(word), '[''’]s$', ''), '-'), lambda x: x <> '')) AS w FROM (SELECT doc_id, focus, len(w) AS n, unnest(range(len(w))) AS pos, unnest(w) AS word FROM t)),
m AS (SELECT doc_id, least(pos // 150, greatest(0, (n - 1) // 150 - CASE WHEN n % 150 > 0 AND n % 150 < 75 THEN 1 ELSE 0 END)) AS win FROM p WHERE {stem} = focus),
c AS (SELECT doc_id, win, count(*) AS k FROM m GROUP BY doc_id, win), s AS (SELECT doc_id, sum(k) AS mentions, count(*) AS covered, max(k) AS most, list(win) AS wins FROM c GROUP BY doc_id),
a AS (SELECT t.doc_id, t.focus, t.source, t.w, len(t.w) AS words, CASE WHEN len(t.w) > 0 THEN 1 + greatest(0, (len(t.w) - 1) // 150 - CASE WHEN len(t.w) % 150 > 0 AND len(t.w) % 150 < 75 THEN 1 ELSE 0 END) ELSE 0 END AS windows, CAST(coalesce(mentions, 0) AS INTEGER) AS mentions, coalesce(covered, 0) AS covered, coalesce(most, 0) AS max_in_window, coalesce(wins, []) AS wins FROM t LEFT JOIN s USING (doc_id)),
d AS (SELECT doc_id, words, mentions, mentions AS exact, CAST(ceil(words / 150) AS INTEGER) AS required, greatest(0, CAST(ceil(words / 150) AS INTEGER) - mentions) AS shortfall, CASE WHEN mentions > 0 THEN CAST(round_even(words / mentions, 0) AS INTEGER) END AS words_per_mention,
  CASE WHEN words > 0 THEN round(100 * mentions / words, 2) ELSE 0 END AS percent, windows, covered, max_in_window, coalesce(CASE WHEN words > 0 THEN round(100 * mentions / words, 2) END > 3, false) OR max_in_window >= 6 AS stuffed,
  CASE WHEN words > 0 AND covered = windows THEN 'pass' WHEN words > 0 AND mentions >= ceil(words / 150) THEN 'pass-on-average' ELSE 'fail' END AS verdict,
  array_to_string(list_filter(range(1, windows + 1), lambda i: NOT list_contains(wins, i - 1)), ' ') AS gaps, concat_ws(' ', {', '.join(lacks)}) AS lacking FROM a)
"""


KEYWORD_DENSITY = f"WITH {_density_sql()} SELECT * FROM d"
KEYWORD_DENSITY_SUMMARY = f"""WITH {_density_sql()} SELECT count(*) AS posts, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'pass-on-average') AS pass_on_average, count(*) FILTER (verdict = 'fail') AS fail, count(*) FILTER (stuffed) AS stuffed,
  median(words_per_mention) AS median_words_per_mention, median(CASE WHEN windows > 0 THEN round_even(100 * covered / windows, 0) ELSE 0 END) AS median_coverage, CAST(sum(shortfall) AS BIGINT) AS missing_mentions,
  {', '.join(f"count(*) FILTER (words_per_mention BETWEEN {a} AND {b}) AS {name.replace(' ', '_')}" for name, (a, b) in density.BUCKETS.items())}, count(*) FILTER (words_per_mention IS NULL) AS never, {', '.join(f"count(*) FILTER (list_contains(string_split(lacking, ' '), '{p}')) AS no_{p}" for p in density.PLACES)} FROM d"""
QUERIES |= {f.__name__: f for f in (keyword_density, keyword_density_summary)}
ORACLE_SQL |= {"keyword_density": KEYWORD_DENSITY, "keyword_density_summary": KEYWORD_DENSITY_SUMMARY}
