"""Column functions against hand-made cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitelumen.functions import rules as R
from sitelumen.functions import scoring as S
from sitelumen.functions import text as T
from sitelumen.functions import url as U
from sitelumen.operators import mentions


def of(spark, function, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {'double' if isinstance(values[0], float) else 'string'}")
    return [r[1] for r in rows.select("i", function(F.col("v"))).orderBy("i").collect()]


def test_stem(spark):
    cases = {"colleges": "college", "classes": "class", "universities": "university", "branches": "branch", "status": "status", "analysis": "analysis", "class": "class", "ies": "ies", "ties": "ty"[:0] + "tie", "keys": "keys", "a": "a"}
    cases["ties"] = "tie"
    assert of(spark, T.stem, *cases) == list(cases.values())
    assert [T.stem_of(w) for w in cases] == list(cases.values())


def test_tokens(spark):
    assert of(spark, lambda c: T.tokens(c, keep_years=True), "CLAT 2026", "Best law-colleges in_Delhi 10", "") == [["clat", "2026"], ["law", "college", "delhi"], []]
    assert of(spark, T.tokens, "CLAT 2026", None) == [["clat"], None]


def test_words_and_shingles(spark):
    assert of(spark, T.words, "don't re-use é x2", "") == [["don't", "re-use", "x2"], []]
    sizes = lambda c: F.size(T.shingles(F.split(c, " "), 5))
    assert of(spark, sizes, "a b c d e f", "a b", "a a a a a a a") == [2, 1, 1]


def test_intent_and_angle(spark):
    assert of(spark, T.intent, "hire a tutor", "best schools", "how to study", "tutor near me") == ["transactional", "commercial", "informational", "local"]
    assert of(spark, T.angle, "how to x", "x vs y", "x price", "x") == ["FAQ answer", "comparison", "pricing guide", "how-to guide"]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www.Acme.com/A/b/?x=1#top", "acme.com/A/b?x=1"), ("http://acme.com", "acme.com/"), ("acme.com/", "acme.com/"), ("https://a.b/c d/", "a.b/c d"),
        ("https://a.b:8080//", "a.b:8080/"), ("", "/"), (None, None), ("https://a.b?q", "a.b/?q"),
    ],
)
def test_norm_url(spark, url, key):
    assert of(spark, U.norm_url, url) == [key]


def test_domains_and_types(spark):
    assert of(spark, U.normalize_domain, "https://acme.com/pricing?utm=x#top", "a b.com", "me@www.x.org:80.", "local") == ["acme.com", None, "x.org", None]
    kinds = [tuple(k) for k in of(spark, U.page_type, "https://a.b/", "https://a.b/blog/x/y", "https://a.b/blog", "https://a.b/contact-us", "https://a.b/delhi/clat-coaching", "https://a.b/clat-coaching", "https://a.b/toppers", "https://a.b/x")]
    assert kinds == [("home", "home"), ("blog_post", "article"), ("blog_category", "archive"), ("utility", "utility"), ("landing", "location"), ("landing", "service"), ("landing", "proof"), ("landing", "page")]
    own = lambda c: U.party(c, F.lit("acme.com"))
    assert of(spark, own, "https://img.acme.com/a", "https://x.cloudfront.net/a", "https://t.co/a", "https://notacme.com") == ["own", "cdn", "third", "third"]


def test_scores(spark):
    assert of(spark, S.ctr_at, 0.2, 2.5, 3.5, 10.4, 11.0) == [0.28, 0.15, 0.08, 0.023, 0.015]
    assert of(spark, lambda c: S.rating(c, "lcp_ms"), 2500.0, 2501.0, 4001.0, None) == ["good", "needs-improvement", "poor", None]
    assert of(spark, S.band, 0.0, 3.0, 10.0, 20.0, 21.0) == ["unranked", "top3", "page1", "page2", "beyond"]
    assert of(spark, lambda c: S.nearest_rank(F.array(c, c + 1, c + 2, c + 3), 0.5), 1.0) == [3.0]  # rank 2 of 0 to 3
    assert of(spark, lambda c: S.opportunity(F.lit(1000), F.lit(0), c), 8.0, 2.0, 31.0, 0.0) == [78, 0, 0, 0]


def test_mentions():
    focus = ["law", "college", "karnataka"]
    counts = lambda t: tuple(map(len, mentions.find(t, focus)[:2]))
    assert counts("law-colleges in karnataka") == (1, 0)
    assert counts("Karnataka law colleges are tough") == (0, 1)
    assert counts("medical colleges in Karnataka") == (0, 0)
    assert mentions.find("a b", [])[:2] == ([], []) and mentions.find(None, focus) == ([], [], 0)


def test_clusters(spark):
    rows = spark.createDataFrame([("a", k) for k in ("law coaching delhi", "law coaching", "music")] + [("b", None), ("b", "x y")], "brand string, keyword string")
    found = {(r.brand, r.keyword): r.cluster for r in mentions.clusters(rows, "brand").collect()}
    assert found == {("a", "law coaching delhi"): "law coaching", ("a", "law coaching"): "law coaching", ("a", "music"): "music", ("b", "x y"): "x y"}


def _scan(text, focus):
    """Mentions by trying every start, word by word."""
    counted = re.findall(T.WORD, text)
    parts = [(p, i) for i, w in enumerate(counted) for p in re.sub("['’]s$", "", w.lower()).split("-") if p]
    stems = [T.stem_of(p) for p, _ in parts]
    found, taken, at = [], set(), 0
    while at < len(parts):
        here, gaps, cells = at, 0, []
        for want in focus:
            while cells and here < len(parts) and stems[here] != want and parts[here][0] in T.STOP and gaps < mentions.GAP:
                here, gaps = here + 1, gaps + 1
            if here == len(parts) or stems[here] != want:
                cells = None
                break
            cells.append(here)
            here += 1
        if cells:
            found.append(parts[at][1])
            taken |= set(range(at, here))
            at = here
        else:
            at += 1
    loose, at = [], 0
    while len(focus) > 1 and at < len(parts):
        span = range(at, min(len(parts), at + len(focus) + mentions.GAP + 1))
        if stems[at] in focus and not taken & set(span) and {stems[i] for i in span} >= set(focus):
            loose.append(parts[at][1])
            at = span.stop
        else:
            at += 1
    return found, loose, len(counted)


def test_mentions_equal_a_scan():
    rng = random.Random(2)
    words = ["law", "laws", "college", "colleges", "in", "of", "the", "delhi", "x", "law-college", "college's", "of-law", "best"]
    for _ in range(4000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        focus = [rng.choice(["law", "college", "delhi", "of", "best"]) for _ in range(rng.randint(1, 4))]
        assert mentions.find(text, focus) == _scan(text, focus), (text, focus)


def test_rules(spark):
    assert of(spark, R.clean_keyword, "How to  prepare for CLAT", "what is law", "why so", "prepare ") == ["clat", "law", "why so", "prepare"]
    assert of(spark, lambda c: R.grounded(c, F.lit("law college in delhi")), "law colleges delhi", "law fees mumbai", "best") == [True, False, False]
    assert of(spark, lambda c: R.fits(c, 3, 8), ' "law?" ', "a", "far too long a phrase") == ["law", None, None]
    assert of(spark, R.retry_after, "3", "99", "-1", "soon", None) == [3.0, 10.0, 0.0, 0.0, 0.0]
    assert of(spark, R.tone, 85.0, 60.0, 59.0) == ["good", "fair", "poor"] and of(spark, lambda c: R.bar(c, F.lit(100.0)), 67.5, 500.0) == [50.0, 100.0]
    assert of(spark, lambda c: R.change(c, F.lit(8)), 9.0, 7.0) == [13, -12] and of(spark, lambda c: R.change(c, F.lit(0)), 9.0) == [None]
    assert of(spark, lambda c: R.fenced_json(c, "k int")["k"], '```json\n{"k": 1}\n```', '{"k": 2}', "no", None) == [1, 2, None, None]
    assert of(spark, R.without_scheme, "https://a.b/c?d", "http://a.b") == ["/c?d", "/"]
    assert of(spark, R.first_url, "see https://a.b/c. And more", "nothing") == ["https://a.b/c", None]
    chain = lambda c: R.downgrades(F.split(c, " "), F.lit("https://a/z"))
    assert of(spark, chain, "https://a/x", "https://a/x http://a/y", "http://a/x https://a/y") == [False, True, False]
    assert of(spark, lambda c: R.overlaps(T.loose_tokens(c), T.loose_tokens(F.lit("one two three four"))), "one two", "one two three four five", "six", "") == [True, True, False, False]
