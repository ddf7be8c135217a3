"""Page facts from markup, hostile markup too, and the audits that read them."""

import hashlib
import random
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sitelumen.operators import containment, crawled, dissect, landing, shingles, sitemaps

PAGE = """<!doctype html><html lang=en><head><title> A  b &amp; c</title><meta charset=utf-8><meta name=Viewport content=x><meta name=description content="D &lt; E"><meta name=ROBOTS content=NoIndex>
<meta name=description content=second><meta property="og:title" content=T><meta property=og:image content=i.png><meta name=twitter:card content=summary>
<link rel=canonical href=/c><link rel=stylesheet href=a.css><link rel=alternate hreflang=de href=/de><script src=a.js></script><script async src=b.js></script><script type=module src=m.js></script>
<script type="application/ld+json">{"@graph":[{"@type":"Organization"},{"@type":["Course", 7]}]}</script><script type="application/ld+json">{bad</script><script type="application/ld+json"> </script></head>
<body class=modal-open><header>site <p>name</header><nav><a href="/menu" rel=nofollow>Menu</a></nav> tail <div id="login-modal"><p>Log in</p></div><div role=dialog>Dialog</div> kept
<main class=popup><h1>One &amp; <b>only</b></h1><h3>Deep?</h3><p>Some <i>te</i>xt. <a href="/x">Here</a> and more<p>Second<ul><li><a href="y#z">why</a><li>item <a href="mailto:a@b">m</a></ul>
<div aria-hidden=true>Closed panel</div><table><tr><td>cell<td>next</table><a href="//other.com/">out</a><a href="https://www.a.b/q?x=1"><img src=i alt="Pic"></a><a href=" "></a><a href="/empty"></a>
<img src=http://c.d/e.png loading=LAZY alt=""><img data-src=f width=1 height=2></main><noscript>No script</noscript><script>var x = "</p><h2>";</script><iframe src=http://z><p>inner</iframe><footer>&copy; end</footer></body></html>"""


def facts(spark, *pages):
    rows = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id int, url string, html string")
    return dissect.with_content(dissect.dissect(rows)).orderBy("page_id").collect()


def test_facts(spark):
    (r,) = facts(spark, ("https://www.a.b/p/", PAGE))
    assert (r.error, r.title, r.title_len, r.lang, r.meta_description, r.meta_robots, r.canonical, r.canonical_kind) == (None, "A b & c", 7, "en", "D < E", "noindex", "https://www.a.b/c", "other")
    assert (r.viewport, r.charset, r.noindex, r.nofollow) == (True, True, True, False)
    assert r.h1 == ["One & only"] and [(h.level, h.text) for h in r.headings] == [(1, "One & only"), (3, "Deep?")] and (r.heading_skips, r.h2_count, r.questions) == (1, 0, 1)
    assert r.text.split("\n") == ["tail", "kept", "One & only", "Deep?", "Some text. Here and more", "Second", "item m", "Closed panel", "cell", "next"]  # tails stay, chrome and blocks of links go
    assert "site name" in r.body_text and "No script" not in r.body_text and "var x" not in r.body_text and "inner" not in r.body_text
    assert (r.images, r.img_missing_alt, r.img_missing_alt_sample, r.img_empty_alt, r.img_no_dims, r.img_lazy, r.img_alts) == (3, 1, ["f"], 1, 2, 1, ["Pic"])
    assert [(a.url, a.text, a.nofollow) for a in r.anchors] == [("https://www.a.b/menu", "Menu", True), ("https://www.a.b/x", "Here", False), ("https://www.a.b/p/y#z", "why", False), ("https://other.com/", "out", False), ("https://www.a.b/q?x=1", "Pic", False), ("https://www.a.b/empty", "", False)]
    assert r.internal_links == ["a.b/empty", "a.b/menu", "a.b/p/y", "a.b/q?x=1", "a.b/x"] and (r.internal_link_count, r.external_link_count, r.nofollow_internal, r.empty_anchors, r.generic_anchors) == (5, 1, 1, 1, 1)
    assert (r.schema_types, r.schema_errors, r.og.title, r.og.description, r.twitter_card, [(x.lang, x.href) for x in r.hreflang]) == (["7", "Course", "Organization"], 1, "T", "", "summary", [("de", "/de")])
    assert (r.mixed_content, r.mixed_content_urls, r.head_css, r.head_js_blocking, r.scripts, r.iframes, r.html_bytes) == (2, ["http://c.d/e.png", "http://z"], 1, 1, 7, 1, len(PAGE.encode()))
    words = "tail kept One only Deep Some text Here and more Second item m Closed panel cell next".split()
    assert (r.word_count, r.first_100, r.content_hash) == (len(words), " ".join(words), hashlib.sha1(" ".join(words).lower().encode()).hexdigest()[:16])


def test_references_end_in_a_semicolon(spark):
    """a title that is cut within ``&amp;`` keeps what is left of it, as the SQL does."""
    (r,) = facts(spark, ("https://a.b/", "<title>Him &&& her&&amp</title><body><p>one &amp two &amp; three &copy x&copy; &nosuch; &#65; &#x42 &notit;</p>"))
    assert r.title == "Him &&& her&&amp" and r.text == "one &amp two & three &copy x© &nosuch; A &#x42 &notit;" and r.title_len == 16


HOSTILE = {
    "canonical": '<link rel=canonical href="http://[x"><a href="http://[y">bad</a><p>text',
    "declaration": "<![foo[<p>text",
    "deep json": '<script type="application/ld+json">' + '{"@graph":[' * 50_000 + "</script><p>text",
    "deep nesting": "<div>" * 100_000 + "text" + "</span>" * 100_000,
    "surrogates": '<script type="application/ld+json">{"@type": "\\ud800"}</script><p>text &#xD800; &#55296;',
    "long number": "<p>text &#" + "9" * 10_000 + ";",
    "open quote": "<p>text</p><a href='" + "x" * 200_000,
    "comments": "<p>text</p>" + "<!-- " * 100_000,
    "brackets": "<p>text " + "<" * 200_000,
    "attributes": "<p>text</p><p " + "a=b " * 50_000 + ">",
    "equals": "<p>text</p><p " + "= " * 100_000 + ">",
    "headings": "<p>text</p>" + "<h1>x" * 20_000,
    "anchors": "<p>text</p>" + "<a href=/x>" * 20_000,
    "scripts": "<p>text</p>" + "<script>" * 50_000,
    "ends": "<p>text</p>" + "</p></div></a>" * 50_000,
    "nul": "<p>te\0xt text",
}


def test_hostile_pages(spark):
    """Every page gives a row, in time that its length bounds."""
    began = time.time()
    rows = facts(spark, *((f"https://a.b/{k}", h) for k, h in enumerate(HOSTILE.values())), ("http://[x", "<p>text <a href=/y>y</a>"), (None, "<p>text"), ("https://a.b", None), ("https://a.b", ""))
    assert time.time() - began < 60
    for name, r in zip(HOSTILE, rows, strict=False):
        assert r.error is None and "text" in r.text, name
    assert rows[0].canonical == "" and rows[0].anchors == [] and rows[0].canonical_kind == "missing"
    assert [r.schema_errors for r in rows[:5]] == [0, 0, 1, 0, 0] and rows[4].schema_types == ["?"]
    assert rows[-4].text == "text y" and rows[-4].anchors == [] and rows[-3].text == "text" and (rows[-2].error, rows[-2].title, rows[-2].word_count) == ("no page", None, None) and (rows[-1].error, rows[-1].text) == (None, "")


def test_random_markup_never_ends_the_job():
    rng = random.Random(1)
    pieces = ["<", ">", "</", "<p", "<a href=", '"', "'", "=", " ", "&", "&#", ";", "<!--", "-->", "<script>", "</script>", "<title>", "x", "é", "\0", "<h1>", "</h1>", "<![CDATA[", "<?", "/>", "\ud800"]
    for _ in range(3000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        got = dissect.facts("https://a.b/", page)
        assert got["error"] is None


def test_columns_of_a_user_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "https://a.b/", "<p>x", "mine", 5)] * 2, "page_id int, url string, html string, title string, mine int")
    got = dissect.dissect(rows).collect()
    assert [(r.page_id, r.mine, r.title, r.text) for r in got] == [(1, 5, "", "x")] * 2
    assert dissect.dissect(rows.limit(0)).collect() == []


SITE = {
    "/": ("Home of law coaching in the city", "<a href=/law-coaching>a</a><a href=/dup-one>b</a>"),
    "/law-coaching": ("Law coaching", "<a href=/>home</a><a href=/missing>m</a><a href=/file.pdf>f</a>"),
    "/blog/2020/law-coaching-fees": ("Law coaching fees", "<a href=/law-coaching>c</a>"),
    "/dup-one": ("Dup", ""),
    "/dup-two": ("Dup", ""),
    "/orphan": ("Orphan", ""),
}


def crawl(spark, extra=()):
    common = " ".join(f"shared{k}" for k in range(200))
    own = {u: " ".join(f"w{k}{u.strip('/').replace('/', '')[:6]}" for k in range(150)) for u in SITE}
    rows = [(k, f"https://www.s.com{u}", f"<title>{t}</title><h1>{t}</h1><p>{common if 'dup' in u else own[u]}</p>{links}") for k, (u, (t, links)) in enumerate(SITE.items())]
    return crawled.page_facts(spark.createDataFrame([*rows, rows[0], *extra], "page_id int, url string, html string"))


def test_links_twins_and_own_words(spark):
    rows = crawl(spark, [(90, None, "<p>x"), (None, "https://s.com/n", "<p>x"), (91, "https://s.com/dead", None)])
    key = lambda u: "s.com" + (u.rstrip("/") or "/")
    links = {(key(u), key(urljoin(u, h.split(">")[0]))) for u, (_, a) in SITE.items() for h in a.split("href=")[1:]}
    want = {}
    for src, dst in links:
        if src != dst:
            want[dst] = want.get(dst, 0) + 1
    assert {r.key: r.inlinks for r in crawled.inlinks(rows).collect()} == want
    assert {r.key for r in crawled.unlisted(rows).collect()} == {"s.com/missing"}
    assert {r.page: r.twin for r in crawled.twins(rows).collect()} == {3: 1.0, 4: 1.0}
    by = {r.page: r for r in crawled.landing_facts(rows).collect()}
    assert set(by) == {0, 1, 3, 4, 5, 91} and (by[91].status, by[91].title) == (0, None)
    assert by[3].own_words == 201 and by[3].words == 201  # two pages hold its windows, fewer than three
    assert by[5].inlinks == 0 and by[1].inlinks == 2 and by[1].tokens == ["law", "coaching"] and by[1].keyword_source == "url"
    found = {(r.page, r.check) for r in landing.audit(crawled.landing_facts(rows)).where("severity IS NOT NULL").collect()}
    assert {(3, "title-duplicate"), (4, "near-duplicate"), (5, "orphan"), (91, "status")} <= found and (0, "orphan") not in found
    codes = {(r.code, r.subject.removeprefix("https://www.s.com")) for r in sitemaps.diagnose(sitemaps.of_urls(crawled.listed_urls(rows))).collect()}
    assert {("url-orphan", "/orphan"), ("url-non200", "https://s.com/dead")} <= codes and ("url-orphan", "/") not in codes
    pairs = [(r.hub, r.spoke) for r in containment.competing(crawled.competitors(rows)).collect()]
    assert (1, 2) in pairs and (0, 91) not in pairs


def test_summary_adds_the_parts_up(spark):
    rows = crawl(spark, [(91, "https://s.com/dead", None), (92, "https://s.com/law-coaching-2", "<meta name=robots content=noindex><title>Law coaching</title><p>x")])
    found, listed, pairs = landing.audit(crawled.landing_facts(rows)), sitemaps.diagnose(sitemaps.of_urls(crawled.listed_urls(rows))), containment.competing(crawled.competitors(rows))
    told = {(r.area, r.measure): r.value for r in crawled.summary(rows, found, listed, pairs).collect()}
    assert (told["crawl", "pages"], told["crawl", "live"], told["crawl", "type:home"], told["crawl", "type:blog_post"], told["landing", "pages"]) == (8, 7, 1, 1, 7)
    assert sum(told["landing", f"grade_{g}"] for g in "ABCDF") == 7 and told["competition", "pairs"] == pairs.count() and told["sitemap", "issues"] == listed.select("code").distinct().count()
    assert told["landing", "high"] == found.where("severity = 'high'").count()
    assert 92 not in {r.page for r in crawled.indexable(rows).collect()}


def test_health(spark):
    html = lambda t, d="", more="": f"<title>{t}</title>" + (f"<meta name=description content='{d}'>" if d else "") + more
    pages = [("a.com", html("Same", "one", "<h1>x</h1>")), ("a.com", html("SAME", "One", "<h1>x</h1><h1>y</h1>")), ("a.com", html("", "", "<img>" * 4)), ("a.com", None), ("b.com", html("x" * 61, "d", '<h1>x</h1><script type="application/ld+json">{"@type":"A"}</script>'))]
    rows = crawled.page_facts(spark.createDataFrame([(k, f"https://{s}/{k}", h) for k, (s, h) in enumerate(pages)], "page_id int, url string, html string"))
    issues = {(r.site, r.issue): r.pages for r in crawled.health_issues(rows).collect()}
    assert issues == {
        ("a.com", "Broken or unreachable pages"): 1, ("a.com", "Missing page title"): 1, ("a.com", "Duplicate titles"): 2, ("a.com", "Missing meta description"): 1, ("a.com", "Duplicate meta descriptions"): 2,
        ("a.com", "Missing H1"): 1, ("a.com", "Multiple H1s"): 1, ("a.com", "No structured data"): 3, ("a.com", "Images without alt text (4+ on page)"): 1, ("b.com", "Title longer than 60 characters"): 1,
    }
    lost = 4 * (12 / 4 + 12 / 4 + 6 / 2 + 6 / 4 + 2 / 2 + 6 / 4 + 2 / 4 + 6 * 3 / 4 + 2 / 4)
    failing = spark.createDataFrame([("b.com", 2), ("b.com", 1)], "site string, failed int")
    assert {r.site: (r.pages, r.ok, r.issues, r.score) for r in crawled.health(rows, failing).collect()} == {"a.com": (4, 3, 9, round(100 - lost)), "b.com": (1, 1, 1, 100 - 8 - 24)}


def test_kept_twins(spark):
    rows = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.95)], "a int, b int, similarity double")
    assert {r.page: r.twin for r in crawled.kept_twins(rows).collect()} == {1: 0.9, 2: 0.95, 3: 0.95}


def test_what_the_crawl_saw_counts(spark):
    rows = spark.createDataFrame([(1, "https://s.com/a", "<p>x", 404, "noindex", ["post-sitemap.xml"], True)], "page_id int, url string, html string, status int, x_robots_tag string, sitemaps array<string>, redirected boolean")
    (r,) = crawled.page_facts(rows).collect()
    assert (r.status, r.noindex, r.redirected, r.downgraded, r.type) == (404, True, True, False, "landing")
    assert crawled.page_facts(rows.limit(0)).collect() == []


@pytest.mark.parametrize("least", [0.7, 0.5])
def test_most_similar_by_brute_force(spark, least):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(500)}" for _ in range(70)] for _ in range(5)]
    texts = []
    for k in range(40):
        w = list(base[k % 5])
        for _ in range(rng.randrange(6)):
            w[rng.randrange(70)] = f"x{rng.randrange(900)}"
        texts.append((k, " ".join(w)))
    texts += [(100, texts[0][1]), (101, None), (102, "short")]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in texts if t and len(t.split()) >= 60}
    want = {}
    for i in sets:
        best = max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in sets if j != i)
        if best >= least:
            want[i] = round(best, 9)
    got = {r.id: round(r.similarity, 9) for r in shingles.most_similar(spark.createDataFrame(texts, "doc_id long, text string"), least=least).collect()}
    assert got == want and want


def test_by_bytes_keeps_rows(spark):
    rows = spark.createDataFrame([(k, "x" * (3000 * k), f"https://a.b/{k}") for k in range(60)], "page_id int, html string, url string")
    big = rows.withColumn("html", F.concat(F.lit("<p>"), F.repeat("html", 40)))
    assert sorted(r.page_id for r in dissect.dissect(big).select("page_id").collect()) == list(range(60))
