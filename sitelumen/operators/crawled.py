"""A crawl's pages worked out once, for every audit: facts of each page, its links, targets, twins and own words.

``page_facts`` reads the markup; what it gives is settled, and the audits read that snapshot, so they never disagree about
what a page said. What a crawler saw besides the markup comes in columns of the pages, where there are such: ``status``,
``final_url``, ``redirected``, ``downgraded``, ``robots_blocked``, ``x_robots_tag``, ``ttfb_ms``, ``sitemaps`` (names of the
sitemaps that list the page), ``query`` (the search that it earns most for), and speeds as in landing.FACTS.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelumen.functions import url as U
from sitelumen.operators import containment, dissect, shingles
from sitelumen.operators.store import settle

#: Kinds of pages that are to be found for something of their own.
LANDING = ("home", "landing")
#: Kinds of pages that may compete.
COMPETING = ("home", "landing", "blog_post", "blog_category")
#: Properties that a shared page needs; the least similarity of twins, and words that they have.
SHARED, TWINS, TWIN_WORDS = ("title", "description", "image"), 0.7, 60
#: What a crawl may tell besides the markup, and what counts without it.
SEEN = {
    "final_url": "string", "status": "int", "redirected": "boolean", "downgraded": "boolean", "robots_blocked": "boolean", "x_robots_tag": "string", "ttfb_ms": "int", "sitemaps": "array<string>", "query": "string",
    "lcp_ms": "int", "content_lcp_ms": "int", "popup": "boolean", "cls": "double", "bytes": "int",
}


def _or(name: str, otherwise: object) -> Column:
    return F.coalesce(F.col(name), F.lit(otherwise)).alias(name)


def page_facts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, key, site, type, subtype, SEEN and the facts of ``dissect``) of each page, settled.

    ``status`` is 200 where the crawl doesn't tell and the page can be read, else 0. Rows with a null id or URL are left
    out; of rows that repeat an id, one stays.
    """
    seen = [F.col(c).cast(kind).alias(c) if c in pages.columns else F.lit(None).cast(kind).alias(c) for c, kind in SEEN.items()]
    rows = pages.select(F.col(id).alias("page"), F.col(url).alias("url"), *seen, F.col(html).alias("html")).where("page IS NOT NULL AND url IS NOT NULL").dropDuplicates(["page"])
    rows = dissect.with_content(dissect.dissect(rows))
    kind = U.page_type(F.col("url"), F.coalesce("sitemaps", F.array().cast("array<string>")))
    tag = lambda word: F.coalesce(F.col(word), F.lit(False)) | F.lower(F.coalesce("x_robots_tag", F.lit(""))).contains(word)
    rows = rows.withColumns({
        "key": U.norm_url(F.col("url")), "site": U.host(F.col("url")), "type": kind["type"], "subtype": kind["subtype"], "status": F.coalesce("status", F.when(F.col("error").isNull(), 200).otherwise(0)),
        "noindex": tag("noindex"), "nofollow": tag("nofollow"), **{c: F.coalesce(c, F.lit(False)) for c in ("redirected", "downgraded", "robots_blocked", "popup")},
    })
    return settle(rows)


def inlinks(facts: DataFrame) -> DataFrame:
    """(key, inlinks): the different pages that link to each key, itself not counted."""
    each = facts.select(F.col("key").alias("src"), F.explode("internal_links").alias("key")).where("src <> key").distinct()
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("inlinks"))


def unlisted(facts: DataFrame) -> DataFrame:
    """(key, inlinks) of linked keys that are no page of the crawl, the links' own files and queries left out."""
    skipped = r"(?i)\.(?:jpg|jpeg|png|gif|svg|webp|pdf|zip|css|js|xml|ico)$|\?|/wp-|/cdn-cgi/"
    return inlinks(facts).where(~F.col("key").rlike(skipped)).join(facts.select("key").distinct(), "key", "left_anti")


def twins(facts: DataFrame) -> DataFrame:
    """(page, twin): the similarity of each page's main text to that of the most similar other page, where it is TWINS or more.

    Texts of TWIN_WORDS words or more. Pages of one text are twins of similarity 1; different texts are joined by their
    rarest shingles.
    """
    return shingles.most_similar(facts, "page", "text", TWINS, TWIN_WORDS).select(F.col("id").alias("page"), F.col("similarity").alias("twin"))


def targets(facts: DataFrame, brand: str = "") -> DataFrame:
    """``facts`` with ``target``, what each page is to be found for (containment.with_target)."""
    rows = facts.withColumns({"_path": F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "_h1": F.coalesce(F.get("h1", F.lit(0)), F.lit(""))})
    return containment.with_target(rows, "_path", "_h1", "title", "query", brand).drop("_path", "_h1")


def landing_facts(facts: DataFrame, brand: str = "") -> DataFrame:
    """landing.FACTS of the crawl's landing pages: with targets, links from others, twins and own words among them."""
    rows = targets(facts.where(F.col("type").isin(*LANDING)), brand)
    live = facts.where(F.col("type").isin(*LANDING) & (F.col("status") == 200))
    own = shingles.unique_words(live, "page", "text").select(F.col("id").alias("page"), F.col("unique_words").alias("own_words"))
    rows = rows.join(inlinks(facts), "key", "left").join(twins(live), "page", "left").join(own, "page", "left")
    return rows.select(
        "page", "url", "subtype", "status", "redirected", "downgraded", "noindex", "robots_blocked", "canonical_kind", "title", containment.T.without_brand(F.col("title"), brand).alias("title_words"),
        F.col("target.tokens").alias("tokens"), F.col("target.source").alias("keyword_source"), F.col("meta_description").alias("description"), "h1", "heading_skips", F.col("h2_count").alias("h2"),
        F.col("word_count").alias("words"), F.col("word_count_body").alias("body_words"), "own_words", F.col("first_100").alias("intro"), "twin", "images", F.col("img_missing_alt").alias("img_no_alt"),
        "img_no_dims", "img_lazy", F.coalesce("inlinks", F.lit(0)).alias("inlinks"), F.col("nofollow_internal").alias("nofollow"), "generic_anchors", "empty_anchors", F.col("internal_link_count").alias("links"),
        F.col("schema_types").alias("types"), "schema_errors", "questions", sum((F.coalesce(F.col("og")[k], F.lit("")) == "").cast("int") for k in SHARED).alias("og_missing"), "viewport", "lang",
        F.col("mixed_content").alias("mixed"), F.col("head_js_blocking").alias("blocking_js"), F.col("head_css").alias("stylesheets"), "html_bytes", "ttfb_ms", "lcp_ms", "content_lcp_ms", "popup", "cls", "bytes",
    )


def listed_urls(facts: DataFrame) -> DataFrame:
    """sitemaps.URLS of the crawl's pages, each of which is taken to be listed."""
    rows = facts.join(inlinks(facts), "key", "left")
    return rows.select(
        "url", F.greatest(F.lit(1), F.size(F.coalesce("sitemaps", F.array().cast("array<string>")))).alias("sitemaps"), (F.col("status") > 0).alias("found"), F.lit(False).alias("offsite"), (F.col("type") == "home").alias("home"),
        "status", "redirected", "downgraded", "noindex", "canonical_kind", "robots_blocked", "title", F.coalesce(F.get("h1", F.lit(0)), F.lit("")).alias("h1"), F.col("word_count").alias("words"),
        F.col("word_count_body").alias("body_words"), F.coalesce("inlinks", F.lit(0)).cast("int").alias("inlinks"), "content_hash", F.col("mixed_content").alias("mixed"),
    )


def indexable(facts: DataFrame) -> DataFrame:
    """The pages that a search engine may list: live, not forbidden, not naming another page as the one to list, of a kind that is found by search."""
    return facts.where((F.col("status") == 200) & ~F.col("noindex") & (F.coalesce("canonical_kind", F.lit("missing")) != "other") & F.col("type").isin(*COMPETING))


def competitors(facts: DataFrame, brand: str = "") -> DataFrame:
    """(page, tokens, type, set, strength) of the crawl's ``indexable`` pages, for containment.competing."""
    live = targets(indexable(facts), brand)
    sets = shingles.shingle_sets(live, "page", "text").select(F.col("id").alias("page"), "set")
    rows = live.join(inlinks(facts), "key", "left").join(sets, "page", "left")
    strength = containment.strength(F.col("type"), F.col("inlinks"), F.col("word_count"), F.col("url"))
    return rows.select("page", "target.tokens", "type", F.coalesce("set", F.array().cast("array<bigint>")).alias("set"), strength.alias("strength"))


def kept_twins(pairs: DataFrame) -> DataFrame:
    """(page, twin) from pairs (a, b, similarity) that an earlier audit found, each of which stands for both of its pages: for an audit without texts."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("page"), "similarity"), F.struct(F.col("b").alias("page"), "similarity"))).alias("p"))
    return both.groupBy("p.page").agg(F.max("p.similarity").alias("twin"))


def summary(facts: DataFrame, landing: DataFrame, listed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(area, measure, value) of a deep audit: what its parts, all made from one snapshot, add up to.

    ``landing``: the landing audit's findings; ``listed``: the sitemap's; ``pairs``: those of competing pages, or their counts by kind.
    """
    from sitelumen.operators import landing as L
    from sitelumen.operators import sitemaps as M

    def told(area: str, rows: DataFrame, **measures: Column) -> DataFrame:
        each = F.array(*(F.struct(F.lit(name).alias("measure"), F.col(name).cast("long").alias("value")) for name in measures))
        return rows.agg(*(v.alias(k) for k, v in measures.items())).select(F.lit(area).alias("area"), F.explode(each).alias("m")).select("area", "m.measure", "m.value")

    count = F.count(F.lit(1))
    each = {k: F.count_if(F.col("severity") == k) if "severity" in pairs.columns else F.coalesce(F.sum(k), F.lit(0)) for k in ("high", "medium", "low")}
    types = facts.groupBy("type").agg(count.alias("value")).select(F.lit("crawl").alias("area"), F.concat(F.lit("type:"), "type").alias("measure"), "value")
    scored = settle(L.scores(landing))
    grades = {f"grade_{g}": F.count_if(F.col("grade") == g) for g in "ABCDF"}
    parts = [
        told("crawl", facts, pages=count, live=F.count_if(F.col("status") == 200)), types,
        told("landing", scored, pages=count, score=F.bround(F.avg("score")), high=F.coalesce(F.sum("high"), F.lit(0)), **grades),
        told("landing", L.matrix(landing), issues=count, template_issues=F.count_if("template")),
        told("sitemap", M.affected(listed), affected=count), told("sitemap", M.issues(listed), issues=count),
        told("competition", pairs, pairs=each["high"] + each["medium"] + each["low"], **each),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


#: The issues of a site's pages with their severity, what each severity weighs and how much more for all pages, what a failing check of the site costs.
HEALTH = {
    "Broken or unreachable pages": "high", "Missing page title": "high", "Duplicate titles": "medium", "Title longer than 60 characters": "low", "Missing meta description": "medium", "Duplicate meta descriptions": "low",
    "Missing H1": "medium", "Multiple H1s": "low", "No structured data": "medium", "Images without alt text (4+ on page)": "low",
}
WEIGHT, ALL_PAGES, CHECK_COST, LONG_TITLE, BARE_IMAGES = {"high": 12, "medium": 6, "low": 2}, 4, 8, 60, 3


def health_issues(facts: DataFrame) -> DataFrame:
    """(site, issue, severity, pages): the pages of each site that have each of HEALTH's issues, where any has. Titles and descriptions are the same in whatever case."""
    ok = F.col("status") == 200
    rows = facts.select("page", "site", ok.alias("ok"), *(F.when(ok, F.nullif(F.lower(F.col(c)), F.lit(""))).alias(k) for k, c in (("t", "title"), ("d", "meta_description"))), "title_len", "h1", "schema_types", "img_missing_alt")
    for k in ("t", "d"):
        shared = rows.where(F.col(k).isNotNull()).groupBy("site", k).agg(F.count(F.lit(1)).alias(f"n_{k}")).where(F.col(f"n_{k}") > 1)
        rows = rows.join(shared, ["site", k], "left")
    live = lambda says: F.col("ok") & says
    has = [~F.col("ok"), live(F.col("t").isNull()), F.col("n_t").isNotNull(), live(F.col("title_len") > LONG_TITLE), live(F.col("d").isNull()), F.col("n_d").isNotNull(), live(F.size("h1") == 0), live(F.size("h1") > 1), live(F.size("schema_types") == 0), live(F.col("img_missing_alt") > BARE_IMAGES)]
    each = F.filter(F.array(*(F.when(F.coalesce(h, F.lit(False)), F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"))) for h, (name, severity) in zip(has, HEALTH.items(), strict=True))), lambda x: x.isNotNull())
    return rows.select("site", F.explode(each).alias("i")).groupBy("site", "i.issue", "i.severity").agg(F.count(F.lit(1)).alias("pages"))


def health(facts: DataFrame, failing: DataFrame | None = None) -> DataFrame:
    """(site, pages, ok, issues, score) of each site: 100 less what its issues weigh by the share of pages that have them, and what ``failing`` (site, failed) checks of the site itself cost."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHT.items() for x in kv))
    sites = facts.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == 200).alias("ok"))
    found = health_issues(facts).join(sites.select("site", F.col("pages").alias("n")), "site")
    lost = found.groupBy("site").agg(F.count(F.lit(1)).alias("issues"), F.sum(weight[F.col("severity")] * F.least(F.lit(1.0), F.col("pages") / F.col("n")) * ALL_PAGES).alias("lost"))
    rows = sites.join(lost, "site", "left")
    rows = rows.withColumn("failed", F.lit(0)) if failing is None else rows.join(failing.groupBy("site").agg(F.sum("failed").alias("failed")), "site", "left")
    score = F.greatest(F.lit(0), F.bround(F.round(100 - F.coalesce("lost", F.lit(0.0)) - CHECK_COST * F.coalesce("failed", F.lit(0)), 9)).cast("int"))
    return rows.select("site", "pages", "ok", F.coalesce("issues", F.lit(0)).alias("issues"), score.alias("score"))
