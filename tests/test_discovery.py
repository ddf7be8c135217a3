"""Sitemaps level by level, from files as they came."""

import gzip
import time

from pyspark.sql import functions as F

from sitelumen.operators import sitemaps
from sitelumen.sources import sitemap

INDEX = "<?xml version='1.0'?><sitemapindex>{}</sitemapindex>"
SET = "<urlset>{}</urlset>"


def index(*locs):
    return INDEX.format("".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs))


def urls(*rows):
    return SET.format("".join(f"<url><loc>{u}</loc>{f'<lastmod>{m}</lastmod>' if m else ''}</url>" for u, m in rows))


def files_of(spark, bodies):
    rows = [(u, 200 if b is not None else 404, b if isinstance(b, bytes) else (b or "").encode(), False) for u, b in bodies.items()]
    return sitemap.texts(spark.createDataFrame(rows, "url string, status int, content binary, redirected boolean"))


def test_levels_cycles_and_first_entries(spark):
    s = "https://s.com"
    bodies = {
        f"{s}/robots.txt": f"User-agent: *\nSitemap: {s}/main.xml\nSITEMAP: {s}/extra.xml",
        f"{s}/main.xml": index(f"{s}/b.xml", f"{s}/sub.xml", f"{s}/main.xml", f"{s}/gone.xml", f"{s}/a.xml.gz"),
        f"{s}/sub.xml": index(f"{s}/main.xml", f"{s}/a.xml.gz", f"{s}/deep.xml"),
        f"{s}/deep.xml": urls((f"{s}/deep", "2030-01-01")),
        f"{s}/a.xml.gz": gzip.compress(urls((f"{s}/x?p=1&amp;q=2", "2024-01-02"), (f"{s}/both", "first?")).encode()) + gzip.compress(b"<!-- more -->"),
        f"{s}/b.xml": urls((f"http://www.s.com/both/", None), (f"{s}/only-b", None)).replace("<loc>", "<x:loc a='b'><![CDATA[ ").replace("</loc>", " ]]></x:loc>"),
        f"{s}/extra.xml": urls((f"{s}/only-b", "2020"), (f"{s}/extra", None)),
        f"{s}/sitemap.xml": "not xml at all",
        f"{s}/gone.xml": None,
    }
    files = files_of(spark, bodies)
    first = sitemap.roots(files.where("url LIKE '%robots.txt'"), spark.createDataFrame([("s.com",), ("other.com",)], "domain string"))
    assert {(r.domain, r.sitemap, r.declared) for r in first.collect()} == {("s.com", f"{s}/main.xml", True), ("s.com", f"{s}/extra.xml", True), ("s.com", f"{s}/sitemap.xml", False), ("other.com", "https://other.com/sitemap.xml", False)}
    found = sitemap.survey(first, files)
    assert {(r.sitemap.removeprefix(s), r.depth, tuple(p.removeprefix(s) for p in r.parents)) for r in found.files.where("domain = 's.com'").collect()} == {
        ("/main.xml", 0, ("/main.xml", "/sub.xml")), ("/extra.xml", 0, ()), ("/sitemap.xml", 0, ()), ("/b.xml", 1, ("/main.xml",)), ("/sub.xml", 1, ("/main.xml",)), ("/gone.xml", 1, ("/main.xml",)), ("/a.xml.gz", 1, ("/main.xml", "/sub.xml")), ("/deep.xml", 2, ("/sub.xml",))
    }
    got = {r.key: (r.url, [x.removeprefix(s) for x in r.sitemaps], r.lastmod) for r in found.urls.collect()}
    assert got == {
        "s.com/only-b": (f"{s}/only-b", ["/extra.xml", "/b.xml"], "2020"), "s.com/extra": (f"{s}/extra", ["/extra.xml"], None), "s.com/both": ("http://www.s.com/both/", ["/b.xml", "/a.xml.gz"], None),
        "s.com/x?p=1&q=2": (f"{s}/x?p=1&q=2", ["/a.xml.gz"], "2024-01-02"), "s.com/deep": (f"{s}/deep", ["/deep.xml"], "2030-01-01"),
    }
    told = {r.sitemap.removeprefix(s): r for r in sitemap.report(found, files, first, "2025-01-01").where("domain = 's.com'").collect()}
    assert (told["/a.xml.gz"].kind, told["/a.xml.gz"].url_count, told["/a.xml.gz"].lastmod_invalid, told["/a.xml.gz"].nested, told["/a.xml.gz"].bytes) == ("urlset", 2, 1, True, len(bodies[f"{s}/a.xml.gz"]))
    assert (told["/deep.xml"].lastmod_future, told["/sitemap.xml"].kind, told["/gone.xml"].kind, told["/main.xml"].declared, told["/sub.xml"].url_count) == (1, "unparseable", "error", True, 0)
    codes = {(r.code, r.subject.removeprefix(s)) for r in sitemaps.of_files(sitemap.report(found, files, first, "2025-01-01").drop("domain")).collect()}
    assert {("sitemap-child-dead", "/gone.xml"), ("sitemap-unparseable", "/sitemap.xml"), ("lastmod-future", "/deep.xml"), ("sitemap-nested-index", "/sub.xml")} <= codes


def test_caps_keep_the_first_and_count_the_rest(spark):
    s = "https://s.com"
    bodies = {f"{s}/i.xml": index(*(f"{s}/{k}.xml" for k in range(6)))} | {f"{s}/{k}.xml": urls(*((f"{s}/p{k}-{j}", None) for j in range(10)), (f"{s}/p0-0", None)) for k in range(6)}
    first = spark.createDataFrame([(f"{s}/i.xml",)], "sitemap string")
    found = sitemap.survey(first, files_of(spark, bodies), most_files=4, most_urls=15)  # the index and three sets
    assert {r.key for r in found.urls.collect()} == {f"s.com/p0-{j}" for j in range(10)} | {f"s.com/p1-{j}" for j in range(5)}
    assert [tuple(r) for r in found.truncated.collect()] == [("s.com", 15)] and found.files.count() == 4
    assert [r.sitemaps for r in found.urls.where("key = 's.com/p0-0'").collect()] == [[f"{s}/{k}.xml" for k in range(3)]]


def test_depth_is_bounded_and_empty_tables(spark):
    s = "https://s.com"
    bodies = {f"{s}/{k}.xml": index(f"{s}/{k + 1}.xml") for k in range(9)}
    first = spark.createDataFrame([(f"{s}/0.xml",)], "sitemap string")
    assert sorted(r.depth for r in sitemap.survey(first, files_of(spark, bodies)).files.collect()) == [0, 1, 2, 3, 4, 5]
    assert all(x.count() == 0 for x in sitemap.survey(first.limit(0), files_of(spark, bodies)))
    assert sitemap.survey(first, files_of(spark, bodies).limit(0)).urls.count() == 0


def test_hostile_files_are_read_in_linear_time(spark):
    bomb = gzip.compress(b"<urlset>" + b"<url><loc>https://s.com/a</loc></url>" * 2_000_000)
    bodies = {"https://s.com/bomb": bomb, "https://s.com/cut": gzip.compress(urls(("https://s.com/x", None)).encode())[:-9], "https://s.com/open": "<urlset>" + "<url>" * 300_000, "https://s.com/locs": "<urlset><url>" + "<loc>" * 300_000 + "</url>", "https://s.com/bad": b"\x1f\x8bnothing"}
    began = time.time()
    rows = files_of(spark, bodies)
    assert {r.url for r in rows.where("body IS NULL").collect()} == {"https://s.com/bomb", "https://s.com/cut", "https://s.com/bad"}
    assert sitemap.entries(rows).count() == 0 and time.time() - began < 60


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(gzip.compress(urls(("https://s.com/x", None)).encode()))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.concat(F.lit("https://s.com/"), F.regexp_extract("path", "([^/]*)$", 1)).alias("url"), F.lit(200).alias("status"), "content")
    assert [r.key for r in sitemap.discover(spark.createDataFrame([("https://s.com/a.xml",)], "sitemap string"), sitemap.texts(files)).collect()] == ["s.com/x"]


def test_a_site_of_any_size_is_listed_whole(spark, tmp_path):
    """one host with more pages than a survey reads by default."""
    from sitelumen.plans import discovery

    n = sitemap.MOST_URLS + 10
    spark.range(n).selectExpr("id AS page_id", "concat('https://a.b/', id) AS url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    assert discovery.discovered_urls(spark, str(tmp_path)).count() == n
