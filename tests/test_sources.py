"""Sitemaps, publishing and streams."""

from urllib import robotparser

import pytest
from pyspark.sql import functions as F

from sitelumen.sources import publish, sitemap
from sitelumen.streaming import watch


def test_discovery(spark):
    index = "<?xml version='1.0'?><sitemapindex><sitemap><loc>https://a.b/one.xml</loc></sitemap><sitemap><loc>https://a.b/index.xml</loc></sitemap></sitemapindex>"
    one = "<urlset><url><loc>https://www.a.b/x/?p=1&amp;q=2</loc><lastmod>2024-01-02</lastmod></url><url><loc><![CDATA[https://a.b/y]]></loc><lastmod>soon</lastmod></url></urlset>"
    two = "<urlset><url><loc>http://a.b/y/</loc></url></urlset>"
    files = spark.createDataFrame(
        [("https://a.b/index.xml", 200, index), ("https://a.b/one.xml", 200, one), ("https://a.b/two.xml", 200, two), ("https://a.b/robots.txt", 200, "User-agent: *\nSitemap: https://a.b/index.xml\nsitemap: https://a.b/two.xml"), ("https://a.b/dead.xml", 404, one), ("https://a.b/null.xml", 200, None)],
        "url string, status int, body string",
    )
    named = sitemap.robots(files.where("url LIKE '%robots.txt'"))
    assert {tuple(r) for r in named.collect()} == {("a.b", "https://a.b/index.xml"), ("a.b", "https://a.b/two.xml")}
    found = {r.key: r for r in sitemap.lastmod_flags(sitemap.discover(named, files), "2023-12-31").collect()}
    assert set(found) == {"a.b/x?p=1&q=2", "a.b/y"}
    # Level by level: two.xml is named by the robots file, one.xml a level below.
    assert found["a.b/y"].sitemaps == ["https://a.b/two.xml", "https://a.b/one.xml"] and found["a.b/y"].url == "http://a.b/y/" and found["a.b/y"].lastmod is None
    assert found["a.b/x?p=1&q=2"].lastmod_future and sitemap.discover(named.limit(0), files).count() == 0


def test_lastmod_forms(spark):
    good = ["2024", "2024-01", "2024-01-01", "2024-01-01T10:00", "2024-01-01T10:00:01", "2024-01-01T10:00:01.5Z", "2024-01-01T10:00+05:30"]
    bad = ["soon", "2024-1-1", "2024-01-01T", "2024-01-01 10:00", "2024-01-01T10", "2024-01-01T10:00+0530", ""]
    rows = sitemap.lastmod_flags(spark.createDataFrame([(x,) for x in [*good, *bad, None]], "lastmod string"), "2023-01-01").collect()
    assert {r.lastmod for r in rows if r.lastmod_invalid} == set(bad) and {r.lastmod for r in rows if r.lastmod_future} == set(good)


def test_gate(spark):
    rows = lambda n, bad: spark.range(n).select((F.col("id") < bad).alias("lost"))
    publish.gate(rows(100, 2), F.col("lost"))
    publish.gate(rows(1139, 9), F.col("lost"))
    for n, bad in ((100, 10), (1139, 802)):
        with pytest.raises(publish.Unreliable):
            publish.gate(rows(n, bad), F.col("lost"))


def test_publish(spark, tmp_path):
    folder = str(tmp_path / "report")
    assert publish.current(spark, folder) is None
    publish.publish(spark.range(3), folder, "2024-01-01")
    publish.publish(spark.range(5), folder, "2024-01-02")
    assert publish.current(spark, folder).count() == 5


def test_tables(spark):
    history = spark.createDataFrame([("k", d) for d in range(14)], "key string, at int")
    kept = publish.appended(history, spark.createDataFrame([("k", 99)], "key string, at int"), ["key"], "at")
    assert sorted(r["at"] for r in kept.collect()) == [*range(3, 14), 99]
    table = publish.upserted(history.limit(1), spark.createDataFrame([("k", 50)], "key string, at int"), ["key"])
    assert [tuple(r) for r in table.collect()] == [("k", 50)]
    todos = publish.overlaid(spark.createDataFrame([("a",), ("b",)], "todo_id string"), spark.createDataFrame([("a", "done", 1)], "todo_id string, status string, x int"))
    assert {r.todo_id: r.status for r in todos.collect()} == {"a": "done", "b": "open"}
    now = spark.createDataFrame([("u", "1"), ("v", "2")], "url string, hash string")
    made = publish.fresh_or_kept(now, spark.createDataFrame([("u", "1", "s"), ("v", "1", "t"), ("v", "2", "")], "url string, hash string, summary string"))
    assert {r.url: r.summary for r in made.collect()} == {"u": "s", "v": None}


def test_new_listings(spark, tmp_path):
    path, out = str(tmp_path / "in"), []
    schema = "domain string, url string"
    batches = [[("a", str(i)) for i in range(20)] + [(None, "x")], [("a", str(i)) for i in range(10, 60)] + [("b", "9")], [("b", "9"), ("b", "8"), ("a", "3"), ("a", None)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        query = watch.new_listings(spark.readStream.schema(schema).parquet(path)).writeStream.option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True)
        query = query.foreachBatch(lambda rows, _: out.append(sorted(tuple(r) for r in rows.collect()))).start()
        query.awaitTermination()
    assert [rows for rows in out if rows] == [sorted(("a", str(i)) for i in range(20, 60)), [("b", "8")]]


def test_event_windows(spark, sf_dir):
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = watch.event_windows(events).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("events")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_robots_rules_equal_the_standard_library(spark):
    bodies = [
        "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow:\n",
        "User-agent: otherbot\nUser-agent: Googlebot # ours\nDisallow: /x\n\nUser-agent: *\nDisallow: /\n",
        "user-agent: *\nallow: /a/b\ndisallow: /a\n\nSitemap: https://s/x.xml",
        "User-agent: otherbot\nDisallow: /\n",
        "Disallow: /no-agent\nUser-agent: *\nDisallow: /q?x=1\n",
        "",
    ]
    paths = ["/", "/a", "/a/b", "/a/b/c", "/x/1", "/q?x=1", "/q", "/no-agent"]
    files = spark.createDataFrame([(f"https://d{i}.com/robots.txt", 200, b) for i, b in enumerate(bodies)] + [("https://dead.com/robots.txt", 404, bodies[1]), ("https://null.com/robots.txt", 200, None)], "url string, status int, body string")
    urls = [f"https://d{i}.com{p}" for i in range(len(bodies)) for p in paths]
    asked = spark.createDataFrame([(u,) for u in [*urls, "https://dead.com/a", "https://unknown.com/a"]], "url string")
    got = {r.url: r.robots_blocked for r in sitemap.robots_blocked(asked, sitemap.robots_rules(files)).collect()}
    for i, body in enumerate(bodies):
        parser = robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        parser.modified()
        for p in paths:
            assert got[f"https://d{i}.com{p}"] == (not parser.can_fetch("Googlebot", f"https://d{i}.com{p}")), (body, p)
    assert not got["https://dead.com/a"] and not got["https://unknown.com/a"] and sitemap.robots_rules(files.limit(0)).count() == 0
