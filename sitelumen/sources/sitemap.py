"""Sitemaps and robots files, read from a table of fetched files: (url string, status int, body string), or with the
bytes as they came (``content``, see ``texts``)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitelumen.functions import url as U
from sitelumen.operators.store import by_bytes, settle, small

#: Levels below a first sitemap that are followed, sitemaps and URLs of a site that are read, bytes that a
#: compressed file may unfold to, and the beginning that a file is told by.
DEPTH, MOST_FILES, MOST_URLS, MOST_BYTES, HEAD_CHARS = 5, 400, 20_000, 50 * 1024 * 1024, 2000
_GZIP = b"\x1f\x8b"


def _text(content: bytes) -> str | None:
    """A file's text; gzip is told by its first bytes, and what unfolds to more than MOST_BYTES, or is broken, gives None."""
    out = []
    while content[:2] == _GZIP:
        unfold = zlib.decompressobj(31)
        try:
            out.append(unfold.decompress(content, MOST_BYTES + 1))
        except zlib.error:
            return None
        if not unfold.eof or sum(map(len, out)) > MOST_BYTES:
            return None
        content = unfold.unused_data.lstrip(b"\0")
    return b"".join([*out, b"" if out else content]).decode("utf-8", "replace").removeprefix("\ufeff")


def texts(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``body``, the text of the bytes in ``content``, in their place, and ``bytes``, how many came. No shuffle.

    Rows of Spark's ``binaryFile`` reader will do once they have a ``url`` and a ``status``. A null has neither.
    """
    columns = [c for c in files.columns if c not in (content, "body", "bytes")]
    wanted = files.select(*columns, F.col(content).alias("_content"))
    schema = wanted.select(*columns, F.lit(None).cast("string").alias("body"), F.lit(None).cast("long").alias("bytes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_content"):
            raw = batch.column("_content").to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([None if x is None else _text(x) for x in raw], pa.string()), pa.array([None if x is None else len(x) for x in raw], pa.int64())], [*columns, "body", "bytes"])

    return wanted.mapInArrow(run, schema)


_BLOCK = re.compile(r"<(?:\w+:)?(url|sitemap)(?=[\s>])[^>]*>", re.IGNORECASE)
_END = {name: re.compile(rf"</(?:\w+:)?{name}\s*>", re.IGNORECASE) for name in ("url", "sitemap", "loc", "lastmod")}
_BEGIN = {name: re.compile(rf"<(?:\w+:)?{name}(?=[\s>])[^>]*>", re.IGNORECASE) for name in ("loc", "lastmod")}


def _value(block: str, name: str) -> str | None:
    if (begin := _BEGIN[name].search(block)) and (end := _END[name].search(block, begin.end())):
        text = block[begin.end() : end.start()].strip()
        return text.removeprefix("<![CDATA[").removesuffix("]]>").strip().replace("&amp;", "&") or None
    return None


def _kind(body: str) -> str:
    head = body[:HEAD_CHARS].lower()
    return "index" if "<sitemapindex" in head else "urlset" if "<urlset" in head else "unparseable"


@F.udtf(returnType="sitemap string, kind string, ord int, loc string, lastmod string")
class _Entries:
    """A file's entries, one after the other; a file that is no sitemap has none."""

    def eval(self, file: Row) -> Iterator[tuple]:
        body, at, place = file["body"], 0, 0
        kind = _kind(body)
        while kind != "unparseable" and (begin := _BLOCK.search(body, at)) and (end := _END[begin[1].lower()].search(body, begin.end())):
            block = body[begin.end() : end.start()]
            if (loc := _value(block, "loc")) is not None:
                yield file["url"], kind, place, loc, _value(block, "lastmod")
            at, place = end.end(), place + 1


def kind(body: F.Column) -> F.Column:
    head = F.lower(F.substring(body, 1, HEAD_CHARS))
    return F.when(head.contains("<sitemapindex"), "index").when(head.contains("<urlset"), "urlset").otherwise("unparseable")


def entries(files: DataFrame) -> DataFrame:
    """(sitemap, kind, ord, loc, lastmod): what each file lists, by a table function over partitions by URL; files that can't be read list nothing."""
    read = files.where("status = 200 AND body IS NOT NULL AND url IS NOT NULL").select("url", "body")
    return _Entries(read.asTable().partitionBy("url"))


def robots(files: DataFrame) -> DataFrame:
    """(domain, sitemap): the sitemaps that robots files name."""
    return declared(files).select("domain", "sitemap")


def declared(files: DataFrame) -> DataFrame:
    """(domain, sitemap, ord): the sitemaps that robots files name, in their order."""
    named = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    return files.where("status = 200").select(U.host(F.col("url")).alias("domain"), F.posexplode(named).alias("ord", "sitemap")).select("domain", "sitemap", "ord")


def roots(files: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, sitemap, ord, declared): where reading begins for each of ``domains`` (domain): what its robots file names, and /sitemap.xml, if that isn't among it."""
    named = declared(files).withColumn("declared", F.lit(True))
    usual = domains.select("domain", F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")).alias("sitemap"), F.lit((1 << 31) - 1).alias("ord"), F.lit(False).alias("declared"))
    known = named.select("domain", U.norm_url(F.col("sitemap")).alias("_k"))
    rest = usual.withColumn("_k", U.norm_url(F.col("sitemap"))).join(known, ["domain", "_k"], "left_anti").drop("_k")
    return named.join(domains.select("domain").distinct(), "domain", "left_semi").unionByName(rest)


class Survey(NamedTuple):
    """``files``: (domain, sitemap, depth, parents) of each sitemap; ``urls``: (domain, key, url, sitemaps, lastmod) of each
    page that they list; ``truncated``: (domain, truncated), entries beyond the most URLs of a site, of sites that have such."""

    files: DataFrame
    urls: DataFrame
    truncated: DataFrame


def survey(first: DataFrame, files: DataFrame, depth: int = DEPTH, most_files: int | None = MOST_FILES, most_urls: int | None = MOST_URLS) -> Survey:
    """What the sitemaps in ``first`` (sitemap; perhaps domain and ord), and those that they name, list.

    Sitemaps are read level by level, in order within one, each once, so cycles end; a level of files is one join, and is
    settled. A page's ``url`` and ``lastmod`` are those of its first entry, and ``sitemaps`` names all that list it, the
    first one first. ``most_files`` and ``most_urls`` bound a site; None reads it whole. (A recursive query would follow every path to a file, not every file, and Spark bounds its rows.)
    """
    listed = settle(entries(files).withColumn("k", U.norm_url(F.col("sitemap"))))
    has = lambda c, otherwise: F.col(c) if c in first.columns else otherwise
    place = F.struct(F.lit(0).alias("depth"), F.array(F.coalesce(has("ord", F.lit(0)).cast("int"), F.lit(0))).alias("path"), F.col("sitemap"))
    level = first.where("sitemap IS NOT NULL").select(has("domain", U.host(F.col("sitemap"))).alias("domain"), U.norm_url(F.col("sitemap")).alias("k"), place.alias("place"), F.lit(None).cast("string").alias("parent"))
    index, known, ways = listed.where("kind = 'index'").select("k", "ord", "loc"), None, []
    for _ in range(depth + 1):
        level = settle(level)
        ways.append(level)
        once = level.groupBy("domain", "k").agg(F.min("place").alias("place"))
        once = once if known is None else once.join(known, ["domain", "k"], "left_anti")
        once = settle(once)
        if once.isEmpty():
            break
        ways[-1] = level, once
        known = once.select("domain", "k") if known is None else known.unionByName(once.select("domain", "k"))
        below = F.struct((F.col("place.depth") + 1).alias("depth"), F.concat("place.path", F.array("ord")).alias("path"), F.col("loc").alias("sitemap"))
        level = once.join(index, "k").select("domain", U.norm_url(F.col("loc")).alias("k"), below.alias("place"), F.col("place.sitemap").alias("parent"))
    found = [w for w in ways if isinstance(w, tuple)]
    spark = files.sparkSession
    if not found:
        return Survey(*(spark.createDataFrame([], s) for s in ("domain string, sitemap string, depth int, parents array<string>", "domain string, key string, url string, sitemaps array<string>, lastmod string", "domain string, truncated long")))
    every, once = found[0]
    for more, again in found[1:]:
        every, once = every.unionByName(more), once.unionByName(again)
    order = F.row_number().over(W.Window.partitionBy("domain").orderBy("place.depth", "place.path", "k"))
    once = once.withColumn("n", order)
    once = settle(once if most_files is None else once.where(F.col("n") <= most_files))
    parents = every.where("parent IS NOT NULL").groupBy("domain", "k").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    told = once.join(parents, ["domain", "k"], "left").select("domain", F.col("place.sitemap").alias("sitemap"), F.col("place.depth").alias("depth"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))

    pages = listed.where("kind = 'urlset'").select("k", "ord", "loc", "lastmod").join(once, "k").withColumn("key", U.norm_url(F.col("loc")))
    by = F.struct("n", "ord")
    names = F.transform(F.array_sort(F.collect_set(F.struct("n", "place.sitemap"))), lambda x: x["sitemap"])
    urls = pages.groupBy("domain", "key").agg(F.min(by).alias("by"), F.min_by("loc", by).alias("url"), names.alias("sitemaps"), F.min_by("lastmod", by).alias("lastmod"), F.count(F.lit(1)).alias("entries"))
    if most_urls is None:
        return Survey(told, settle(urls.select("domain", "key", "url", "sitemaps", "lastmod")), spark.createDataFrame([], "domain string, truncated long"))
    # Spark keeps the first rows of each task before it deals them, so a site of any size sends no more than most_urls from each.
    kept = urls.withColumn("_n", F.row_number().over(W.Window.partitionBy("domain").orderBy("by"))).where(F.col("_n") <= most_urls)
    kept = settle(kept.select("domain", "key", "url", "sitemaps", "lastmod", "entries"))
    sums = lambda rows, name: rows.groupBy("domain").agg(F.sum("entries").alias(name))
    rest = sums(urls, "all").join(sums(kept, "kept"), "domain").select("domain", (F.col("all") - F.col("kept")).alias("truncated"))
    return Survey(told, kept.drop("entries"), rest.where("truncated > 0"))


def discover(first: DataFrame, files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(domain, key, url, sitemaps, lastmod): ``survey``'s URLs."""
    return survey(first, files, depth).urls


def report(found: Survey, files: DataFrame, first: DataFrame, today: str) -> DataFrame:
    """sitemaps.FILES with ``domain``: of each sitemap of a survey what its file showed. ``first`` has ``declared``, or all of it is."""
    own = entries(files)
    own = lastmod_flags(own, today).groupBy("sitemap").agg(F.count(F.lit(1)).alias("n"), F.count("lastmod").alias("lastmod_count"), F.count_if("lastmod_invalid").alias("lastmod_invalid"), F.count_if("lastmod_future").alias("lastmod_future"))
    size = F.col("bytes") if "bytes" in files.columns else F.octet_length("body")
    moved = F.col("redirected") if "redirected" in files.columns else F.lit(False)
    seen = files.select(F.col("url").alias("sitemap"), "status", moved.alias("redirected"), F.when(F.col("status") == 200, F.coalesce(kind(F.col("body")), F.lit("unparseable"))).otherwise("error").alias("kind"), size.cast("long").alias("bytes")).dropDuplicates(["sitemap"])
    named = first.where(F.col("declared") if "declared" in first.columns else F.lit(True)).select("domain", "sitemap", F.lit(True).alias("declared")).distinct()
    rows = found.files.join(seen, "sitemap", "left").join(own, "sitemap", "left").join(named, ["domain", "sitemap"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return rows.select("domain", "sitemap", "status", F.coalesce("declared", F.lit(False)).alias("declared"), (F.size("parents") > 0).alias("nested"), F.coalesce("redirected", F.lit(False)).alias("redirected"), F.coalesce("kind", F.lit("error")).alias("kind"), F.when(F.col("kind") == "urlset", F.coalesce("n", F.lit(0))).otherwise(0).cast("int").alias("url_count"), "bytes", count("lastmod_count"), count("lastmod_invalid"), count("lastmod_future"))


#: Fixed value: a date, or a date and time, in the W3C form; a zone may be left out.
W3C_DATE = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"


def lastmod_flags(rows: DataFrame, today: str) -> DataFrame:
    """``rows`` with ``lastmod_invalid`` and ``lastmod_future``, by the W3C form and the day ``today`` (YYYY-MM-DD)."""
    valid = F.col("lastmod").rlike(W3C_DATE)
    return rows.withColumn("lastmod_invalid", F.col("lastmod").isNotNull() & ~valid).withColumn("lastmod_future", valid & (F.substring("lastmod", 1, 10) > today))


def robots_rules(files: DataFrame, agent: str = "googlebot") -> DataFrame:
    """(domain, ord, allow, prefix): the rules that ``agent`` obeys in each domain's robots file, in order.

    The first group that names part of the agent counts, else the first for all agents. An empty Disallow allows
    everything. Files that can't be read have no rules; a file is read whole by one task, and is small.
    """
    lines = files.where("status = 200 AND body IS NOT NULL").select(U.host(F.col("url")).alias("domain"), F.posexplode(F.split("body", r"\r?\n")).alias("ord", "line"))
    part = lambda k: F.regexp_extract("line", r"(?i)^\s*(user-agent|allow|disallow)\s*:\s*([^#]*?)\s*(?:#.*)?$", k)
    said = lines.select("domain", "ord", F.lower(part(1)).alias("field"), part(2).alias("value")).where("field <> ''")
    of = W.Window.partitionBy("domain").orderBy("ord")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(of), F.lit("")) != "user-agent")
    said = said.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(of))
    named = said.where("field = 'user-agent'").select("domain", "group", F.lower("value").alias("agent"))
    mine = F.when((F.col("agent") != "*") & (F.col("agent") != "") & F.lit(agent.lower()).contains(F.col("agent")), F.col("group"))
    chosen = named.groupBy("domain").agg(F.coalesce(F.min(mine), F.min(F.when(F.col("agent") == "*", F.col("group")))).alias("group"))
    rules = said.where("field <> 'user-agent'").join(chosen, ["domain", "group"])
    return rules.select("domain", "ord", ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("prefix"))


def robots_blocked(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``robots_blocked``: whether the first rule of its domain that begins its path, or is a star, forbids it.

    A domain's rules, as many as its robots file has lines, are one array, so each URL meets one row; repeated URLs stay.
    """
    path = F.concat(U.path(F.col(url)), F.regexp_extract(url, r"^[^#?]*(\?[^#]*)", 1))
    of = rules.groupBy(F.col("domain").alias("_d")).agg(F.array_sort(F.collect_list(F.struct("ord", "allow", "prefix"))).alias("_rules"))
    met = urls.join(small(settle(of)), U.host(F.col(url)) == F.col("_d"), "left")
    first = F.get(F.filter("_rules", lambda r: (r["prefix"] == "*") | F.startswith(path, r["prefix"])), F.lit(0))
    return met.select(*(c for c in urls.columns if c != "robots_blocked"), (~F.coalesce(first["allow"], F.lit(True))).alias("robots_blocked"))
