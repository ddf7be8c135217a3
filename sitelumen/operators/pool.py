"""The keyword pool: one row a keyword over four sources in their order of arrival, and to-dos from ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitelumen.functions import scoring as S
from sitelumen.functions import text as T

#: The sources in their order, impressions under which a keyword's numbers say little, the bands.
SOURCES = ("search-console", "seed", "keyword-lab", "blog-plan")
THIN_IMPRESSIONS = 30
BANDS = ("top3", "page1", "page2", "beyond", "unranked")
#: Places lost that are a drop, places from which a page can be lifted, owners that are named, to-dos of a brand.
DROP, STRIKING, OWNERS, MOST_TODOS = 2, (4, 15), 3, 25


def _touched(rows: DataFrame, source: int, keyword: str, ord: str, **more: Column) -> DataFrame:
    fields = {"cluster": "string", "page": "string", "clicks": "long", "impressions": "long", "position": "double", "ctr": "double"}
    columns = (more.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields.items())
    return rows.select(F.lower(F.trim(F.col(keyword))).alias("keyword"), F.lit(source).alias("source"), F.col(ord).cast("string").alias("ord"), *columns).where("keyword <> ''")


def pool(stats: DataFrame, seeds: DataFrame, clusters: DataFrame, topics: DataFrame) -> DataFrame:
    """(keyword, sources, cluster, intent, page, clicks, impressions, position, ctr, opportunity, thin, ranked, band) of every keyword.

    ``stats``: (query, page, clicks, impressions, position, ctr, ord); ``seeds``: (keyword, ord); ``clusters``: (keyword,
    cluster, ord); ``topics``: (keyword, cluster, ord). ``ord`` is the order of arrival within a source, compared as text. The
    last search row of a keyword gives its numbers, and the last one with a page its page; the last list that names a
    cluster gives that, else the first topic that does. Keywords are told apart in lower case, trimmed; null and empty ones are
    none. One aggregation, partial in each task, so a keyword that most rows have costs no more than others.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = _touched(stats, 0, "query", "ord", page=F.nullif(F.col("page"), F.lit("")), clicks=number("clicks"), impressions=number("impressions"), position=F.round(number("position"), 1), ctr=F.round(number("ctr"), 4))
    rows = rows.unionByName(_touched(seeds, 1, "keyword", "ord"))
    for source, named in ((2, clusters), (3, topics)):
        rows = rows.unionByName(_touched(named, source, "keyword", "ord", cluster=F.nullif(F.col("cluster"), F.lit(""))))
    of = lambda source, value: F.when(F.col("source") == source, value)
    last = F.max_by(F.struct("clicks", "impressions", "position", "ctr"), of(0, F.struct("ord", F.col("page").isNotNull(), "page")))
    named = of(2, F.when(F.col("cluster").isNotNull(), F.struct("ord", "cluster")))
    planned = of(3, F.when(F.col("cluster").isNotNull(), F.struct("ord", "cluster")))
    paged = F.when(F.col("page").isNotNull(), F.struct("ord", "page"))
    each = rows.groupBy("keyword").agg(
        F.array_sort(F.collect_set("source")).alias("s"), F.max(named)["cluster"].alias("a"), F.min(planned)["cluster"].alias("b"), F.max(paged)["page"].alias("page"), last.alias("m")
    )
    names = F.array(*map(F.lit, SOURCES))
    m = lambda c, zero: F.coalesce(F.col(f"m.{c}"), F.lit(zero)).alias(c)
    rows = each.select("keyword", F.transform("s", lambda k: F.get(names, k)).alias("sources"), F.coalesce("a", "b").alias("cluster"), F.coalesce("page", F.lit("")).alias("page"), m("clicks", 0), m("impressions", 0), m("position", 0.0), m("ctr", 0.0))
    return rows.withColumns({
        "intent": T.intent(F.col("keyword")), "opportunity": S.opportunity(F.col("impressions"), F.col("clicks"), F.col("position")), "thin": F.col("impressions") < THIN_IMPRESSIONS,
        "ranked": F.col("position") > 0, "band": S.band(F.col("position")),
    })


def in_order(rows: DataFrame) -> DataFrame:
    """A pool by what it promises."""
    return rows.orderBy(F.desc("opportunity"), F.desc("impressions"), "keyword")


def totals(rows: DataFrame) -> DataFrame:
    """(band, keywords, ranked, thin, clicks, impressions, opportunity) of a pool: of each of BANDS, those without keywords too, and of ``all``."""
    each = rows.select(F.explode(F.array("band", F.lit("all"))).alias("band"), "ranked", "thin", "clicks", "impressions", "opportunity")
    sums = each.groupBy("band").agg(F.count(F.lit(1)).alias("keywords"), F.count_if("ranked").alias("ranked"), F.count_if("thin").alias("thin"), *(F.sum(c).alias(c) for c in ("clicks", "impressions", "opportunity")))
    every = rows.sparkSession.createDataFrame([(b,) for b in (*BANDS, "all")], "band string")
    return F.broadcast(every).join(sums, "band", "left").fillna(0)


def rank_todos(ranks: DataFrame) -> DataFrame:
    """(brand, todo_id, kind, keyword, position, action, why, place) from (brand, snapshot, keyword, position, top): of each brand's last snapshot, against the one before it.

    A fall of DROP places or more comes first, then keywords within STRIKING, then those without a place; by place, and then by
    keyword; MOST_TODOS a brand. ``position`` is null where a keyword isn't found, and then ``top`` names who is.
    """
    of = W.Window.partitionBy("brand").orderBy(F.desc("snapshot"))
    snapshots = ranks.select("brand", "snapshot").distinct().withColumn("age", F.row_number().over(of)).where("age <= 2")
    recent = ranks.join(snapshots, ["brand", "snapshot"])
    now = recent.where("age = 1").select("brand", "keyword", "position", "top")
    before = recent.where("age = 2").select("brand", "keyword", F.col("position").alias("before"))
    pos, old = F.col("position"), F.col("before")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    owners = F.array_join(F.slice(F.coalesce("top", F.array().cast("array<string>")), 1, OWNERS), ", ")
    todo = lambda when, kind, priority, action, why: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), action.alias("action"), why.alias("why")))
    made = F.array(
        todo(pos - old >= DROP, "rank_drop", 0, text("Investigate the ranking drop for '", F.col("keyword"), "'"), text("Fell #", old, " → #", pos, " since the last check — likely a competitor update or stale content")),
        todo(pos.isNull(), "unranked", 2, text("Create or strengthen a page targeting '", F.col("keyword"), "'"), text("Not in the top 10 — currently owned by ", owners)),
        todo(pos.between(*STRIKING), "striking", 1, text("Refresh the page targeting '", F.col("keyword"), "'"), text("Ranks #", pos, " — a content refresh can realistically reach #", F.greatest(F.lit(3), pos - 3))),
    )
    rows = now.join(before, ["brand", "keyword"], "left").select("brand", "keyword", "position", F.explode(F.filter(made, lambda t: t.isNotNull())).alias("t"))
    order = W.Window.partitionBy("brand").orderBy("t.priority", F.coalesce("position", F.lit(99)), "keyword")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_TODOS)
    return rows.select("brand", T.short_hash(F.col("brand"), F.col("t.kind"), F.lit(""), F.col("keyword")).alias("todo_id"), "t.kind", "keyword", F.coalesce("position", F.lit(0)).alias("position"), "t.action", "t.why", "place")
