"""The keyword pool and to-dos from ranks against plain Python."""

import random

from sitelumen.operators import pool


def test_pool_by_brute_force(spark):
    rng = random.Random(3)
    name = lambda: rng.choice(["Alpha", " alpha ", "beta", "BETA two", "", None, "best gamma price", "delta near me"])
    key = lambda k: (k or "").strip().lower()
    stats = [(name(), rng.choice(["/a", "/b", "", None]), rng.randrange(9), rng.randrange(90), rng.uniform(0.5, 40), rng.random(), f"{k:04}") for k in range(25)]
    seeds, clusters = [(name(), f"{k:04}") for k in range(6)], [(name(), rng.choice(["c1", "c2", "", None]), f"{k:04}") for k in range(12)]
    topics = [(name(), rng.choice(["t1", "t2", "", None]), f"{k:04}") for k in range(12)]
    want = {}

    def touch(k, source):
        if not key(k):
            return {}
        row = want.setdefault(key(k), {"sources": [], "cluster": None, "page": "", "clicks": 0, "impressions": 0, "position": 0.0})
        if source not in row["sources"]:
            row["sources"].append(source)
        return row

    for q, page, clicks, impressions, position, _, _ in stats:
        if row := touch(q, "search-console"):
            row |= {"clicks": clicks, "impressions": impressions, "position": round(position, 1), "page": page or row["page"]}
    for k, _ in seeds:
        touch(k, "seed")
    for k, c, _ in clusters:
        if (row := touch(k, "keyword-lab")) and c:
            row["cluster"] = c
    for k, c, _ in topics:
        if (row := touch(k, "blog-plan")) and c:
            row["cluster"] = row["cluster"] or c
    got = pool.pool(
        spark.createDataFrame(stats, "query string, page string, clicks long, impressions long, position double, ctr double, ord string"), spark.createDataFrame(seeds, "keyword string, ord string"),
        spark.createDataFrame(clusters, "keyword string, cluster string, ord string"), spark.createDataFrame(topics, "keyword string, cluster string, ord string"),
    )
    rows = {r.keyword: r for r in got.collect()}
    assert {k: {c: rows[k][c] for c in next(iter(want.values()))} for k in rows} == want
    assert all(r.ranked == (r.position > 0) and r.thin == (r.impressions < 30) for r in rows.values()) and rows["delta near me"].intent == "local"
    told = {r.band: r for r in pool.totals(got).collect()}
    assert set(told) == {*pool.BANDS, "all"} and told["all"].keywords == len(want) == sum(told[b].keywords for b in pool.BANDS) and told["all"].clicks == sum(r["clicks"] for r in want.values())
    order = [r.keyword for r in pool.in_order(got).collect()]
    assert order == sorted(order, key=lambda k: (-rows[k].opportunity, -rows[k].impressions, k))


def test_rank_todos(spark):
    rows = [("b", "2024-01", "old", 1, None), ("b", "2024-02", "fell", 3, None), ("b", "2024-02", "near", 9, None), ("b", "2024-02", "gone", 2, None)]
    rows += [("b", "2024-03", "fell", 6, ["x"]), ("b", "2024-03", "near", 8, None), ("b", "2024-03", "gone", None, ["p", "q", "r", "s"]), ("b", "2024-03", "top", 1, None), ("b", "2024-03", "far", 40, None)]
    rows += [("one", "2024-03", f"k{k:02}", None, None) for k in range(40)]
    got = pool.rank_todos(spark.createDataFrame(rows, "brand string, snapshot string, keyword string, position int, top array<string>")).collect()
    mine = [(r.kind, r.keyword, r.position) for r in sorted(got, key=lambda r: r.place) if r.brand == "b"]
    assert mine == [("rank_drop", "fell", 6), ("striking", "fell", 6), ("striking", "near", 8), ("unranked", "gone", 0)]
    why = {(r.kind, r.keyword): r.why for r in got}
    assert why["rank_drop", "fell"].startswith("Fell #3 → #6") and why["unranked", "gone"].endswith("owned by p, q, r") and why["striking", "near"].endswith("reach #5")
    assert len([r for r in got if r.brand == "one"]) == 25 and len({r.todo_id for r in got}) == len(got)
