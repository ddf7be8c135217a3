"""Tables that several writers change, remembered keywords, the trail, and themes that nobody covers."""

import random
import threading
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelumen.operators import themes
from sitelumen.sources import versioned
from sitelumen.streaming import memo, trail


def table(spark, tmp_path):
    return versioned.VersionedTable(spark, str(tmp_path / "t"))


def brands(spark, *rows):
    return spark.createDataFrame(rows, "id string, name string, enabled boolean")


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    ready, failed, halves, stop = threading.Barrier(5), [], [], threading.Event()

    def write(who):
        ready.wait()
        try:
            for k in range(4):
                versioned.create(table(spark, tmp_path), brands(spark, (f"{who}-{k}", "n", True)), ["id"])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    def read():
        ready.wait()
        while not stop.is_set():
            now = table(spark, tmp_path).current()
            if now.path is not None:
                n = spark.read.parquet(now.path).count()
                if n != now.number:  # each version has one row more
                    halves.append((now.number, n))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    reader = threading.Thread(target=read)
    for t in [*threads, reader]:
        t.start()
    for t in threads:
        t.join()
    stop.set()
    reader.join()
    assert not failed and not halves
    t = table(spark, tmp_path)
    assert t.current().number == 16 and {r.id for r in t.read().collect()} == {f"{w}-{k}" for w in range(4) for k in range(4)}


def test_conflicts_are_made_again_or_given_up(spark, tmp_path):
    t, calls = table(spark, tmp_path), []
    versioned.put(t, brands(spark, ("a", "A", True)), ["id"])

    def slow(now, about):
        calls.append(sorted(r.id for r in now.collect()))
        if len(calls) == 1:  # another writer is first
            versioned.put(table(spark, tmp_path), brands(spark, ("b", "B", True)), ["id"])
        return now.unionByName(brands(spark, ("c", "C", True))), {"by": "slow"}

    assert t.change(slow).number == 3 and calls == [["a"], ["a", "b"]] and t.current().about == {"by": "slow"}
    assert {r.id for r in t.read().collect()} == {"a", "b", "c"}

    def never(now, about):
        versioned.put(table(spark, tmp_path), brands(spark, ("d", "D", True)), ["id"])
        return now, about

    with pytest.raises(versioned.Conflict):
        t.change(never, retries=1)
    n = t.current().number
    with pytest.raises(ZeroDivisionError):
        t.change(lambda now, about: 1 / 0)
    assert t.current().number == n and t.change(lambda now, about: None).number == n


def test_registry_and_old_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read() is None and versioned.listed(t) is None and t.current().number == 0 and versioned.remove(t, brands(spark).select("id")).number == 0
    versioned.create(t, brands(spark, ("1", "beta", True), ("2", "Alpha", False)), ["id"])
    with pytest.raises(ValueError, match="already there"):
        versioned.create(t, brands(spark, ("2", "x", True)), ["id"])
    versioned.put(t, brands(spark, ("1", "gamma", None)), ["id"])
    assert [r.name for r in versioned.listed(t).collect()] == ["Alpha", "gamma"] and [r.name for r in versioned.listed(t, enabled="enabled").collect()] == ["gamma"]
    versioned.remove(t, spark.createDataFrame([("2",), ("9",)], "id string"))
    assert [r.id for r in t.read().collect()] == ["1"]
    assert t.vacuum() == [1] and t.vacuum() == [] and len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert [r.id for r in t.read().collect()] == ["1"]


def test_a_manifest_that_is_not_whole_is_no_version(spark, tmp_path):
    t = table(spark, tmp_path)
    versioned.put(t, brands(spark, ("a", "A", True)), ["id"])
    (tmp_path / "t" / "manifest" / "000000000002.json").write_text('{"path": ')
    assert t.current().number == 1 and [r.id for r in t.read().collect()] == ["a"]


# Remembered keywords


def sightings(seed, n=400):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(f"u{rng.randrange(12)}", start + timedelta(hours=rng.randrange(24 * 400)), f"look{rng.randrange(3)}", rng.choice([None, None, None, "asked for"]), rng.choice([None, f"kw{rng.randrange(5)}"])) for _ in range(n)]
    rows += [("edge", start, "a", None, "first"), ("edge", start + timedelta(days=60), "a", None, "late"), ("edge", start + timedelta(days=120, seconds=1), "a", None, None), ("edge", start + timedelta(days=121), "a", None, "anew")]
    return sorted(rows, key=lambda r: r[1])


def plainly(rows):
    memos, out = {}, Counter()
    for url, ts, fp, query, keyword in rows:
        m = memos.get(url)
        if m and ts - m["seen"] > timedelta(days=60):
            m = memos.pop(url) and None
        if query:
            got = query, "search-console"
        elif m and m["fp"] == fp:
            got = m["keyword"], "remembered"
        elif keyword:
            memos[url] = m = {"keyword": keyword, "fp": fp, "seen": ts}
            got = keyword, "model"
        else:
            got = None, "none"
        if m:
            m["seen"] = ts
        out[url, ts, *got] += 1
    return out


def told(rows):
    return Counter((r.url, r.ts.astimezone(UTC), r.keyword, r.source) for r in rows)


def test_memo_of_a_table(spark):
    rows = sightings(1)
    got = memo.chosen(spark.createDataFrame([*rows, (None, rows[0][1], "x", None, "k"), ("u", None, "x", None, "k")], memo.SIGHTINGS).repartition(5)).collect()
    assert told(got) == plainly(rows)
    edge = [(r.keyword, r.source) for r in sorted(got, key=lambda r: r.ts) if r.url == "edge"]
    assert edge == [("first", "model"), ("first", "remembered"), (None, "none"), ("anew", "model")]
    assert memo.chosen(spark.createDataFrame([], memo.SIGHTINGS)).collect() == []


def test_memo_of_a_stream_equals_that_of_the_table(spark, tmp_path):
    rows, out = sightings(2), []
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(4):
            spark.createDataFrame(rows[k * 101 : (k + 1) * 101], memo.SIGHTINGS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = memo.chosen_stream(spark.readStream.schema(memo.SIGHTINGS).parquet(str(tmp_path / "in")))
            query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
            query.foreachBatch(lambda batch, _: out.extend(batch.collect())).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept) if kept else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert told(out) == told(memo.chosen(spark.createDataFrame(rows, memo.SIGHTINGS)).collect()) == plainly(rows)


# The trail


def activity(k, run=None, status=None, at=0):
    return (f"e{k}", run, "agent", "user", "ask", f"  task {k} " + "x" * 400, "brand", status, datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=at or k))


def test_trail_takes_in_each_batch_once(spark, tmp_path):
    t, schema = trail.Trail(spark, str(tmp_path / "trail")), trail.ACTIVITIES
    assert t.events() is None
    first = spark.createDataFrame([activity(1, "r", "running"), activity(2, "r", "running"), activity(2, "r", "running"), activity(3), (None, *activity(4)[1:])], schema)
    t.write(first, 0)
    t.write(first, 0)  # again, as after a failure
    assert sorted(r.event_id for r in t.events().collect()) == ["e1", "e2", "e3"]
    t.write(spark.createDataFrame([activity(5, "r", "failed"), activity(6, "r", "completed", at=9)], schema), 1)
    runs = {r.run_id: r for r in t.runs.read().collect()}
    assert (runs["r"].status, runs["r"].events, runs["e3"].status, runs["e3"].events) == ("completed", 4, "completed", 1)
    row = t.events().where("event_id = 'e1'").first()
    assert len(row.task) == 300 and row.task.startswith("task 1 x") and row.day == "2024-01-01"


def test_trail_after_a_failure_between_its_steps(spark, tmp_path, monkeypatch):
    t, schema = trail.Trail(spark, str(tmp_path / "trail")), trail.ACTIVITIES
    rows = spark.createDataFrame([activity(1, "r"), activity(2, "r")], schema)
    change = versioned.VersionedTable.change
    monkeypatch.setattr(versioned.VersionedTable, "change", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.write(rows, 0)
    assert t.events() is None  # written, but not in
    monkeypatch.setattr(versioned.VersionedTable, "change", change)
    t.write(rows, 0)
    t.write(rows, 0)
    assert t.events().count() == 2 and t.runs.read().first().events == 2


def test_trail_of_a_stream_that_starts_again(spark, tmp_path):
    t, schema = trail.Trail(spark, str(tmp_path / "trail")), trail.ACTIVITIES
    for k in range(3):
        spark.createDataFrame([activity(10 * k + j, "r") for j in range(1, 4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # the second time there is nothing new
            t.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.event_id for r in t.events().collect()) == sorted(f"e{10 * k + j}" for k in range(3) for j in range(1, 4)) and t.runs.read().first().events == 9
    spark.createDataFrame([activity(50, "q")], schema).write.parquet(str(tmp_path / "more"))
    t.start(spark.readStream.schema(schema).parquet(str(tmp_path / "more")), str(tmp_path / "check2")).awaitTermination()  # another stream, from batch 0 too
    assert t.events().count() == 10 and {r.run_id: r.events for r in t.runs.read().collect()} == {"r": 9, "q": 1}


# Themes


def test_uncovered_by_brute_force(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(14)] + ["the", "of", "is"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
    own = [(rng.choice(["a", "b", None]), text()) for _ in range(60)] + [("a", None)]
    asked = [(rng.choice(["a", "b", "c", None]), text().title(), k) for k in range(300)] + [("a", None, 1), ("a", "word1 word2", 7), ("a", "word1 word2", 7)]
    tokens = lambda t: {w for w in (t or "").lower().split() if len(w) > 2 and w not in themes.T.LOOSE_STOP}
    want = Counter(r for r in asked if tokens(r[1]) and not any(s == r[0] and len(tokens(h) & tokens(r[1])) >= 2 for s, h in own))
    got = themes.uncovered(spark.createDataFrame(asked, "site string, theme string, pages int"), spark.createDataFrame(own, "site string, heading string"))
    assert Counter(tuple(r) for r in got.collect()) == want and want
    first = themes.suggestions(got, most=2).where("site = 'a'").orderBy("place").collect()
    sums = Counter()
    for (s, t, n), k in want.items():
        if s == "a":
            sums[t] += n * k
    assert [(r.theme, r.pages) for r in first] == sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:2]


def test_a_heading_that_all_pages_have(spark):
    own = spark.range(5000).select(F.lit("a").alias("site"), F.lit("about our company").alias("heading"))
    asked = spark.createDataFrame([("a", "our company history", 1), ("a", "company news", 1)], "site string, theme string, pages int")
    assert [r.theme for r in themes.uncovered(asked, own).collect()] == ["company news"]
