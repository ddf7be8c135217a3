"""Every query with SQL against DuckDB on the smallest tables, the entry point, and the independence of its parts."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from sitelumen import catalog

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def in_order(rows):
    return sorted(rows, key=lambda row: [(v is not None, v if v is not None else 0) for v in row])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert in_order([tuple(plain(r[c]) for c in columns) for r in found.collect()]) == in_order([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_other_packages():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['sitelumen.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'keyword_pool' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_near_duplicates_lose_no_pair(spark):
    import random

    from sitelumen.operators import shingles

    rng = random.Random(1)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(900)}" for _ in range(120)]
        for _ in range(5):
            copy = list(base)
            for i in rng.sample(range(120), rng.randrange(8)):
                copy[i] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["the common passage " * 30, None, "", "short", texts[0]]
    sets = [set() if not t else {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    first = [i for i, t in enumerate(texts) if t and t not in texts[:i]]  # equal texts are one, the first
    want = {(a, b) for a in first for b in first if a < b and min(len(texts[a].split()), len(texts[b].split())) >= 60 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    found = shingles.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.a, r.b) for r in found} == want and len(want) > 20
    assert all(abs(r.similarity - len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) < 1e-9 for r in found)


def test_shingles_by_packed_buckets(spark, monkeypatch):
    """with hashes dealt in many small batches and buckets, what moves is packed and the rows are those of brute force."""
    import random
    from collections import Counter

    from sitelumen.operators import shingles

    monkeypatch.setattr(shingles, "DEAL_HASHES", 50)
    monkeypatch.setattr(shingles, "BUCKET_BYTES", 2_000)
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 80, 120]))] for _ in range(14)]
    texts = [" ".join(w) for b in base for k in range(4) for w in [b[: len(b) - 3 * k] + [f"x{rng.randrange(9)}"] * k]] + [None, "", "One two", "a a a a a a a a"]
    docs = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    windows = {f"k{i}": [tuple(w[j : j + 5]) for j in range(len(w) - 4)] for i, t in enumerate(texts) for w in [(t or "").lower().split()]}
    held = Counter(x for ws in windows.values() for x in set(ws))
    assert Counter(r.docs for r in shingles.shingle_frequency(docs).collect()) == Counter(held.values())
    own = {k: len({j + d for j, x in enumerate(ws) if held[x] < 3 for d in range(5)}) for k, ws in windows.items()}
    assert {r.id: (r.n_words, r.unique_words) for r in shingles.unique_words(docs).collect()} == {f"k{i}": (len((t or "").split()), own[f"k{i}"]) for i, t in enumerate(texts)}
    first = {t: min(f"k{i}" for i, x in enumerate(texts) if x == t) for t in texts if len((t or "").split()) >= 60}
    sets = {k: set(windows[k]) for k in first.values()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    found = shingles.similar_pairs(docs)
    assert {(r.a, r.b): r.similarity for r in found.collect()} == {k: v for k, v in want.items() if v >= 0.7}
    plan = spark._jvm.PythonSQLUtils.explainString(shingles.unique_words(docs)._jdf.queryExecution(), "simple")
    assert "Join" not in plan and "Generate posexplode" not in plan  # no row a window
