"""The n-gram join, the filter audit and the hard negatives against plain Python."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitelumen.llm import common, filters, negatives, ngram_join
from sitelumen.llm.queries import QUERIES

from . import helpers as H

# 11. N-gram Jaccard join


def links(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def check_join(rows, docs):
    """docs: (id, text)."""
    sets = [set(H.shingles(t, 5)) for _, t in docs]
    root = H.groups(len(docs), lambda i, j: links(sets[i], sets[j]) or bool(sets[i]) and sets[i] == sets[j])
    least = {}
    for (i, _), r in zip(docs, root, strict=True):
        least[r] = min(x for x in (i, least.get(r)) if x is not None) if i is not None or least.get(r) is not None else None
    want = Counter((i, len(s), least[r]) for (i, _), s, r in zip(docs, sets, root, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == want


def test_op11_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").collect()]
    check_join(QUERIES["op11_ngram_join"](spark, sf_dir).collect(), docs)


def test_op11_awkward(spark):
    rows = H.awkward(spark)
    check_join(ngram_join.join(rows).collect(), [(r.doc_id, r.text) for r in rows.collect()])
    assert ngram_join.join(H.empty(spark)).collect() == []
    other = rows.selectExpr("doc_id AS k", "text AS body", "1 AS doc_id", "2 AS node", "3 AS size", "4 AS component_id")
    check_join(ngram_join.join(other, "k", "body").collect(), [(r.doc_id, r.text) for r in rows.collect()])


def variants(seed, n=260):
    """Texts of 1 to 90 words, many of them a few words away from others: similarities on both sides of the limit."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 90]))]
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                where = rng.randrange(len(words) + 1)
                words[where : where + rng.randrange(2)] = [f"x{rng.randrange(10_000)}"] * rng.randrange(3)
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("bucket", "run", "group"), [(24 << 20, 32_768, 4_000_000), (3_000, 4, 60)])
def test_op11_loses_and_invents_no_link(spark, monkeypatch, bucket, run, group):
    """Also with buckets, tiles and groups so small that all are cut."""
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(ngram_join, "RUN_SETS", run)
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", group)
    docs = list(enumerate(variants(bucket)))
    check_join(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_op11_linked_sets_meet_in_a_tile():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 2**64, n, np.uint64)
        keep = rng.random(n) > rng.choice([0, 0.02, 0.1])
        b = np.append(a[keep], rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 8)), np.uint64))
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if not len(b) or 100 * shared < 80 * (len(a) + len(b) - shared) or shared == len(a) == len(b):
            continue
        keys, owners = ngram_join.parts(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())
        met += 1
    assert met > 500


def test_op11_bitmaps_bound_the_difference():
    rng = np.random.default_rng(6)
    for n in (1, 7, 300, 1020, 1030, 4000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.append(a[: -(-9 * n // 10)], rng.integers(0, 2**64, n // 8, np.uint64)))
        maps = ngram_join.bitmaps(np.concatenate([a, b]), np.array([len(a), len(b)]))
        rows = ngram_join.folded(maps)
        differ, most = int(np.bitwise_count(rows[0] ^ rows[1]).sum()), len(np.setxor1d(a, b))
        assert differ <= most
        assert n < 300 or differ > most / 3  # and not idly
    apart = [np.unique(rng.integers(0, 2**64, 500, np.uint64)) for _ in range(2)]
    rows = ngram_join.folded(ngram_join.bitmaps(np.concatenate(apart), np.array([500, 500])))
    assert np.bitwise_count(rows[0] ^ rows[1]).sum() > ngram_join.most_different(np.array(1000))


def test_op11_a_long_list_of_wanted_texts_moves_few_others(spark, monkeypatch):
    """of texts that meet more wanted ones than are sent to every executor, few move that nobody asked for."""
    texts = ngram_join._keyed(spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), "doc_id", "text")
    kept = ngram_join._maybe_among(texts, texts.where("doc_id < 400").select("text_hash"), 400)
    found = {r.doc_id for r in kept.collect()}
    assert kept.columns == texts.columns and found >= set(range(400)) and len(found) < 700
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    docs = list(enumerate(variants(11, 120)))
    check_join(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_op11_groups_that_chance_connects_do_not_move_as_sets(spark, monkeypatch):
    """sets of a passage in common agree in parts and in small bitmaps by chance; of those, only linked ones are read again as sets."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = words(500)
    texts = [shared + words(524) for _ in range(90)]
    texts += [[*texts[0][:1000], *words(24)], [*texts[1][:1010], *words(14)]]
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    asked, sets_of = [], ngram_join.sets_of
    monkeypatch.setattr(ngram_join, "SCREENED_SHINGLES", 2_000)
    monkeypatch.setattr(ngram_join, "sets_of", lambda rows, wanted, *a: asked.append(wanted.count()) or sets_of(rows, wanted, *a))
    check_join(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    assert asked == [4]


def test_op11_half_of_the_rows_are_one_text(spark):
    words = [f"v{k}" for k in range(60)]
    docs = [(k, " ".join(words)) for k in range(3000)] + [(3000 + k, " ".join([*words[:-1], f"end{k % 40}"])) for k in range(800)] + [(5000, "something else altogether")]
    rows = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert Counter(r.component_id for r in rows) == {0: 3800, 5000: 1}


# 12. Filter interaction audit


def brute_audit(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    counts = defaultdict(Counter)
    for i, text, source in docs:
        t = text or ""
        w = H.words(t)
        fails = "".join(
            f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least.get(t, i)), strict=True) if x
        )
        counts[source or ""][fails, i in good, i in toxic] += 1
    out = set()
    for part, sets in counts.items():
        shapley, rows = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = sets
            for step, f in enumerate(order, 1):
                here = {k: n for k, n in left.items() if f in k[0]}
                left = {k: n for k, n in left.items() if f not in k[0]}
                removed = sum(here.values())
                shapley[f] += removed
                every = sum(n for k, n in sets.items() if f in k[0])
                rows.append((part, order, step, sum(left.values()), removed, every - removed, sum(n for k, n in sets.items() if k[0] == f), sum(n for k, n in here.items() if k[1]), sum(n for k, n in here.items() if k[2])))
        out |= {(*r, shapley[r[1][r[2] - 1]]) for r in rows}
    return out


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def check_audit(rows, docs, labels):
    rows = rows.collect()
    got = {tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows) and got == brute_audit(docs, labels)


def labels_of(spark, sf_dir):
    return [(r.doc_id, r.quality, r.toxic) for r in common.table(spark, sf_dir, "labels").collect()]


def test_op12_query(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in common.table(spark, sf_dir, "documents").collect()]
    check_audit(QUERIES["op12_filter_audit"](spark, sf_dir), docs, labels_of(spark, sf_dir))


def test_op12_awkward(spark, sf_dir):
    texts = [*H.AWKWARD, "AB " * 60, "a$ " * 60, " ".join(f"w{k}" for k in range(50)), " ".join(f"w{k}" for k in range(50)), " ".join(f"w{k % 33}" for k in range(50)), " ".join(f"W{k}" for k in range(50))]
    rows = H.awkward(spark, texts).withColumnsRenamed({"score": "part"}).selectExpr("*", "1 AS digest", "2 AS fails", "3 AS good", "4 AS toxic")
    own = [(0, 1, 0), (0, 0, 1), (1, None, 1), (7, 1, None), (None, 1, 1), (500, 1, 1), (99_999, 1, 1)]
    labels = spark.createDataFrame(own, "doc_id long, quality int, toxic int")
    check_audit(filters.audit(rows, labels), [(r.doc_id, r.text, r.source) for r in rows.collect()], own)
    none = labels.limit(0)
    check_audit(filters.audit(rows, none), [(r.doc_id, r.text, r.source) for r in rows.collect()], [])
    assert filters.audit(H.empty(spark), labels).collect() == []


def test_op12_one_source_and_one_text_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(filters, "HELD_PARTS", 2)
    docs = [(k, "the same few words" if k % 3 else f"text {k}", "big" if k % 4 else f"small{k % 12}") for k in range(4000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(9)
    check_audit(filters.audit(rows, spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")), docs, [(5, 1, 1)])


def test_op12_first_failures():
    table = filters.first_failures()
    assert table.shape == (32, 120)
    assert (table[0] == 5).all() and (table[31] == 0).all()
    for fails in range(32):
        for o, order in enumerate(filters.ORDERS):
            steps = [s for s, f in enumerate(order) if fails >> "ABCDE".index(f) & 1]
            assert table[fails, o] == min(steps, default=5)


# 13. Hard negatives


def brute_mine(rows, anchors):
    """rows: {id: (label, whole numbers)}."""
    dims = max((len(v) for _, v in rows.values()), default=0)
    full = {i: (label, [*v, *[0] * (dims - len(v))]) for i, (label, v) in rows.items()}
    out = set()
    for a in anchors:
        label, v = full[a]
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in full.items() if i != a}
        first = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in first if full[i][0] == label][:5]:
            s = score[p]
            fit = [i for i in first if full[i][0] != label and 30 * s <= 100 * score[i] <= 90 * s][:10]
            out |= {(a, p, k, i, s, score[i]) for k, i in enumerate(fit, 1)}
    return out


def check_mined(rows, want):
    rows = rows.collect()
    got = {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in rows}
    assert len(got) == len(rows) and got == want


def whole(vector):
    return [math.floor(256 * x) for x in vector]


@pytest.mark.parametrize("block", [16_384, 60])
def test_op13_query(spark, sf_dir, monkeypatch, block):
    """Also with tiles so small that there are many of them, and several anchor blocks."""
    monkeypatch.setattr(negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 8192 if block > 1000 else 2)
    rows = {r.vec_id: ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, whole(r.embedding)) for r in common.table(spark, sf_dir, "embeddings").collect()}
    want = brute_mine(rows, [i for i in rows if i % 100 == 0])
    assert want
    check_mined(QUERIES["op13_hard_negatives"](spark, sf_dir), want)


def test_op13_awkward(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 20)
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 0.1) for _ in range(6)], k % 3) for k in range(120)]
    rows += [(200 + k, [0.1, 0.0, 0.0, 0.0, 0.0, 0.0], k % 2) for k in range(40)]  # one common vector: ties
    rows += [(300, [0.5, 0.1], 0), (301, [], 1), (302, [1000.0] * 6, 1), (400, [0.0] * 6, 2)]
    clean = {i: (label, whole(v)) for i, v, label in rows}
    bad = [(500, None, 0), (501, [0.1, None, 0.2], 0), (502, [math.nan] * 6, 0), (503, [math.inf, 0.0], 1), (504, [0.1] * 6, None), (None, [0.1] * 6, 0)]
    repeated = [rows[0], rows[0], (100, [9.0] * 6, 9)]
    df = spark.createDataFrame([*rows, *bad, *repeated], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS code", "2 AS cell", "3 AS vector", "4 AS score")
    check_mined(negatives.hard_negatives(df), brute_mine(clean, [i for i in clean if i % 100 == 0]))
    assert negatives.hard_negatives(df.limit(0)).collect() == []
    assert negatives.hard_negatives(df.where("vec_id = 200")).collect() == []


def test_op13_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = {k: (k % 2, [rng.randrange(-(2**27), 2**27) for _ in range(3)]) for k in range(60)}
    df = spark.createDataFrame([(i, [x / 256 for x in v], label) for i, (label, v) in rows.items()], "vec_id long, embedding array<double>, label int")
    check_mined(negatives.hard_negatives(df, "vec_id % 20 = 0"), brute_mine(rows, [0, 20, 40]))
    with pytest.raises(OverflowError):
        negatives.scores(np.array([1e12]), np.array([[1e12]]))


def test_op13_bounds_hold_and_filter():
    rng = np.random.default_rng(zlib.crc32(b"bounds"))
    vectors = np.floor(256 * rng.normal(0, 0.125, (3000, 64)))
    book = negatives.fit_codebook(vectors[:2000])
    codes, left = negatives.encode(vectors, book)
    anchors = vectors[:40]
    least, most = negatives.bounds(anchors, codes, left, np.sqrt((vectors**2).sum(1)), book)
    exact = anchors @ vectors.T
    assert (least <= exact).all() and (exact <= most).all()
    for k in range(5):  # the bounds pass over most rows, and the first ones stay
        fifth = np.sort(least[k])[-5]
        assert (most[k] >= fifth).mean() < 0.2
        assert set(np.argsort(-exact[k])[:5].tolist()) <= set(np.flatnonzero(most[k] >= fifth).tolist())
