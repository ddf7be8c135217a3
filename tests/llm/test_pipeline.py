"""The pipeline's stages, each against plain Python on its own input."""

import corpus_pipeline
import pytest

from sitelumen.llm import secrets

from . import helpers as H
from .test_operators import check_packed, insults, rule, similar_texts


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(docs, result) of each stage over the smallest tables, written and read as the driver does."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, sf_dir).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def test_names_and_columns(stages, spark, sf_dir):
    assert list(stages) == ["toxicity", "quality rules", "near copies", "secrets", "packing"]
    for name, (docs, kept) in list(stages.items())[:-1]:
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < kept.count() <= docs.count(), name


def test_toxic_go(spark, tmp_path):
    docs, labels = insults(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert len([i for i in range(1500) if (i % 5 == 0) == (i in kept)]) <= 5


def test_poor_go(stages):
    docs, kept = stages["quality rules"]
    left = {r.doc_id for r in kept.collect()}
    assert not any(rule(r.text)[-1] for r in docs.collect() if r.doc_id in left)
    plain = [r for r in docs.collect() if not rule(r.text)[-1] and not rule(r.text)[2] and not rule(r.text)[3] and not r.text.isupper() and "!" not in r.text]
    assert all(r.doc_id in left for r in plain if not rule(r.text)[4])


def test_copies_go(spark, stages):
    docs, kept = stages["near copies"]
    rows, left = docs.collect(), {r.doc_id for r in kept.collect()}
    shingles = {r.doc_id: set(H.shingles(r.text, 5)) for r in rows}
    close = [(a, b, H.jaccard(shingles[a], shingles[b])) for a in shingles for b in shingles if a < b]
    assert not any(a in left and b in left for a, b, s in close if s >= 0.9)
    best = {i: max([0, *(s for a, b, s in close if i in (a, b))]) for i in shingles}
    assert all(i in left for i in shingles if best[i] < 0.5)
    texts = similar_texts()
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, frame, "").collect()} == {k for k in texts if k % 10 in (0, 9)}


def test_secrets_are_cut(stages):
    docs, kept = stages["secrets"]
    left = {r.doc_id: r for r in kept.collect()}
    assert len(left) == docs.count()
    for r in docs.collect():
        now = left[r.doc_id]
        assert now.n_chars == len(now.text) and not secrets.base_spans(now.text)
        if not secrets.base_spans(r.text):
            assert now.text == r.text


def test_packing(stages):
    docs, packed = stages["packing"]
    n, least = check_packed(packed.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.03 * least + 1


def test_run_and_empty(spark, sf_dir, stages, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["packing"][1].count()
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows(spark, sf_dir):
    docs = H.awkward(spark).withColumnRenamed("score", "n_chars").selectExpr("doc_id", "text", "lang", "source", "CAST(NULL AS bigint) AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.count()
