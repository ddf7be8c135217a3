"""The corpus pipeline: what is toxic goes, what fails the quality rules goes, one document of each group of near
copies stays, secrets are cut out, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.llm import common, packing, quality, secrets, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The classifier is fitted to ``docs`` and the table labels."""
    classifier = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    (name,) = common.free(docs, "_toxicity")
    return toxicity.score(docs, classifier, name=name).where(F.col(name) < 0.5).drop(name)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or stand beyond a fence of their language and source, go."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row of the smallest id and text stays; rows without an id come last.

    Documents without words are near copies of each other.
    """
    return simhash.keep_first(docs)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in texts, and ``n_chars`` counted again; no document goes."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: its place in the sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("near copies", drop_copies),
    ("secrets", cut_secrets),
    ("packing", pack),
]

#: SQL can't express the stages; tests/llm holds them against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared checkpoint folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.settle(docs)
    return docs
