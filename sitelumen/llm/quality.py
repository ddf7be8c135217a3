"""Quality rules with thresholds that adapt to each language and source.

Every document's measures are counted into quantile sketches, one for each language, source and measure: counts of
logarithmic buckets, which merge by adding and give each quantile within GAMMA of its value, in any order of
merging and with the same result on every run. Of each sketch the quartiles give two fences, SPREADS times their
distance below and above them, which are joined back to the documents; a value is beyond one if it is so by more than
the sketch's precision. There is no other threshold: where three
quarters of a group have none of a thing, any of it is beyond the fence. A value beyond a fence is unusual, not yet
poor; a document goes if it is so in two ways.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common, wordhash

# The base rule.
LEAST_WORDS, REPEAT_WORDS, MOST_REPEAT_PERCENT = 10, 5, 20
SYMBOLS = "#*$%&|<>"

#: Each measure, and the way in which a text is unusual where it is beyond a fence: a line that repeats repeats its words too.
MEASURES = {"symbols": "symbols", "capitals": "capitals", "repeats": "repetition", "duplicate_lines": "repetition", "word_length": "word_length"}
#: Ways in which a text that goes is unusual.
WAYS = 2
#: The quartiles, and the share of their distance at which the fences stand beyond them.
LOWER, MIDDLE, UPPER, SPREADS = 0.25, 0.5, 0.75, 1.5
#: A text's distance from the middle counts n / (n + SHORT_WORDS), n being its words: shares of few words are chance.
SHORT_WORDS = 20
#: Ratio of neighbouring buckets, and the least value that has one of its own; below lies bucket 0.
GAMMA, TINY = 1.005, 1e-4
#: Rows that a language's quantiles count for beside a group's own, and those of all rows beside a language's.
PRIOR_ROWS = 20

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters")
_SPACES = " \t\n\x0b\x0c\r"


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in characters]] = 1
    return out


_SYMBOL = _table(SYMBOLS)
_CAPITAL = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_POINT = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)  # bytes that begin a code point


def counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of each text, by their names in _COUNTS; a null text has none of anything."""
    w = wordhash.words(texts)
    n = len(texts)

    def total(table: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(table[w.data]))

    points = total(_POINT)
    out = {"n_words": w.counts, "word_chars": np.bincount(w.doc, points[w.end] - points[w.start], n).astype(np.int64)}
    for name, table in (("n_symbols", _SYMBOL), ("n_capitals", _CAPITAL), ("n_letters", _LETTER)):
        out[name] = np.diff(total(table)[w.bounds])
    hashes, at = wordhash.window_hashes(w, wordhash.word_hashes(w), REPEAT_WORDS)
    hashes = wordhash.mix(hashes ^ wordhash.mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    again = at[order[np.append(same, False) | np.append(False, same)]] if len(at) else at
    covered = np.zeros(len(w.start) + REPEAT_WORDS, bool)
    for k in range(REPEAT_WORDS):
        covered[again + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered[: len(w.start)]], minlength=n)
    lines = [[x for x in t.split("\n") if x.strip(_SPACES)] if t else [] for t in texts]
    out["n_lines"] = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    return out


def measured(docs: DataFrame, text: str = "text", keep_text: bool = True, name: str = "rule") -> DataFrame:
    """``docs`` with the column ``name``, a struct of the counts and ``base_failed``. No shuffle."""
    columns = [c for c in docs.columns if c != name and (keep_text or c != text)]
    kept = docs.select(*columns, *([] if keep_text else [text]))
    fields = ", ".join(f"{c}: bigint" for c in _COUNTS)
    schema = kept.select(*columns).withColumn(name, F.lit(None).cast(f"struct<{fields}>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            made = counts(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.StructArray.from_arrays([pa.array(made[c], pa.int64()) for c in _COUNTS], list(_COUNTS))], [*columns, name])

    rule = F.col(name)
    failed = (rule["n_words"] < LEAST_WORDS) | (100 * rule["n_repeat_words"] > MOST_REPEAT_PERCENT * rule["n_words"])
    return kept.mapInArrow(run, schema).withColumn(name, rule.withField("base_failed", failed))


def _measures(name: str = "rule") -> dict[str, Column]:
    """Each of MEASURES from the struct ``name``; null where a text has nothing to measure."""
    of = lambda a, b: F.try_divide(F.col(name)[a], F.col(name)[b])
    return {"symbols": of("n_symbols", "n_words"), "capitals": of("n_capitals", "n_letters"), "repeats": of("n_repeat_words", "n_words"), "duplicate_lines": of("n_dup_lines", "n_lines"), "word_length": of("word_chars", "n_words")}


def sketches(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, measure, bucket, n): the sketches of rows with ``rule``, by the columns of ``group``, nulls a value too."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in _measures().items()))).alias("m")
    bucket = F.when(F.col("m.value") < TINY, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log(F.col("m.value") / TINY) / math.log(GAMMA)) + 1)).cast("int")
    return rows.select(*group, each).where("m.value IS NOT NULL").groupBy(*group, F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, group: list[str], shares: dict[str, float]) -> DataFrame:
    """(group, measure, rows, and a column for each of ``shares``): quantiles read from ``sketch``, merged to ``group``."""
    merged = sketch.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))
    upto = W.Window.partitionBy(*group, "measure").orderBy("bucket")
    run = merged.withColumns({"upto": F.sum("n").over(upto), "rows": F.sum("n").over(W.Window.partitionBy(*group, "measure"))})
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(TINY * F.pow(F.lit(GAMMA), F.col("bucket") - 1.5))
    return run.groupBy(*group, "measure", "rows").agg(*(F.min(F.when(F.col("upto") >= share * F.col("rows"), value)).alias(name) for name, share in shares.items()))


def fences(rows: DataFrame, lang: str = "lang", source: str = "source", rule: str = "rule", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang, source, fence): for each language and source of ``rows``, an array in the order of MEASURES of (low, middle, high).

    A group's quantiles are averaged with its language's, which count for ``prior_rows`` rows, and a language's with
    those of all rows in the same way; so a group of few rows leans on others.
    """
    sketch = common.settle(sketches(rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(rule).alias("rule")), ["lang", "source"]))
    shares = {"lower": LOWER, "middle": MIDDLE, "upper": UPPER}
    own = quantiles(sketch, ["lang", "source"], shares)
    wider = quantiles(sketch, ["lang"], shares).select(F.col("lang").alias("l_lang"), "measure", F.struct("rows", *shares).alias("l"))
    widest = quantiles(sketch, [], shares).select("measure", F.struct("rows", *shares).alias("a"))
    every = own.join(wider, (own.lang.eqNullSafe(wider.l_lang)) & (own.measure == wider.measure)).drop(wider.measure).join(F.broadcast(widest), "measure")  # widest: a row a measure
    mean = lambda n, x, y: (n * x + prior_rows * y) / (n + prior_rows)
    lower, middle, upper = (mean(F.col("rows"), F.col(q), mean(F.col("l.rows"), F.col(f"l.{q}"), F.col(f"a.{q}"))) for q in shares)
    fence = F.struct((lower - SPREADS * (upper - lower)).alias("low"), middle.alias("middle"), (upper + SPREADS * (upper - lower)).alias("high"))
    by_measure = every.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", fence.alias("fence")))).alias("f"))  # an entry a measure
    return by_measure.select("lang", "source", F.array(*(F.col("f")[k] for k in MEASURES)).alias("fence"))


def judged(rows: DataFrame, lang: str = "lang", source: str = "source", rule: str = "rule", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Rows with the struct ``rule`` and, added to it, ``unusual``, the ways in which a text is, and ``kept``: the base rule held, and there are fewer than WAYS.

    ``rows`` is read twice, for the sketches and to be judged, so it should be settled. The fences are sent to where the
    rows are if they are few enough (``common.small``: languages times sources, not documents); otherwise rows are
    shuffled to meet them. Repeated rows count and stay each.
    """
    lang_, source_, fence_ = common.free(rows, "_lang", "_source", "_fence")
    fence = common.small(common.settle(fences(rows, lang, source, rule, prior_rows)).select(F.col("lang").alias(lang_), F.col("source").alias(source_), F.col("fence").alias(fence_)))
    met = rows.join(fence, F.col(lang).eqNullSafe(F.col(lang_)) & F.col(source).eqNullSafe(F.col(source_)), "left")
    n = F.col(rule)["n_words"]
    beyond: dict[str, Column] = {}
    for k, (name, value) in enumerate(_measures(rule).items()):
        own = F.col(fence_)[k]
        near = own["middle"] + (value - own["middle"]) * (n / (n + SHORT_WORDS))
        here = F.coalesce((near < own["low"] / GAMMA - TINY) | (near > own["high"] * GAMMA + TINY), F.lit(False))
        beyond[MEASURES[name]] = beyond[MEASURES[name]] | here if MEASURES[name] in beyond else here
    ways = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in beyond.items())), lambda x: x.isNotNull())
    made = F.col(rule).withField("unusual", ways).withField("kept", ~F.col(rule)["base_failed"] & (sum(v.cast("int") for v in beyond.values()) < WAYS))
    return met.withColumn(rule, made).drop(lang_, source_, fence_)


def rate(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row of ``docs``.

    Null texts have no words and fail. Null languages and sources are groups of their own. Repeated rows stay.
    """
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = common.settle(measured(plain, keep_text=False))
    return judged(rows, prior_rows=prior_rows).select("doc_id", *(F.col(f"rule.{c}").alias(c) for c in (*_COUNTS[:5], "base_failed", "kept")))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns that they had. Texts are measured once, and settled with their counts."""
    (rule,) = common.free(docs, "rule")
    rows = common.settle(measured(docs, text, name=rule))
    return judged(rows, lang, source, rule, prior_rows).where(F.col(rule)["kept"]).select(*docs.columns)
