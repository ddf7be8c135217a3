"""Answers of a search service: JSON of uncertain shape, read as VARIANT, to rows, or to the reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: results that are kept.
MOST = 10


def _list(name: str) -> Column:
    """The objects of a list in the answer; other things in it are left out, and so is what is no list."""
    items = F.coalesce(F.try_variant_get("v", f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def parsed(answers: DataFrame, id: str = "id", body: str = "body") -> DataFrame:
    """(id, outcome, v) of each answer: ``ok``, or why it can't be used: ``no answer``, ``broken`` or ``wrong shape``.

    An answer is an object; if it has ``organic``, that is a list.
    """
    rows = answers.select(F.col(id).alias("id"), F.col(body).alias("body"), F.try_parse_json(body).alias("v"))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    organic = F.try_variant_get("v", "$.organic", "variant")
    good = kind(F.col("v")).startswith("OBJECT") & (organic.isNull() | kind(organic).startswith("ARRAY") | (kind(organic) == "VOID"))
    outcome = F.when(F.trim(F.coalesce("body", F.lit(""))) == "", "no answer").when(F.col("v").isNull(), "broken").when(good, "ok").otherwise("wrong shape")
    return rows.select("id", outcome.alias("outcome"), "v")


def organic(rows: DataFrame) -> DataFrame:
    """(id, position, link, title) of the first MOST results of each ``parsed`` answer; a missing position is the place in the list."""
    each = rows.where("outcome = 'ok'").select("id", F.posexplode(F.slice(_list("organic"), 1, MOST)).alias("ord", "r"))
    text = lambda name: F.coalesce(F.try_variant_get("r", f"$.{name}", "string"), F.lit(""))
    return each.select("id", F.coalesce(F.try_variant_get("r", "$.position", "int"), F.col("ord") + 1).alias("position"), text("link").alias("link"), text("title").alias("title"))


def asked(rows: DataFrame) -> DataFrame:
    """(id, kind, ord, text): the related searches and the questions of each ``parsed`` answer, empty ones left out."""
    texts = lambda name, field: F.transform(_list(name), lambda x: F.try_variant_get(x, f"$.{field}", "string"))
    kinds = (("related", "relatedSearches", "query"), ("question", "peopleAlsoAsk", "question"))
    lists = F.array(*(F.struct(F.lit(kind).alias("kind"), texts(name, field).alias("texts")) for kind, name, field in kinds))
    each = rows.where("outcome = 'ok'").select("id", F.explode(lists).alias("l")).select("id", "l.kind", F.posexplode("l.texts").alias("ord", "text"))
    return each.where("text <> ''").select("id", "kind", "ord", "text")


def overviews(rows: DataFrame) -> DataFrame:
    """(id, outcome, ai_overview): of every answer, whether it has a written overview with a text."""
    said = F.coalesce(F.try_variant_get("v", "$.aiOverview.text", "string"), F.lit("")) != ""
    return rows.select("id", "outcome", (said & (F.col("outcome") == "ok")).alias("ai_overview"))
