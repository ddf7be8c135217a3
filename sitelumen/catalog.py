"""Every registered query of the site and search analytics, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelumen.plans import answers, competition, content, crawl, discovery, events, landing, pool, reports, search, site, sitemaps, themes, topics

PLANS = (content, search, site, events, topics, landing, sitemaps, competition, reports, crawl, discovery, themes, answers, pool)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in PLANS for name, sql in plan.ORACLE_SQL.items()}
