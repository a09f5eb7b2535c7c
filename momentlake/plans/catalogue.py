"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from momentlake.plans import batch_queries, graph_queries, rule_queries, search_queries, text_queries

AREAS = (text_queries, rule_queries, search_queries, graph_queries, batch_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for a in AREAS for k, f in a.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for a in AREAS for k, q in a.SQL.items()}
