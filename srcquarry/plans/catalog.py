"""Named queries over the shared tables, each paired with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srcquarry.plans import graph_queries, relational_queries, source_queries

ALL = graph_queries.QUERIES | relational_queries.QUERIES | source_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in ALL.items() if sql}
