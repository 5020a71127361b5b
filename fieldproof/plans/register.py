"""Registration of queries with their SQL, and the tables most of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldproof.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str | None], Callable[[Query], Query]]]:
    """(queries, SQL, decorator) of a module: the decorator registers a query under its name, with its SQL if there is any."""
    queries: dict[str, Query] = {}
    texts: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = sql
            return f

        return add

    return queries, texts, query


def tasks_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks")


def predictions_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions")
