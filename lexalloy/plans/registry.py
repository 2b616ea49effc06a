"""Name to callable and name to DuckDB text for every registered statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import composition_queries, news_queries, operator_queries, report_queries
from .tables import DUCK, SPARK, Dialect, on_duckdb, on_spark

STATEMENTS = news_queries.QUERIES | report_queries.QUERIES
ORDERS = news_queries.ORDERS | report_queries.ORDERS


def text(name: str, dialect: Dialect) -> str:
    found = STATEMENTS[name]
    body = found if isinstance(found, str) else found(dialect)
    return f"SELECT * FROM ({body}) ordered ORDER BY {ORDERS[name]}" if name in ORDERS else body


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, n=name: on_spark(spark, sf_dir, text(n, SPARK)) for name in STATEMENTS} | operator_queries.QUERIES | composition_queries.QUERIES


def oracles() -> dict[str, str]:
    return {name: on_duckdb(text(name, DUCK)) for name in STATEMENTS} | operator_queries.ORACLES | composition_queries.ORACLES
