"""All registered queries: name -> (plan, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import research_queries, series_queries, table_queries

_MODULES = (table_queries, series_queries, research_queries)


def _prepared(plan):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        # bar times are naive UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plan(spark, folder)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _prepared(plan) for m in _MODULES for n, (plan, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for m in _MODULES for n, (_, sql) in m.QUERIES.items() if sql is not None}
