"""The registered queries of the engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.plans import advice_queries, feature_queries, merge_queries, more_queries, profile_queries, table_queries
from tabloom.plans.base import Query

_MODULES = (merge_queries, profile_queries, feature_queries, more_queries, advice_queries, table_queries)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """For each customer and month: order value of the previous 3 and 12 months, and the ratio."""
    return merge_queries.R.queries["flagship_windows"](spark, sf)


def queries() -> dict[str, Query]:
    return {name: query for m in _MODULES for name, query in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.R.sql.items()}
