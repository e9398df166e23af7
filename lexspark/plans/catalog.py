"""Registered queries of the retrieval engine and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.plans import scalar_queries, text_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.queries() | scalar_queries.queries()


def oracle_sql() -> dict[str, str]:
    return text_queries.oracle_sql() | scalar_queries.oracle_sql()
