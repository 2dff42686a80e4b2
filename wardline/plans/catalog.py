"""Registered queries of the analytics operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.plans import incident_queries, log_queries, other_queries, source_queries

_MODULES = (log_queries, incident_queries, other_queries, source_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log to sessions to features to rule verdicts: the most suspicious sessions."""
    return log_queries.top_sessions(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
