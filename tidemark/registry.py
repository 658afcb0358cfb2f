"""Every query of the library by name, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis_queries, detect_queries, graph_queries, index_queries, profile_queries, relational_queries, series_queries, stream_queries, vector_queries

MODULES = (series_queries, relational_queries, vector_queries, detect_queries, analysis_queries, stream_queries, index_queries, graph_queries, profile_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: which frame shows anomalous coverage on which days."""
    return series_queries.anomaly_islands(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
