"""The registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the DuckDB SQL of the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if sql is not None:
            _oracle[key] = sql
        return f

    return add


def _load() -> None:
    from meridia.plans import assessment_queries, audit_queries, fact_queries, health_queries, metric_queries, panel_queries, resolver_queries, text_queries, view_queries  # noqa: F401


def queries() -> dict[str, Query]:
    """Query name -> callable(spark, sf_dir)."""
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL with the same rows."""
    _load()
    return dict(_oracle)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: ratio trends of every entity."""
    return queries()["trend_direction"](spark, sf_dir)
