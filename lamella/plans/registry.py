"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "agg_spot_rollup"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_ALL: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, folder) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _ALL[f.__name__] = Query(f, sql)
        return f

    return add


def _load() -> dict[str, Query]:
    from importlib import import_module

    for name in ("table_queries", "raster_queries", "learning_queries", "text_queries", "more_queries", "record_queries", "cohort_queries"):
        import_module(f"lamella.plans.{name}")
    return _ALL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q.run for n, q in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {n: q.sql for n, q in _load().items() if q.sql}
