"""All queries of the library by key, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under a key, with the DuckDB SQL for its rows where SQL can express it."""

    def add(f: Query) -> Query:
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def _load() -> None:
    """The modules register their queries when imported."""
    for name in ("dialect", "shaping", "measures", "graphs", "changes", "streams"):
        import_module(f"opalgrid.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship"](spark, sf_dir)
