"""Registered queries: every operator bound to the given tables.

Each query is a function ``(spark, root) -> DataFrame``; where SQL can express the
same result, the statement stands next to it and serves as an independent check.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("ingest", "wiring", "signal", "adaptive", "scalars", "reports", "captures", "streams")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} registered twice")
        _QUERIES[key] = fn
        if sql is not None:
            _SQL[key] = sql
        return fn
    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"phasegrid.workloads.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
