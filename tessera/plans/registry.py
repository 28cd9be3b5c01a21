"""One registry for queries and their SQL twins, so that keys cannot drift."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules whose queries are registered, in order.
MODULES = ("scan", "relations", "text_queries", "more_queries", "code_queries", "campaigns")


@dataclass(frozen=True)
class Query:
    """``run`` builds the DataFrame; ``sql`` is the same result in DuckDB, if SQL can say it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


_QUERIES: dict[str, Query] = {}


def register(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[run.__name__] = Query(run, sql)
        return run

    return add


def registered() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"tessera.plans.{module}")
    return dict(_QUERIES)
