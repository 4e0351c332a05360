"""Every operator as a named query over the test tables, most with an SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("scans", "sinks", "scalars", "rules", "joins", "dedup", "aggregates", "windows", "ranking", "quality", "ledger", "ledger", "streams", "hooks", "flows",)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL twin if SQL can say the same."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    for module in _MODULES:
        import_module(f"litmill.catalog.{module}")
