"""Registry of named queries: a Spark callable and (where SQL can say it) a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | Callable[[], str] | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle() if callable(oracle) else oracle
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries, queries_catalog, queries_io, queries_locker, queries_run, queries_tables  # noqa: F401
