"""Registry of keyed queries: ``key -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: register a query under ``key`` with its DuckDB oracle SQL (None = rows-only)."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in _QUERIES:
            raise ValueError(f"duplicate key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = sql
        return fn
    return deco


def _load() -> None:
    # Importing the plan modules registers their queries.
    from tracekit.plans import (curation, evaluation, refinement, positions, critic_data,  # noqa: F401
                                requests, augmentation, reports, io_jobs, streams)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
