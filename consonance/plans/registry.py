"""Registry of named queries over the driver tables, each with an optional DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: ``@register("f7_kernel_moments", sql=...)`` on ``fn(spark, sf_dir)``."""

    def deco(fn: QueryFn) -> QueryFn:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = sql
        return fn

    return deco


def _load_all() -> None:
    # Importing the plan modules fills the registry.
    from . import (claim_plans, dispersion_plans, entity_plans, label_plans,  # noqa: F401
                   nli_plans, result_plans, statement_plans)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
