"""Registry of named queries: a Spark builder `(spark, sf_dir) -> DataFrame`
and, where the result is expressible in SQL, a DuckDB twin over the same
tables. Modules under `stockpulse.plans.queries_*` register themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # Import for side effect: each module registers its queries.
    from stockpulse.plans import (queries_demand, queries_quality, queries_features,  # noqa: F401
                                  queries_models, queries_ml, queries_ops, queries_inputs)
    return dict(_REGISTRY)
