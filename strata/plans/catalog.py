"""Registry of named queries: Spark implementation + oracle SQL (DuckDB).

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
*whole* input tables.  The oracle SQL (when present) computes the same
result independently in DuckDB over the same Parquet files; queries whose
semantics are not expressible in SQL (model fits, iterative clustering,
streaming) are registered without SQL and are checked by tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}
_HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        if headline:
            _HEADLINE.append(name)
        return fn
    return deco


def _load_all() -> None:
    # importing the modules fills the registry
    from strata.plans import (  # noqa: F401
        q_relational, q_aggregates, q_quality, q_features, q_evaluate, q_models,
        q_cluster, q_streaming, q_sources,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def headline() -> list[str]:
    _load_all()
    return list(_HEADLINE)
