"""Queries over the given tables, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, table reader) as a query of (spark, sf_dir)."""

    def register(make: Callable) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: make(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            _SQL[name] = sql
        return make

    return register


def _load() -> None:
    from peaklane.plans import queries_aggregates, queries_joins, queries_jobs, queries_scalars, queries_signal, queries_sources  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
