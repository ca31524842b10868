"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demolake.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL over the driver's tables and the views of ``fixtures``."""

    def register(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return register


def _load() -> None:
    from demolake.plans import accuracy, assembly, episodes, evaluation, geometry, points, samples, stores, streams, vectors  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
