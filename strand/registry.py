"""Where operator modules register their queries and DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: register ``name`` with its DuckDB twin, if there is one."""

    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _ORACLES[name] = sql
        return query

    return add


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["thread_flagship"](spark, sf_dir)


def queries() -> dict[str, Query]:
    import strand.queries  # noqa: F401  fills the registry
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import strand.queries  # noqa: F401
    return dict(_ORACLES)
