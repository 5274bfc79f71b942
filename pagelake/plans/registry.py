"""The register of queries: a function of views, and SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import duckdb_sql, view

Views = Callable[..., DataFrame]  # of a name, and how it is read: see ``view``
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Register a function of ``views`` under its name, with DuckDB SQL over the views named."""

    def put(body: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[body.__name__] = lambda spark, sf_dir: body(lambda name, **how: view(spark, sf_dir, name, **how))
        if sql:
            SQL[body.__name__] = duckdb_sql(sql, *views)
        return body

    return put
