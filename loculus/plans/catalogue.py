"""Driver queries over the provided tables, each beside independent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def dotted(key: F.Column) -> F.Column:
    return F.array_join(key.cast("array<string>"), ".")


from loculus.plans import alignment_queries, catalog_queries, search_queries, table_queries  # noqa: E402, F401
