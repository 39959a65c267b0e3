"""Named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, *, name: str | None = None):
        """Registers a function of a table loader as a query, with its SQL if SQL can express it."""

        def register(f):
            key = name or f.__name__
            self.queries[key] = lambda spark, d: f(lambda t: table(spark, d, t))
            if sql:
                self.oracles[key] = sql
            return f

        return register
