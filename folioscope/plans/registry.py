"""A catalogue of named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name; `add` registers a function under its own name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql:
                self.oracles[fn.__name__] = sql
            return fn

        return register

    def describe(self) -> list[tuple[str, str]]:
        """(name, first line of its description) of every query."""
        return [(n, (f.__doc__ or "").strip().split("\n")[0]) for n, f in sorted(self.queries.items())]
