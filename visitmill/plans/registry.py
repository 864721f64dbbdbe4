"""Named queries, each with the DuckDB text that must give the same rows (or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql

    def update(self, other: "Registry") -> None:
        for name, query in other.queries.items():
            self.add(name, query, other.sql.get(name))
