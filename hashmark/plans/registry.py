"""Named queries and, where SQL can say the same, the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects the queries of a module with ``@registry.query(name, sql)``."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep

    def merged(self, *others: Registry) -> Registry:
        out = Registry()
        for r in (self, *others):
            if twice := out.queries.keys() & r.queries.keys():
                raise ValueError(f"two queries named {sorted(twice)}")
            out.queries |= r.queries
            out.sql |= r.sql
        return out
