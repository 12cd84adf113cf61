"""Families of queries: each a function of (spark, folder), most with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Family:
    """Collects queries under their function names."""

    def __init__(self):
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.QUERIES[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return add
