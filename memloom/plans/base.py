"""Registration of queries by name."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """The queries of a module, their SQL, and the decorator that puts a query there by its name, with the SQL that gives the same rows."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return put

    return queries, sql, query
