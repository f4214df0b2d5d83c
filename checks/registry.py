"""Named queries and their SQL."""

from __future__ import annotations

QUERIES = {}
ORACLES = {}


def check(sql: str | None = None, name: str | None = None):
    """Registers a query, under its function's name if no other is given, with its SQL."""

    def register(query):
        key = name or query.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return register
