"""Where the queries of this folder and their SQL are kept."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a function (spark, folder) under its name, with the same question in SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH RECURSIVE {','.join(ctes)}\n" if ctes else "") + sql
        return f

    return add
