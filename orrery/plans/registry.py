"""Where queries are registered, each beside the SQL that gives the same rows."""

from __future__ import annotations

from . import views as v

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = v.with_views(sql)
        return f

    return put
