"""Name -> (query, SQL) of every registered check."""

from __future__ import annotations

from .views import Tables, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a function of `Tables`; without `sql` only the row count is checked."""

    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return wrap
