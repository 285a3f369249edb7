"""How queries register: a name, the DataFrame form, and the SQL that DuckDB runs beside it."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame under its own name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep
