"""All queries of the retrieval engine, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from quarry.plans import analysis, indexed, patches, retrieval, symbols, views  # noqa: F401
from quarry.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
