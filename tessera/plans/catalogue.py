"""All queries of the core, and their SQL."""

from __future__ import annotations

from . import problems, reference_queries, reference_sql

QUERIES: dict[str, problems.Query] = {**problems.QUERIES, **reference_queries.QUERIES}
SQL: dict[str, str] = {**problems.SQL, **reference_sql.SQL}
