"""Registered queries over the given tables, and their SQL."""

from __future__ import annotations

from tapewright.plans import detector_queries, table_queries

QUERIES: dict = detector_queries.QUERIES | table_queries.QUERIES
ORACLE_SQL: dict[str, str] = detector_queries.ORACLE_SQL | table_queries.ORACLE_SQL
