"""Names of the queries over the driver tables, and their SQL."""

from __future__ import annotations

from . import queries_s, queries_t


def queries() -> dict:
    return queries_t.QUERIES | queries_s.QUERIES


def oracle_sql() -> dict:
    return queries_t.SQL | queries_s.SQL
