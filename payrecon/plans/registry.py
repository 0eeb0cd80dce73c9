"""The queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from . import delimited_queries, history_queries, layout_queries, reconcile_queries, scalar_queries, whole_queries

MODULES = (scalar_queries, reconcile_queries, history_queries, delimited_queries, layout_queries, whole_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
