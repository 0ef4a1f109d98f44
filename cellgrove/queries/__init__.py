"""The registered queries of the core: name to function of (spark, folder), and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("counts", "graphs", "labels", "learned", "near", "quality", "statistics", "tissue")


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = import_module(f"cellgrove.queries.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
