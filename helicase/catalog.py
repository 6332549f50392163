"""Every query of the screening engine with its SQL twin."""

from __future__ import annotations

from .plans import access_queries, block_queries, fold_queries, hit_queries, model_queries

MODULES = [block_queries, hit_queries, access_queries, model_queries, fold_queries]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
