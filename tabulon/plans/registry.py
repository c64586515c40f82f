"""Registration of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

_MODULES = (
    "tabulon.plans.panel_queries",
    "tabulon.plans.ingest_queries",
    "tabulon.plans.library_queries",
    "tabulon.plans.search_queries",
    "tabulon.plans.scoring_queries",
    "tabulon.plans.dialog_queries",
    "tabulon.plans.context_queries",
    "tabulon.plans.payload_queries",
    "tabulon.plans.admission_queries",
    "tabulon.plans.activity_queries",
    "tabulon.plans.housing_queries",
)


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def _load():
    for m in _MODULES:
        importlib.import_module(m)


def all_queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def all_oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE_SQL)
