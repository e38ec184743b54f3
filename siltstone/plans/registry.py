"""All queries of the library by name, with their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("search", "knowledge", "answers", "site", "stats", "graph", "lifecycle", "queue", "texts", "state", "documents")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``."""

    def keep(f: Callable) -> Callable:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"siltstone.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
