"""Every operator as a query over the given tables, with its DuckDB SQL."""

from __future__ import annotations

import importlib

from queuelens.catalog.registry import QUERIES, SQL

MODULES = ("sources", "sinks", "rows", "lookups", "aggregates", "ordered", "select", "streams", "models", "odd")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"queuelens.catalog.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(SQL)
