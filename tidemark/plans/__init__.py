"""Registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["intervals", "rules", "sequence", "planning", "graph", "data", "experiments"]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in import_module(f"{__name__}.{m}").SQL.items()}
