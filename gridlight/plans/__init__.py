"""Registered queries: each module gives QUERIES (name -> callable) and ORACLES (name -> DuckDB SQL)."""

from __future__ import annotations

from importlib import import_module

#: The modules of this package that register queries.
MODULES = ("metrics", "grids", "inventory", "banks", "cloud", "methods", "bootstraps", "controls", "deployment", "reports", "learned")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__name__}.{m}").ORACLES.items()}
