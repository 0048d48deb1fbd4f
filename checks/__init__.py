"""Independent DuckDB statements for the registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("core_sql", "risk_sql", "rating_sql", "view_sql", "hybrid_sql", "error_sql", "research_sql", "store_sql")


def all_statements() -> dict[str, str]:
    # building blocks of one module are used in others, so all are loaded first
    modules = [import_module(f"checks.{name}") for name in MODULES]
    return {name: sql for module in modules for name, sql in module.statements().items()}
