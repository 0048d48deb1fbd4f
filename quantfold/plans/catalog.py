"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quantfold.plans.registry import COVERS, QUERIES, runnable

MODULES = ("core_queries", "risk_queries", "rating_queries", "view_queries", "hybrid_queries", "error_queries", "research_queries", "store_queries")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for name in MODULES:
        import_module(f"quantfold.plans.{name}")
    return {name: runnable(name) for name in QUERIES}


def coverage() -> dict[str, str]:
    all_queries()
    return dict(COVERS)
