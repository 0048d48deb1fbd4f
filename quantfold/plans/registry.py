"""Name -> query registry. A query is a function from a Market to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantfold.functions.exprs import rounded
from quantfold.plans.market import Market, market

QUERIES: dict[str, Callable[[Market], DataFrame]] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str = ""):
    """Register a query; ``covers`` lists the inventory ids it answers."""

    def add(fn: Callable[[Market], DataFrame]):
        QUERIES[name] = fn
        COVERS[name] = covers
        return fn

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, leave the rest."""
    return df.select(*[rounded(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(market(spark, sf_dir))

    run.__name__ = name
    run.__doc__ = fn.__doc__
    return run
