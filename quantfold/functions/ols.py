"""Least squares from grouped moments: one aggregation pass, then a solve of at most 4 x 4 per group."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(cxx: pd.Series, cxy: pd.Series) -> pd.Series:
    import numpy as np

    def one(a, b):
        b = np.asarray(b, dtype=float)
        a = np.asarray(a, dtype=float).reshape(len(b), len(b))
        return np.linalg.lstsq(a, b, rcond=1e-10)[0].tolist()

    return pd.Series([one(a, b) for a, b in zip(cxx, cxy)])


def ols(rows: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Intercept, slopes, R2, adjusted R2 and residual deviation per key.

    A regressor that does not vary gets slope 0 (the minimum-norm answer).
    Groups with fewer than k + 2 rows (k counts the intercept) get nulls.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("_my"), F.var_pop(y).alias("_vy")]
    aggs += [F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)]
    aggs += [F.covar_pop(x, y).alias(f"_c{i}") for i, x in enumerate(xs)]
    aggs += [F.covar_pop(a, b).alias(f"_v{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    m = rows.groupBy(*keys).agg(*aggs)
    k = len(xs)
    cxx = F.array(*[F.col(f"_v{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    cxy = F.array(*[F.col(f"_c{i}") for i in range(k)])
    df = m.withColumn("_b", _solve(cxx, cxy))
    fitted = F.lit(0.0)
    shift = F.lit(0.0)
    for i in range(k):
        fitted = fitted + F.col("_b")[i] * F.col(f"_c{i}")
        shift = shift + F.col("_b")[i] * F.col(f"_m{i}")
    enough = F.col("n") >= k + 3
    r2 = F.when(F.col("_vy") > 0, fitted / F.col("_vy")).otherwise(F.lit(0.0))
    dof = F.greatest(F.col("n") - (k + 1), F.lit(1))
    ssr = F.greatest(F.col("n") * (F.col("_vy") - fitted), F.lit(0.0))
    out = df.select(
        *keys,
        "n",
        F.when(enough, F.col("_my") - shift).alias("intercept"),
        *[F.when(enough, F.col("_b")[i]).alias(f"beta_{x.removesuffix('_score')}") for i, x in enumerate(xs)],
        F.when(enough, r2).alias("r_squared"),
        F.when(enough, 1 - (1 - r2) * (F.col("n") - 1) / dof).alias("adj_r_squared"),
        F.when(enough, F.sqrt(ssr / dof)).alias("residual_std"),
    )
    return out
