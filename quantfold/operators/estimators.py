"""Return and covariance estimators per group (rebalance date, portfolio set)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions import linalg
from quantfold.tables import bounded

PRIOR_STRENGTH = 60.0
FORWARD_DAYS = 21
FORWARD_CALENDAR = int(FORWARD_DAYS * 1.5)
LOOKBACK = 90
LOOKBACK_CALENDAR = int(LOOKBACK * 1.6)
SCORE_SCALE = 0.002


def shrinkage_lambda(n_obs: Column, k: float = PRIOR_STRENGTH) -> Column:
    """T / (T + k); zero without observations or with a negative k."""
    if k < 0:
        return F.lit(0.0)
    return F.when(n_obs > 0, n_obs / (n_obs + F.lit(float(k)))).otherwise(F.lit(0.0))


def trailing_returns(
    names: DataFrame, panel: DataFrame, spans: DataFrame, lookback: int | None = LOOKBACK, *, universe: bool = False
) -> DataFrame:
    """Last ``lookback`` daily returns (None: all) of each group's names inside its calendar window.

    names(grp, stock_id), spans(grp, lo_idx, hi_idx). The first day of the window has no return.
    Selected names are repeated for their days and looked up in the panel. With ``universe`` the names are
    most stocks: the panel's rows are repeated for the groups of their day where its buckets are read, and only
    the names, not their days, are dealt out by stock.
    """
    opening = F.col("lo_idx") + 1
    first = opening if lookback is None else F.greatest(opening, F.col("hi_idx") - (lookback - 1))
    days = spans.select("grp", first.alias("from_idx"), "hi_idx")
    if universe:
        each = days.where(F.col("from_idx") <= F.col("hi_idx")).select("grp", F.explode(F.sequence("from_idx", "hi_idx")).alias("idx"))
        rows = panel.select("stock_id", "idx", "ret").where(F.col("ret").isNotNull()).join(bounded(each), "idx")
        return rows.join(names.select("grp", "stock_id").hint("shuffle_hash"), ["stock_id", "grp"]).select("grp", "stock_id", "idx", "ret")
    return (
        names.select("grp", "stock_id")
        .join(days, "grp")
        .where(F.col("from_idx") <= F.col("hi_idx"))
        .select("grp", "stock_id", F.explode(F.sequence("from_idx", "hi_idx")).alias("idx"))
        .join(panel.select("stock_id", "idx", "ret"), ["stock_id", "idx"])
        .where(F.col("ret").isNotNull())
        .select("grp", "stock_id", "idx", "ret")
    )


def _same(df: DataFrame) -> DataFrame:
    return df


def shrunk_returns(
    returns: DataFrame, k: float = PRIOR_STRENGTH, annualize: int = 1, cut: Callable[[DataFrame], DataFrame] = _same
) -> DataFrame:
    """James-Stein means: each stock's mean pulled to the group mean by T / (T + k).

    T is the number of days on which any name of the group has a return (``n_obs``), ``last_idx`` the newest
    day of each stock. ``cut`` may stage the means per stock, which are read twice.
    """
    per = cut(returns.groupBy("grp", "stock_id").agg(F.avg("ret").alias("sample_mean"), F.max("idx").alias("last_idx")))
    days = returns.groupBy("grp").agg(F.count_distinct("idx").alias("n_obs"))
    prior = per.groupBy("grp").agg(F.avg("sample_mean").alias("prior"))
    lam = shrinkage_lambda(F.col("n_obs"), k)
    return per.join(days, "grp").join(prior, "grp").select(
        "grp",
        "stock_id",
        "sample_mean",
        "prior",
        lam.alias("lambda"),
        ((lam * F.col("sample_mean") + (1 - lam) * F.col("prior")) * annualize).alias("mu"),
        "n_obs",
        "last_idx",
    )


def error_corrected(predicted: DataFrame, factors: DataFrame, calibration: DataFrame | None, enabled: bool = True) -> DataFrame:
    """Subtract the calibrated bias b0 + b * factors from the predictions.

    predicted(grp, stock_id, mu); factors(grp, stock_id, any *_score columns);
    calibration: rows (window_end?, intercept, beta_momentum, beta_quality, beta_value,
    beta_volatility), of which the newest window counts; with a column ``grp`` each group has its own row
    (see ``error_model.calibration_as_of``). Missing factor columns and values count as zero. Without a
    calibration, or when disabled, the predictions stay as they are.
    """
    if not enabled or calibration is None:
        return predicted.withColumn("bias", F.lit(0.0))
    wanted = ["momentum", "quality", "value", "volatility"]
    have = [w for w in wanted if f"{w}_score" in factors.columns]
    joined = predicted.join(factors.select("grp", "stock_id", *[f"{w}_score" for w in have]), ["grp", "stock_id"], "left")
    keyed = ["grp"] if "grp" in calibration.columns else []
    ages = ["window_end"] if "window_end" in calibration.columns else []
    newest = F.max(F.struct(*ages, "intercept", *[f"beta_{w}" for w in wanted])).alias("c")
    # a row per as-of date, or one for all
    one = bounded(calibration.groupBy(*keyed).agg(newest).select(*keyed, "c.intercept", *[f"c.beta_{w}" for w in wanted]))
    bias: Column = F.coalesce("intercept", F.lit(0.0))
    for w in have:
        bias = bias + F.coalesce(f"beta_{w}", F.lit(0.0)) * F.coalesce(f"{w}_score", F.lit(0.0))
    out = joined.join(one, keyed or F.lit(True), "left").withColumn("bias", bias)
    return out.withColumn("mu", F.col("mu") - F.col("bias")).select(*predicted.columns, "bias")


def covariance_report(returns: DataFrame, method: str = "manual", alpha: float = 0.8) -> DataFrame:
    """Condition numbers, shrinkage, jitter, eigenvalue range and rank of each group's covariance.

    A group is one selected portfolio (at most 60 names x 90 days), so its dense
    matrix fits one task.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = linalg.wide_returns(pdf, sorted(pdf["stock_id"].unique()))
        return pd.DataFrame([{"grp": key[0], **linalg.robust_covariance(wide, method, alpha).report()}])[columns]

    columns = [
        "grp", "shrinkage", "cond_before", "cond_after", "jitter", "n_assets", "n_obs",
        "min_eigenvalue", "max_eigenvalue", "is_positive_definite", "is_symmetric", "rank",
    ]
    return returns.groupBy("grp").applyInPandas(
        one,
        "grp int, shrinkage double, cond_before double, cond_after double, jitter double, n_assets int, n_obs int, "
        "min_eigenvalue double, max_eigenvalue double, is_positive_definite boolean, is_symmetric boolean, rank int",
    )


def covariance_entries(returns: DataFrame, alpha: float = 0.8) -> DataFrame:
    """grp, a, b, value: all entries of the blended covariance of each group, a row each.

    ``alpha`` times the sample covariance plus the rest times the mean variance on the diagonal.
    returns(grp, stock_id, idx, ret) are complete; a group is one selected set (at most a few dozen names).
    """
    x, y = returns.alias("x"), returns.alias("y")
    met = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.idx") == F.col("y.idx")))
    cov = met.groupBy("x.grp", F.col("x.stock_id").alias("a"), F.col("y.stock_id").alias("b")).agg(F.covar_samp("x.ret", "y.ret").alias("cov"))
    mean = F.avg(F.when(F.col("a") == F.col("b"), F.col("cov"))).over(Window.partitionBy("grp"))
    diagonal = F.when(F.col("a") == F.col("b"), (1 - alpha) * mean).otherwise(0.0)
    return cov.select("grp", "a", "b", (alpha * F.col("cov") + diagonal).alias("value"))


def covariance_pivots(entries: DataFrame) -> DataFrame:
    """grp, position, stock_id, pivot_value of each covariance, by elimination in the order of the names.

    A fold over the names: each step takes the first pivot and leaves the remainder without that name. All pivots
    are positive exactly if the matrix is positive definite, and their product is its determinant.
    """
    rows = entries.groupBy("grp", "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "value"))), lambda e: e["value"]).alias("row"))
    matrix = rows.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("a", "row"))).alias("m"))
    start = F.struct(F.transform("m", lambda r: r["row"]).alias("m"), F.array().cast("array<double>").alias("p"))

    def step(acc, _):
        top = F.get(acc["m"], F.lit(0))
        pivot = F.get(top, F.lit(0))
        rest = F.slice(top, F.lit(2), F.greatest(F.size(top) - 1, F.lit(0)))
        below = F.slice(acc["m"], F.lit(2), F.greatest(F.size(acc["m"]) - 1, F.lit(0)))
        left = F.transform(
            below, lambda r: F.zip_with(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), rest, lambda v, t: v - F.try_divide(F.get(r, F.lit(0)), pivot) * t)
        )
        return F.struct(left.alias("m"), F.concat(acc["p"], F.array(pivot)).alias("p"))

    folded = F.aggregate(F.sequence(F.lit(1), F.size("m")), start, step, lambda acc: acc["p"])
    names = matrix.select("grp", F.arrays_zip(F.transform("m", lambda r: r["a"]).alias("stock_id"), folded.alias("pivot")).alias("z"))
    return names.select("grp", F.posexplode("z").alias("position", "e")).select("grp", (F.col("position") + 1).alias("position"), F.col("e.stock_id").alias("stock_id"), F.col("e.pivot").alias("pivot_value"))


def covariance_summary(entries: DataFrame, pivots: DataFrame) -> DataFrame:
    """Per group: names, trace, sum of squares (both basis-free), least pivot, log of the determinant, positive definite or not."""
    sums = entries.groupBy("grp").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("value"))).alias("trace"), F.sum(F.col("value") * F.col("value")).alias("sum_squares"))
    of = pivots.groupBy("grp").agg(F.count("*").alias("n_assets"), F.min("pivot_value").alias("min_pivot"), F.sum(F.when(F.col("pivot_value") > 0, F.log("pivot_value"))).alias("log_det"))
    return sums.join(of, "grp").select("grp", "n_assets", "trace", "sum_squares", "min_pivot", "log_det", (F.col("min_pivot") > 0).alias("is_positive_definite"))


def correlation_profile(returns: DataFrame, order: DataFrame) -> DataFrame:
    """Average |correlation| of the first k names of each group, for every k.

    order(grp, stock_id, position). Only the averages leave the task, not the pairs.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = pdf.drop_duplicates("stock_id").sort_values("position")["stock_id"].tolist()
        wide = linalg.wide_returns(pdf, names)
        c = np.abs(wide.corr().to_numpy())
        rows = []
        for k in range(2, c.shape[0] + 1):
            upper = c[:k, :k][np.triu_indices(k, 1)]
            upper = upper[~np.isnan(upper)]
            rows.append((key[0], k, float(upper.mean()) if len(upper) else None))
        return pd.DataFrame(rows, columns=["grp", "k", "avg_abs_corr"]).astype({"grp": "int32", "k": "int32"})

    return (
        returns.join(order.select("grp", "stock_id", "position"), ["grp", "stock_id"])
        .groupBy("grp")
        .applyInPandas(one, "grp int, k int, avg_abs_corr double")
    )


def complete_rows(returns: DataFrame) -> DataFrame:
    """Days on which every name of the group has a return."""
    names = returns.groupBy("grp").agg(F.count_distinct("stock_id").alias("n_names"))
    full = (
        returns.groupBy("grp", "idx")
        .agg(F.count("ret").alias("k"))
        .join(names, "grp")
        .where(F.col("k") == F.col("n_names"))
        .select("grp", "idx", "n_names")
    )
    return returns.join(full, ["grp", "idx"])


def portfolio_moments(returns: DataFrame, weights: DataFrame, keys: list[str], alpha: float = 0.8) -> DataFrame:
    """Expected volatility of weighted portfolios under the shrunk covariance.

    w'Sw is the variance of the weighted return series, so no pairs are formed:
    alpha * var(sum w r) + (1 - alpha) * mean variance * sum w^2, annualised.
    weights(grp, keys..., stock_id, weight) are rescaled to one.
    """
    per_stock = returns.groupBy("grp", "stock_id").agg(F.var_samp("ret").alias("v"))
    avg_var = per_stock.groupBy("grp").agg(F.avg("v").alias("avg_var"))
    w = weights.withColumn("w", F.col("weight") / F.sum("weight").over(Window.partitionBy("grp", *keys)))
    sq = w.groupBy("grp", *keys).agg(F.sum(F.col("w") * F.col("w")).alias("w2"))
    series = (
        returns.join(w.select("grp", *keys, "stock_id", "w"), ["grp", "stock_id"])
        .groupBy("grp", *keys, "idx")
        .agg(F.sum(F.col("w") * F.col("ret")).alias("p"))
        .groupBy("grp", *keys)
        .agg(F.var_samp("p").alias("pv"))
    )
    pv = (F.lit(alpha) * F.col("pv") + F.lit(1 - alpha) * F.col("avg_var") * F.col("w2")) * 252
    return series.join(sq, ["grp", *keys]).join(avg_var, "grp").select(
        "grp", *keys, F.sqrt(F.greatest(pv, F.lit(0.0))).alias("expected_volatility")
    )


def predicted_from_score(score: Column) -> Column:
    return (score / 100.0 - 0.5) * SCORE_SCALE * FORWARD_DAYS


def predicted_from_shrinkage(returns: DataFrame, cut: Callable[[DataFrame], DataFrame] = _same) -> DataFrame:
    """Shrunk daily mean times 21 and its newest day; groups need at least five price rows (four returns)."""
    return shrunk_returns(returns, cut=cut).where(F.col("n_obs") >= 4).select(
        "grp", "stock_id", (F.col("mu") * FORWARD_DAYS).alias("predicted_return"), "last_idx"
    )


def forward_returns(as_of: DataFrame, calendar: DataFrame, panel: DataFrame, window_end: Column | None = None) -> DataFrame:
    """Return from the first price day on or after each date to the 21st day after it.

    The exit must lie within 31 calendar days of the entry (and before
    ``window_end``); otherwise there is no row. as_of(grp, as_of). ``exit_date`` is the day on which the return is known.
    """
    entry = (
        calendar.join(bounded(as_of), F.col("date") >= F.col("as_of"))
        .groupBy("grp", "as_of")
        .agg(F.min("idx").alias("i0"), F.min("date").alias("d0"))
    )
    exits = calendar.select(F.col("idx").alias("i1"), F.col("date").alias("d1"))
    ok = (F.col("i1") == F.col("i0") + FORWARD_DAYS) & (F.col("d1") <= F.date_add("d0", FORWARD_CALENDAR))
    if window_end is not None:
        ok = ok & (F.col("d1") <= window_end)
    pairs = entry.join(exits, ok).select("grp", "as_of", "i0", "i1", "d1")
    ends = pairs.select("grp", "as_of", F.explode(F.array("i0", "i1")).alias("idx"), "i0", "i1", "d1")
    px = panel.select("stock_id", "idx", "close").join(bounded(ends), "idx")
    return (
        px.groupBy("grp", "as_of", "stock_id")
        .agg(
            F.max(F.when(F.col("idx") == F.col("i0"), F.col("close"))).alias("p0"),
            F.max(F.when(F.col("idx") == F.col("i1"), F.col("close"))).alias("p1"),
            F.max("d1").alias("exit_date"),
        )
        .select("grp", "as_of", "stock_id", (F.col("p1") / F.col("p0") - 1).alias("forward_return"), "exit_date")
        .where(F.col("forward_return").isNotNull())
    )
