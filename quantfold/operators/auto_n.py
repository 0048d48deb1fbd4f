"""Choice of the number of holdings per as-of date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions.exprs import minmax, month_diff, ratio
from quantfold.operators import estimators as est
from quantfold.operators.hybrid import tilted_weights
from quantfold.operators.stability import stability

POOL = 60
MAX_N = 30
MIN_N = 10
STEP = 2
STABILITY_LOOKBACK = 180
STABILITY_CALENDAR = int(STABILITY_LOOKBACK * 1.6)
FLAT = 0.02
EMPTY_N = 15
DEFAULT_VOL, DEFAULT_SHARPE, DEFAULT_CORR = 0.15, 1.0, 0.5


def prefixes(held: DataFrame) -> DataFrame:
    """First n held names in greedy order for every evaluated n, with their tilted weights.

    held(grp, stock_id, pick, score, vol): at most 30 names per date, so at most
    11 prefixes of them.
    """
    part = Window.partitionBy("grp")
    df = held.select("grp", "stock_id", "pick", "score", "vol").withColumn(
        "position", F.row_number().over(part.orderBy("pick"))
    ).withColumn("total", F.count(F.lit(1)).over(part))
    first = F.least(F.lit(MIN_N), F.col("total"))
    ns = F.sequence(first, F.least(F.lit(MAX_N), F.col("total")), F.lit(STEP))
    wide = df.withColumn("n", F.explode(ns)).where(F.col("position") <= F.col("n"))
    return tilted_weights(wide, ["grp", "n"])


def evaluate(
    weights: DataFrame,
    held: DataFrame,
    returns: DataFrame,
    long_returns: DataFrame,
    sls: DataFrame,
    rrc: DataFrame,
) -> DataFrame:
    """Evaluation table per (grp, n).

    weights from ``prefixes(held)``; covariance and shrunk means are taken over all
    held names, also those that no evaluated n includes; returns(grp, stock_id, idx, ret): the 90-day block;
    long_returns: the 180-day block for the stability estimate; sls, rrc: scores of the pool.
    """
    names = held.select("grp", "stock_id").distinct()
    some = returns.join(names, ["grp", "stock_id"], "left_semi")
    rows = est.complete_rows(some).select("grp", "stock_id", "idx", "ret")
    vol = est.portfolio_moments(rows, weights.select("grp", "n", "stock_id", "weight"), ["n"])
    mu = est.shrunk_returns(rows, annualize=252).select("grp", "stock_id", "mu")
    exp_ret = mu.join(weights, ["grp", "stock_id"]).groupBy("grp", "n").agg(
        F.sum(F.col("mu") * F.col("weight")).alias("expected_return")
    )
    order = weights.groupBy("grp", "stock_id").agg(F.min("position").alias("position"))
    corr = est.correlation_profile(some, order).withColumnRenamed("k", "n")
    top = Window.partitionBy("grp", "n").orderBy(F.desc("weight"), "stock_id")
    scored = (
        weights.withColumn("_k", F.row_number().over(top))
        .join(sls.select("grp", "stock_id", "stop_loss_score"), ["grp", "stock_id"], "left")
        .join(rrc.select("grp", "stock_id", "rrc_score"), ["grp", "stock_id"], "left")
    )
    aggs = scored.groupBy("grp", "n").agg(
        F.when(F.count(F.lit(1)) >= 3, F.sum(F.when(F.col("_k") <= 3, F.col("weight")))).otherwise(F.lit(1.0)).alias("top_3_weight"),
        F.coalesce(F.sum(F.col("weight") * F.col("stop_loss_score")), F.lit(50.0)).alias("sls_agg"),
        F.coalesce(F.sum(F.col("weight") * F.col("rrc_score")), F.lit(50.0)).alias("rrc_agg"),
    )
    curve = (
        long_returns.join(weights.select("grp", "n", "stock_id", "weight"), ["grp", "stock_id"])
        .groupBy("grp", "n", "idx")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("daily_return"))
        .select(F.struct("grp", "n").alias("portfolio"), F.col("idx").alias("date"), "daily_return")
    )
    stab = stability(curve).select("portfolio.grp", "portfolio.n", "stability_score")
    out = (
        aggs.join(vol, ["grp", "n"], "left")
        .join(exp_ret, ["grp", "n"], "left")
        .join(corr, ["grp", "n"], "left")
        .join(stab, ["grp", "n"], "left")
    )
    sharpe = F.when(F.col("expected_volatility").isNull(), F.lit(DEFAULT_SHARPE)).otherwise(
        ratio("expected_return", "expected_volatility", 0.0)
    )
    return (
        out.withColumn("sharpe_raw", sharpe)
        .withColumn("exp_vol", F.coalesce("expected_volatility", F.lit(DEFAULT_VOL)))
        .withColumn("avg_corr", F.coalesce("avg_abs_corr", F.lit(DEFAULT_CORR)))
        .withColumn("stability_score", F.coalesce("stability_score", F.lit(50.0)))
        .select("grp", "n", "sharpe_raw", "exp_vol", "avg_corr", "top_3_weight", "sls_agg", "rrc_agg", "stability_score")
    )


def benefit(table: DataFrame) -> DataFrame:
    """Benefit of each n: normalised Sharpe, diversification, stability, responsiveness, governance, concentration."""
    part = Window.partitionBy("grp")
    larger = part.orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    best_larger = F.max("sharpe_raw").over(larger)
    over = F.when((best_larger > 0) & (F.col("sharpe_raw") > best_larger * 1.5), F.lit(1.0)).otherwise(F.lit(0.0))
    conc = F.least(
        F.lit(1.0),
        F.greatest(F.lit(0.0), F.col("top_3_weight") - 0.40) * 2.0 + F.greatest(F.lit(0.0), F.col("avg_corr") - 0.50) * 2.0,
    )
    return (
        table.withColumn("sharpe_normalized", minmax("sharpe_raw", F.min("sharpe_raw").over(part), F.max("sharpe_raw").over(part)))
        .withColumn("diversification_score", F.greatest(F.lit(0.0), 1.0 - F.col("avg_corr")))
        .withColumn("concentration_penalty", conc)
        .withColumn("overfitting_risk", over)
        .withColumn("governance_score", 1.0 - F.col("overfitting_risk"))
        .withColumn(
            "portfolio_benefit",
            0.30 * F.col("sharpe_normalized")
            + 0.25 * F.col("diversification_score")
            + 0.25 * (F.col("stability_score") / 100.0)
            + 0.10 * (F.col("rrc_agg") / 100.0)
            + 0.10 * F.col("governance_score")
            - 0.10 * F.col("concentration_penalty"),
        )
    )


def optimal_n(table: DataFrame) -> DataFrame:
    """Largest n within 0.02 of the best benefit, above the regime floor, with the stability guardrail."""
    part = Window.partitionBy("grp")
    df = table.withColumn("_avg_vol", F.avg("exp_vol").over(part)).withColumn(
        "_floor", F.when(F.col("_avg_vol") > 0.25, 7).otherwise(5)
    )
    df = df.withColumn("_ok", F.col("n") >= F.col("_floor")).withColumn(
        "_allowed", F.col("_ok") | ~F.max("_ok").over(part)
    )
    best = F.max(F.when(F.col("_allowed"), F.col("portfolio_benefit"))).over(part)
    df = df.withColumn("_best", best)
    near = F.col("_allowed") & (F.col("portfolio_benefit") >= F.col("_best") - FLAT)
    df = df.withColumn("_n", F.max(F.when(near, F.col("n"))).over(part))
    df = df.withColumn("_stab", F.max(F.when(F.col("n") == F.col("_n"), F.col("stability_score"))).over(part))
    better = F.col("_allowed") & (F.col("n") > F.col("_n")) & (F.col("stability_score") > F.col("_stab"))
    out = df.groupBy("grp").agg(
        F.max("_n").alias("_n"),
        F.max("_stab").alias("_stab"),
        F.min(F.when(better, F.col("n"))).alias("_next"),
        F.max("_best").alias("max_benefit"),
        F.max("_avg_vol").alias("avg_vol"),
        (F.sum("concentration_penalty") > 0).alias("concentration_flag"),
        (F.sum("overfitting_risk") > 0).alias("overfit_flag"),
    )
    guard = (F.col("_stab") < 50) & F.col("_next").isNotNull()
    return out.select(
        "grp",
        F.when(guard, F.col("_next")).otherwise(F.col("_n")).alias("optimal_n"),
        "max_benefit",
        "avg_vol",
        (F.col("avg_vol") > 0.25).alias("high_vol_regime"),
        (F.col("avg_vol") < 0.12).alias("low_vol_regime"),
        "concentration_flag",
        "overfit_flag",
        guard.alias("stability_guardrail"),
    )


def reselection_due(states: DataFrame) -> DataFrame:
    """states(as_of, last_run): a newer date, or six months in the past, triggers a new selection."""
    newer = F.col("as_of") > F.col("last_run")
    old = month_diff("last_run", "as_of") >= 6
    return states.withColumn("due", F.col("last_run").isNull() | newer | old)
