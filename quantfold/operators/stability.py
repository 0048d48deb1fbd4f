"""Rolling stability, regime splits and portfolio responsiveness on equity curves.

Curves have one row per portfolio and trading day, so windows partitioned by
portfolio never hold more rows than the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions.exprs import SQRT_YEAR, clip, ladder, linear_score, rounded
from quantfold.operators.risk import deepest_drawdown, spike_starts

FULL_WINDOW = 252
MIN_DAYS = 63
MIN_REGIME_DAYS = 120
STABILITY_WEIGHTS = {"sharpe": 0.25, "drawdown": 0.25, "turnover": 0.20, "correlation": 0.20, "regime": 0.10}
STABILITY_GRADES = [(80, "A"), (65, "B"), (50, "C"), (35, "D")]


def rolling_metrics(curve: DataFrame) -> DataFrame:
    """Rolling Sharpe, CAGR and in-window maximum drawdown per portfolio and day.

    The window is 252 rows, or half the history when that is shorter; half a
    window is enough to start. Sums over the window are differences of running
    sums, joined on the row number because the window length differs by portfolio.
    The drawdown of a window is merged from two summaries (extreme equity, deepest
    drop): rows are cut into blocks of one window length, so a window is the end of one
    block and the start of the next, both known from running extremes.
    """
    part = Window.partitionBy("portfolio")
    order = part.orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("daily_return")
    rows = curve.where(r.isNotNull()).select(
        "portfolio",
        "date",
        r.alias("r"),
        F.row_number().over(order).alias("rn"),
        F.count(F.lit(1)).over(part).alias("n"),
        F.sum(r).over(upto).alias("c1"),
        F.sum(r * r).over(upto).alias("c2"),
        F.product(1 + r).over(upto).alias("cp"),
    )
    rows = rows.where(F.col("n") >= MIN_DAYS).withColumn(
        "w", F.when(F.col("n") >= FULL_WINDOW, F.lit(FULL_WINDOW)).otherwise(F.floor(F.col("n") / 2).cast("int"))
    )
    rows = _block_drawdowns(rows)
    by_row = Window.partitionBy("portfolio").orderBy("rn")
    following = [F.lead(c).over(by_row).alias(f"{c}_next") for c in ("block", "end_high", "end_drop")]
    old = rows.select(
        "portfolio", (F.col("rn") + F.col("w")).alias("rn"), F.col("c1").alias("o1"), F.col("c2").alias("o2"), F.col("cp").alias("op"), *following
    )
    both = rows.join(old, ["portfolio", "rn"], "left")
    k = F.least("rn", "w").cast("double")
    s1 = F.col("c1") - F.coalesce("o1", F.lit(0.0))
    s2 = F.col("c2") - F.coalesce("o2", F.lit(0.0))
    var = F.greatest((s2 - s1 * s1 / k) / (k - 1), F.lit(0.0))
    std = F.when(k > 1, F.sqrt(var))
    started = F.col("rn") >= F.floor(F.col("w") / 2)
    across = F.try_divide("start_low", "end_high_next") - 1
    mdd = F.when(F.col("block_next") < F.col("block"), F.least("end_drop_next", "start_drop", across)).otherwise(F.col("start_drop"))
    cagr = F.pow(F.col("cp") / F.coalesce("op", F.lit(1.0)), F.lit(252.0) / F.col("w")) - 1
    return both.where(started).select(
        "portfolio",
        "date",
        "n",
        F.try_divide(s1 / k, std * 1.0).alias("_q"),
        cagr.alias("rolling_cagr"),
        mdd.alias("rolling_maxdd"),
    ).select(
        "portfolio", "date", "n", (F.col("_q") * F.lit(SQRT_YEAR)).alias("rolling_sharpe"), "rolling_cagr", "rolling_maxdd"
    )


def _block_drawdowns(rows: DataFrame) -> DataFrame:
    """Adds, for blocks of ``w`` rows of an equity ``cp``: the lowest equity and deepest drop from the block's first row to this one
    (start_low, start_drop) and the highest equity and deepest drop from this row to the block's last one (end_high, end_drop)."""
    rows = rows.withColumn("block", F.floor((F.col("rn") - 1) / F.col("w")))
    block = Window.partitionBy("portfolio", "block")
    onward = block.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    back = block.orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)
    extremes = {"start_low": F.min("cp").over(onward), "_peak": F.max("cp").over(onward), "end_high": F.max("cp").over(back), "_trough": F.min("cp").over(back)}
    drops = {
        "start_drop": F.min(F.try_divide("cp", "_peak") - 1).over(onward),
        "end_drop": F.min(F.try_divide("_trough", "cp") - 1).over(back),
    }
    return rows.withColumns(extremes).withColumns(drops).drop("_peak", "_trough")


def correlation_history(weights: DataFrame, periods: DataFrame, panel: DataFrame) -> DataFrame:
    """portfolio, seq, avg_pairwise_corr: mean correlation of a portfolio's stocks inside each holding period.

    No pairs: with every stock's returns standardised over the period, the variance of their daily sum is
    k + k (k - 1) times the mean correlation. Stocks without a return on every day of the period or without
    spread are left out; below two stocks or three days there is no value.
    """
    days = weights.select("portfolio", "reb_no", "stock_id").join(F.broadcast(periods.select("reb_no", "reb_idx", "end_idx")), "reb_no")
    days = days.select("portfolio", "reb_no", "stock_id", (F.col("end_idx") - F.col("reb_idx")).alias("n_days"), F.explode(F.sequence(F.col("reb_idx") + 1, F.col("end_idx"))).alias("idx"))
    held = days.join(panel.select("stock_id", "idx", "ret"), ["stock_id", "idx"]).where(F.col("ret").isNotNull())
    own = Window.partitionBy("portfolio", "reb_no", "stock_id")
    z = F.try_divide(F.col("ret") - F.avg("ret").over(own), F.stddev_samp("ret").over(own))
    whole = F.count("ret").over(own) == F.col("n_days")
    rows = held.withColumns({"z": z, "whole": whole}).where(F.col("whole") & F.col("z").isNotNull())
    daily = rows.groupBy("portfolio", "reb_no", "idx").agg(F.sum("z").alias("z"), F.count("z").alias("k"))
    k = F.max("k")
    mean = F.when((k > 1) & (F.count("z") > 2), (F.var_samp("z") - k) / (k * (k - 1)))
    return daily.groupBy("portfolio", "reb_no").agg(mean.alias("avg_pairwise_corr")).withColumnRenamed("reb_no", "seq")


def _sharpe(mask: Column | None = None) -> Column:
    r = F.col("daily_return") if mask is None else F.when(mask, F.col("daily_return"))
    return F.coalesce(F.try_divide(F.avg(r), F.stddev_samp(r)) * F.lit(SQRT_YEAR), F.lit(0.0))


def regime_rows(curve: DataFrame, window: int, min_rows: int = 10) -> DataFrame:
    """Curve rows with the rolling volatility and its median per portfolio.

    Rounding keeps equal volatilities equal on flat stretches.
    """
    order = Window.partitionBy("portfolio").orderBy("date").rowsBetween(-(window - 1), 0)
    vol = F.when(
        F.count("daily_return").over(order) >= min_rows, F.round(F.stddev_samp("daily_return").over(order), 12)
    )
    return curve.select("portfolio", "date", "daily_return").withColumn("vol", vol).withColumn(
        "median_vol", F.median("vol").over(Window.partitionBy("portfolio"))
    )


def regime_sharpe(curve: DataFrame) -> DataFrame:
    """Sharpe in high- and low-volatility days (20-day, warm-up in neither) with the adjusted gap."""
    rows = regime_rows(curve, 20)
    base = rows.groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("n_days"),
        _sharpe(F.col("vol") >= F.col("median_vol")).alias("sharpe_high"),
        _sharpe(F.col("vol") < F.col("median_vol")).alias("sharpe_low"),
        _sharpe().alias("sharpe_all"),
    )
    lo, hi = F.least("sharpe_high", "sharpe_low"), F.greatest("sharpe_high", "sharpe_low")
    gap = F.abs(F.col("sharpe_high") - F.col("sharpe_low"))
    adjusted = (
        F.when(lo >= 0, F.greatest(F.lit(0.0), gap - hi * 0.75))
        .when(lo > -0.5, F.greatest(F.lit(0.0), gap - hi * 0.25))
        .otherwise(gap)
    )
    short = F.col("n_days") < MIN_REGIME_DAYS
    bad = F.greatest(F.lit(2.0), F.abs("sharpe_all") * 1.5)
    return base.withColumn("gap", adjusted).select(
        "portfolio",
        "n_days",
        F.when(short, F.lit(0.0)).otherwise(F.col("sharpe_high")).alias("regime_sharpe_high"),
        F.when(short, F.lit(0.0)).otherwise(F.col("sharpe_low")).alias("regime_sharpe_low"),
        F.when(short, F.lit(0.0)).otherwise(F.col("gap")).alias("regime_sharpe_gap"),
        F.when(short, F.lit(50.0)).otherwise(linear_score("gap", bad)).alias("regime_score"),
    )


def regime_cagr(curve: DataFrame) -> DataFrame:
    """CAGR in high-volatility days (30-day volatility at or above its median) and in the rest.

    Warm-up days count as low volatility.
    """
    rows = regime_rows(curve, 30).withColumn("high", F.coalesce(F.col("vol") >= F.col("median_vol"), F.lit(False)))

    def cagr(mask: Column) -> Column:
        n = F.count(F.when(mask, 1))
        total = F.product(F.when(mask, 1 + F.col("daily_return")).otherwise(F.lit(1.0)))
        return F.when(n >= 2, F.pow(total, F.lit(252.0) / F.greatest(n, F.lit(1))) - 1).otherwise(F.lit(0.0))

    ok = F.max("median_vol") > 0
    return (
        rows.groupBy("portfolio")
        .agg(
            F.when(ok, cagr(F.col("high"))).alias("cagr_high_vol"),
            F.when(ok, cagr(~F.col("high"))).alias("cagr_low_vol"),
        )
        .withColumn("regime_difference", F.abs(F.col("cagr_high_vol") - F.col("cagr_low_vol")))
    )


def stability(
    curve: DataFrame, turnovers: DataFrame | None = None, correlations: DataFrame | None = None
) -> DataFrame:
    """Stability score (0-100) with components and grade per portfolio.

    turnovers(portfolio, seq, turnover): sum of absolute changes per rebalance,
    seq 1 being the first holding; correlations(portfolio, seq, avg_pairwise_corr).
    Without them the turnover and correlation components are a neutral 50.
    """
    days = curve.groupBy("portfolio").agg(F.count("daily_return").alias("n_days"))
    roll = rolling_metrics(curve).groupBy("portfolio").agg(
        F.count("rolling_sharpe").alias("k_sharpe"),
        F.stddev_samp("rolling_sharpe").alias("rolling_sharpe_std"),
        F.avg("rolling_sharpe").alias("rolling_sharpe_mean"),
        F.avg("rolling_cagr").alias("rolling_cagr_mean"),
        F.count("rolling_maxdd").alias("k_mdd"),
        F.stddev_samp("rolling_maxdd").alias("mdd_std"),
        F.min("rolling_maxdd").alias("rolling_maxdd_worst"),
    )
    out = days.join(roll, "portfolio", "left").join(regime_sharpe(curve).drop("n_days"), "portfolio", "left")
    none = F.lit(None).cast("double")
    if turnovers is not None:
        t = turnovers.where(F.col("seq") > 1).groupBy("portfolio").agg((F.avg("turnover") / 2).alias("avg_turnover"))
        out = out.join(t, "portfolio", "left")
    else:
        out = out.withColumn("avg_turnover", none)
    if correlations is not None:
        order = Window.partitionBy("portfolio").orderBy("seq")
        c = (
            correlations.where(F.col("avg_pairwise_corr").isNotNull())
            .withColumn("d", F.abs(F.col("avg_pairwise_corr") - F.lag("avg_pairwise_corr").over(order)))
            .groupBy("portfolio")
            .agg(F.count(F.lit(1)).alias("k"), F.avg("d").alias("d"))
            .select("portfolio", F.when(F.col("k") >= 3, F.col("d")).alias("avg_corr_drift"))
        )
        out = out.join(c, "portfolio", "left")
    else:
        out = out.withColumn("avg_corr_drift", none)

    def part(ok: Column, raw: str, bad: float) -> Column:
        return F.when(ok, linear_score(raw, bad)).otherwise(F.lit(50.0))

    out = (
        out.withColumn("sharpe_consistency", part(F.col("k_sharpe") >= 3, "rolling_sharpe_std", 2.0))
        .withColumn("drawdown_stability", part(F.col("k_mdd") >= 3, "mdd_std", 0.20))
        .withColumn("turnover_penalty", part(F.col("avg_turnover").isNotNull(), "avg_turnover", 1.0))
        .withColumn("correlation_stability", part(F.col("avg_corr_drift").isNotNull(), "avg_corr_drift", 0.30))
        .withColumn("regime_robustness", F.coalesce("regime_score", F.lit(50.0)))
    )
    w = STABILITY_WEIGHTS
    score = clip(
        w["sharpe"] * F.col("sharpe_consistency")
        + w["drawdown"] * F.col("drawdown_stability")
        + w["turnover"] * F.col("turnover_penalty")
        + w["correlation"] * F.col("correlation_stability")
        + w["regime"] * F.col("regime_robustness"),
        0,
        100,
    )
    short = F.col("n_days") < MIN_DAYS
    return out.withColumn("_s", score).select(
        "portfolio",
        "n_days",
        F.when(short, F.lit(0.0)).otherwise(F.col("_s")).alias("stability_score"),
        F.when(short, F.lit("N/A")).otherwise(ladder("_s", STABILITY_GRADES, "F")).alias("grade"),
        F.when(short, F.lit("insufficient"))
        .when(F.col("n_days") < FULL_WINDOW, F.lit("limited"))
        .otherwise(F.lit("sufficient"))
        .alias("data_sufficiency"),
        *[
            F.when(~short, rounded(c, 6)).alias(c)
            for c in ("sharpe_consistency", "drawdown_stability", "turnover_penalty", "correlation_stability", "regime_robustness")
        ],
        "rolling_sharpe_mean",
        "rolling_sharpe_std",
        "rolling_cagr_mean",
        "rolling_maxdd_worst",
        "avg_turnover",
        "avg_corr_drift",
        "regime_sharpe_high",
        "regime_sharpe_low",
        "regime_sharpe_gap",
    )


def portfolio_responsiveness(curve: DataFrame, market: DataFrame) -> DataFrame:
    """Responsiveness of each portfolio against a market series.

    market(date, market_return), e.g. the mean of all portfolios. Curves below
    126 rows score 50.
    """
    part = Window.partitionBy("portfolio")
    order = part.orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last60 = order.rowsBetween(-59, 0)
    rows = (
        curve.select("portfolio", "date", "daily_return")
        .join(F.broadcast(market), "date", "left")
        .withColumn("m", F.coalesce("market_return", F.lit(0.0)))
        .withColumn("row", F.row_number().over(order) - 1)
        .withColumn("n", F.count(F.lit(1)).over(part))
        .withColumn("eq", F.product(1 + F.col("daily_return")).over(upto))
        .withColumn("p", F.when(F.col("row") == 0, F.lit(0.0)).otherwise(F.col("daily_return")))
        .withColumn("vol30", F.when(F.col("row") >= 29, F.round(F.stddev_samp("m").over(order.rowsBetween(-29, 0)), 12)))
        .withColumn("hi", F.coalesce(F.col("vol30") > F.percentile("vol30", F.lit(0.75)).over(part), F.lit(False)))
        .withColumn("onset", F.col("hi") & ~F.coalesce(F.lag("hi").over(order), F.lit(True)))
        .withColumn("next10", F.collect_list("eq").over(order.rowsBetween(0, 9)))
        .withColumn(
            "beta",
            F.coalesce(
                F.when(F.col("row") >= 59, F.try_divide(F.covar_samp("p", "m").over(last60), F.var_samp("m").over(last60))),
                F.lit(1.0),
            ),
        )
    )
    hi = F.col("hi")

    def ratio(mask: Column) -> Column:
        v = F.when(mask, F.col("p"))
        return F.coalesce(F.try_divide(F.avg(v), F.stddev_samp(v)), F.lit(0.0))

    out = rows.groupBy("portfolio").agg(
        F.max("n").alias("n"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("onset"), F.struct("row", deepest_drawdown("next10").alias("d"))))
        ).alias("by_row"),
        spike_starts(F.collect_list(F.when(F.col("onset"), F.col("row")))).alias("starts"),
        F.count(F.when(hi, 1)).alias("n_hi"),
        F.count(F.when(~hi, 1)).alias("n_no"),
        F.avg(F.when(~hi, F.col("beta"))).alias("b_no"),
        F.avg(F.when(hi, F.col("beta"))).alias("b_hi"),
        ratio(~hi).alias("s_no"),
        ratio(hi).alias("s_hi"),
    )
    total = F.aggregate(F.transform("starts", lambda s: F.element_at("by_row", s)), F.lit(0.0), lambda a, x: a + x)
    dd = F.coalesce(F.try_divide(total, F.size("starts")), F.lit(0.0))
    enough = (F.col("n_hi") > 5) & (F.col("n_no") > 5)
    comp = F.when(enough, F.col("b_no") - F.col("b_hi")).otherwise(F.lit(0.0))
    stab = F.when(F.col("s_no") > 0, F.col("s_hi") / F.col("s_no")).otherwise(F.lit(0.0))
    few = F.col("n") < 126
    none = F.lit(None).cast("double")
    return (
        out.withColumn("containment", clip(1 + dd / 0.10, 0, 1))
        .withColumn("beta_compression", clip(0.5 + comp, 0, 1))
        .withColumn("sharpe_stability", clip(stab, 0, 1))
        .select(
            "portfolio",
            F.when(few, F.lit(50.0))
            .otherwise(
                100 * (0.4 * F.col("containment") + 0.3 * F.col("beta_compression") + 0.3 * F.col("sharpe_stability"))
            )
            .alias("rrc_score"),
            *[F.when(few, none).otherwise(F.col(c)).alias(c) for c in ("containment", "beta_compression", "sharpe_stability")],
        )
    )


def mean_of_portfolios(curve: DataFrame) -> DataFrame:
    return curve.groupBy("date").agg(F.avg("daily_return").alias("market_return"))
