"""Monthly walk-forward backtest for many portfolios in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions.exprs import SQRT_YEAR, TRADING_DAYS, clip, flags, ratio

COST_RATE = 0.002
VOL_TARGET_WINDOW = 20
LEVERAGE_MIN = 0.5
LEVERAGE_MAX = 1.5


def period_returns(weights: DataFrame, periods: DataFrame, panel: DataFrame) -> DataFrame:
    """Daily portfolio return inside each holding period.

    weights(portfolio, reb_no, stock_id, weight); periods(portfolio?, reb_no, reb_idx, end_idx).
    The weights (top-n names per date) are repeated for the days of their period
    and joined to the panel on (stock, day), which also spreads a stock that
    every portfolio holds. Weights are rescaled over the stocks that have a price
    in the period: the panel carries closes forward, so those are the stocks with
    a row on the period's last day, and one pass over the panel gives both sums.
    """
    on = ["portfolio", "reb_no"] if "portfolio" in periods.columns else ["reb_no"]
    days = weights.join(periods.select(*on, "reb_idx", "end_idx"), on).select(
        "portfolio",
        "reb_no",
        "stock_id",
        "weight",
        "reb_idx",
        "end_idx",
        F.explode(F.sequence("reb_idx", "end_idx")).alias("idx"),
    )
    held = days.join(panel.select("stock_id", "idx", "date", "ret"), ["stock_id", "idx"])
    daily = held.groupBy("portfolio", "reb_no", "reb_idx", "end_idx", "idx", "date").agg(
        F.sum(F.col("weight") * F.col("ret")).alias("wr"),
        F.sum("weight").alias("w"),
        F.count("ret").alias("k"),
    )
    total = F.max(F.when(F.col("idx") == F.col("end_idx"), F.col("w"))).over(Window.partitionBy("portfolio", "reb_no"))
    scale = F.when(F.col("total") > 0, F.col("wr") / F.col("total")).otherwise(F.col("wr"))
    return (
        daily.withColumn("total", total)
        .where((F.col("idx") > F.col("reb_idx")) & (F.col("k") > 0))
        .select("portfolio", "reb_no", "idx", "date", scale.alias("daily_return"))
    )


def turnover(weights: DataFrame, used: DataFrame) -> DataFrame:
    """Sum of absolute weight changes against the previous used rebalance (first: against nothing).

    used(portfolio, reb_no): rebalances whose period produced returns; skipped
    ones do not update the previous weights.
    """
    seq = F.row_number().over(Window.partitionBy("portfolio").orderBy("reb_no"))
    numbered = used.select("portfolio", "reb_no").distinct().withColumn("seq", seq)
    w = weights.join(numbered, ["portfolio", "reb_no"]).select("portfolio", "seq", "stock_id", "weight")
    gone = w.select("portfolio", (F.col("seq") + 1).alias("seq"), "stock_id", (-F.col("weight")).alias("weight"))
    change = (
        w.unionByName(gone).groupBy("portfolio", "seq", "stock_id").agg(F.sum("weight").alias("change"))
    )
    return (
        change.groupBy("portfolio", "seq")
        .agg(F.sum(F.abs("change")).alias("turnover"))
        .join(numbered, ["portfolio", "seq"])
        .select("portfolio", "reb_no", "seq", "turnover")
    )


def charge_costs(returns: DataFrame, costs: DataFrame, rate: float = COST_RATE) -> DataFrame:
    """Subtract the transaction cost from the first return of each period."""
    first = F.row_number().over(Window.partitionBy("portfolio", "reb_no").orderBy("idx")) == 1
    return (
        returns.withColumn("_first", first)
        .join(costs.select("portfolio", "reb_no", "turnover"), ["portfolio", "reb_no"], "left")
        .withColumn(
            "daily_return",
            F.when(F.col("_first"), F.col("daily_return") - F.lit(rate) * F.coalesce("turnover", F.lit(0.0))).otherwise(
                F.col("daily_return")
            ),
        )
        .drop("_first", "turnover")
    )


def latest_period_wins(returns: DataFrame) -> DataFrame:
    """Where periods overlap on a date, keep the later rebalance."""
    order = Window.partitionBy("portfolio", "date").orderBy(F.desc("reb_no"))
    return returns.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def volatility_target(returns: DataFrame, targets: DataFrame) -> DataFrame:
    """Scale returns to a target volatility with the lagged 20-day deviation.

    targets(portfolio, target_vol): null or non-positive means no scaling.
    """
    past = Window.partitionBy("portfolio").orderBy("idx").rowsBetween(-VOL_TARGET_WINDOW, -1)
    vol = F.stddev_samp("daily_return").over(past) * F.lit(SQRT_YEAR)
    lever = F.when(F.col("_vol") > 0, F.col("target_vol") / F.col("_vol")).otherwise(F.lit(1.0))
    scaled = F.when(
        F.col("target_vol") > 0, clip(lever, LEVERAGE_MIN, LEVERAGE_MAX) * F.col("daily_return")
    ).otherwise(F.col("daily_return"))
    return (
        returns.withColumn("_vol", vol)
        .join(targets, "portfolio", "left")
        .withColumn("daily_return", scaled)
        .drop("_vol", "target_vol")
    )


def equity_curve(returns: DataFrame, keys: tuple[str, ...] = ("portfolio",)) -> DataFrame:
    """Cumulative return and drawdown; the peak starts at the first value, not at 1."""
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cum = returns.withColumn("_c", F.product(1 + F.col("daily_return")).over(upto))
    peak = cum.withColumn("_m", F.max("_c").over(upto))
    return peak.select(
        *[c for c in returns.columns],
        (F.col("_c") - 1).alias("cumulative_return"),
        ((F.col("_c") - F.col("_m")) / F.col("_m")).alias("drawdown"),
    )


def backtest(
    weights: DataFrame,
    periods: DataFrame,
    panel: DataFrame,
    targets: DataFrame | None = None,
    cut: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Equity curves of all portfolios: period returns, costs, optional volatility target, curve.

    ``cut`` may write the weights and the period returns (one row per portfolio
    and day) to a staged table, so that the panel is joined once.
    """
    weights = cut(weights) if cut else weights
    raw = period_returns(weights, periods, panel)
    raw = cut(raw) if cut else raw
    costs = turnover(weights, raw)
    net = latest_period_wins(charge_costs(raw, costs))
    if targets is not None:
        net = volatility_target(net, targets)
    return equity_curve(net)


def summary(curve: DataFrame, keys: tuple[str, ...] = ("portfolio",), *, population: bool = False) -> DataFrame:
    """Return, CAGR, volatility, Sharpe, drawdown and win rate per portfolio.

    ``population`` selects the ddof=0 deviation used by the hybrid and derived
    paths. The win rate is the share of months with a positive compounded return.
    """
    std = F.stddev_pop if population else F.stddev_samp
    monthly = (
        curve.groupBy(*keys, F.trunc("date", "MM").alias("month"))
        .agg(F.product(1 + F.col("daily_return")).alias("g"))
        .groupBy(*keys)
        .agg(F.avg((F.col("g") - 1 > 0).cast("double")).alias("win_rate"))
    )
    base = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.product(1 + F.col("daily_return")) - 1).alias("total_return"),
        F.avg("daily_return").alias("_mean"),
        F.coalesce(std("daily_return") * F.lit(SQRT_YEAR), F.lit(0.0)).alias("volatility"),
        F.min("drawdown").alias("max_drawdown"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.sqrt(F.avg(F.pow(F.least("daily_return", F.lit(0.0)), F.lit(2.0)))).alias("_down"),
    )
    annual = F.col("_mean") * TRADING_DAYS
    cagr = F.pow(1 + F.col("total_return"), F.lit(float(TRADING_DAYS)) / F.col("n_days")) - 1
    return (
        base.withColumn("cagr", cagr)
        .withColumn("sharpe", F.when(F.col("volatility") > 0, annual / F.col("volatility")).otherwise(F.lit(0.0)))
        .withColumn("sortino", ratio(annual, F.col("_down") * F.lit(SQRT_YEAR), 0.0))
        .withColumn(
            "calmar",
            F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(F.lit(float("inf"))),
        )
        .join(monthly, list(keys))
        .select(
            *keys,
            "start_date",
            "end_date",
            "n_days",
            "total_return",
            "cagr",
            "volatility",
            "sharpe",
            "sortino",
            "calmar",
            "max_drawdown",
            "win_rate",
        )
    )


def sanity_warnings(metrics: DataFrame) -> DataFrame:
    """Flags for short histories and numbers too good to be true."""
    return metrics.withColumn(
        "warnings",
        flags(
            (F.col("n_days") / TRADING_DAYS < 1, "duration_lt_1y"),
            (F.col("sharpe") > 3, "sharpe_unrealistic"),
            (F.abs("max_drawdown") < 0.05, "maxdd_unrealistic"),
        ),
    )


def average_pairwise_correlation(weights: DataFrame, curve: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean correlation over all pairs of ever-held stocks (pairwise-complete), 0.5 below two stocks.

    No pairs are formed. For stocks that share the first usable day, the sum of
    all pair correlations follows from the daily sum of their standardised
    returns: sum over i<j of z_i*z_j = ((sum z)^2 - sum z^2) / 2. Stocks are
    grouped by first usable day; a pair is counted in the class of its later
    stock, over that class's days.
    """
    span = curve.groupBy("portfolio").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    held = weights.select("portfolio", "stock_id").distinct().join(span, "portfolio")
    first = panel.groupBy("stock_id").agg(F.min("idx").alias("first_idx"))
    usable = held.join(first, "stock_id").withColumn("v", F.greatest(F.col("lo"), F.col("first_idx")) + 1)
    classes = usable.select("portfolio", F.col("v").alias("c")).distinct()
    rows = (
        usable.join(classes, "portfolio")
        .where(F.col("v") <= F.col("c"))
        .join(panel.select("stock_id", "idx", "ret"), "stock_id")
        .where((F.col("idx") >= F.col("c")) & (F.col("idx") <= F.col("hi")) & F.col("ret").isNotNull())
    )
    stats = rows.groupBy("portfolio", "c", "stock_id").agg(
        F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count("ret").alias("n")
    )
    z = rows.join(stats, ["portfolio", "c", "stock_id"]).withColumn(
        "z", F.try_divide(F.col("ret") - F.col("m"), F.col("s"))
    )
    own = F.col("v") == F.col("c")
    daily = z.groupBy("portfolio", "c", "idx").agg(
        F.sum(F.when(own, F.col("z")).otherwise(F.lit(0.0))).alias("zb"),
        F.sum("z").alias("za"),
        F.sum(F.when(own, F.col("z") * F.col("z")).otherwise(F.lit(0.0))).alias("zz"),
        F.max("n").alias("n"),
    )
    per_class = daily.groupBy("portfolio", "c").agg(
        (
            F.sum(
                F.col("zb") * (F.col("za") - F.col("zb")) + (F.col("zb") * F.col("zb") - F.col("zz")) / 2
            )
            / (F.max("n") - 1)
        ).alias("corr_sum")
    )
    count = held.groupBy("portfolio").agg(F.count(F.lit(1)).alias("m"))
    pairs = F.col("m") * (F.col("m") - 1) / 2
    return (
        per_class.groupBy("portfolio")
        .agg(F.sum("corr_sum").alias("corr_sum"))
        .join(count, "portfolio")
        .select(
            "portfolio",
            F.when(F.col("m") > 1, F.col("corr_sum") / pairs).otherwise(F.lit(0.5)).alias("avg_pairwise_corr"),
        )
    )
