"""Walk-forward windows, weight sensitivity and single-factor tests as parameter rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfold.operators import backtest as bt
from quantfold.operators import factors as fac
from quantfold.operators import portfolio as pf
from quantfold.tables import bounded

TRAIN_FRACTION = 0.6
TRAIN_MONTHS, TEST_MONTHS, STEP_MONTHS = 36, 12, 12
MIN_DATES = 4
MOMENTUM_STEPS = 5


def split_windows(rebalances: DataFrame) -> DataFrame:
    """First 60% of the rebalance dates for training, the rest for testing: (window_id, part, lo_no, hi_no)."""
    n = rebalances.agg(F.max("reb_no").alias("n")).where(F.col("n") >= MIN_DATES)
    at = F.greatest(F.lit(1), F.floor(F.col("n") * TRAIN_FRACTION)).cast("int")
    parts = F.array(
        F.struct(F.lit("train").alias("part"), F.lit(1).alias("lo_no"), at.alias("hi_no")),
        F.struct(F.lit("test").alias("part"), (at + 1).alias("lo_no"), F.col("n").alias("hi_no")),
    )
    return n.select(F.lit(0).alias("window_id"), F.explode(parts).alias("p")).select("window_id", "p.*")


def rolling_windows(rebalances: DataFrame) -> DataFrame:
    """36 training and 12 test dates, moved by 12 dates."""
    size = TRAIN_MONTHS + TEST_MONTHS
    n = rebalances.agg(F.max("reb_no").alias("n")).where(F.col("n") >= size)
    starts = n.select(F.explode(F.sequence(F.lit(0), F.col("n") - size, F.lit(STEP_MONTHS))).alias("s"))
    parts = F.array(
        F.struct(F.lit("train").alias("part"), (F.col("s") + 1).alias("lo_no"), (F.col("s") + TRAIN_MONTHS).alias("hi_no")),
        F.struct(F.lit("test").alias("part"), (F.col("s") + TRAIN_MONTHS + 1).alias("lo_no"), (F.col("s") + size).alias("hi_no")),
    )
    return starts.select((F.col("s") / STEP_MONTHS).cast("int").alias("window_id"), F.explode(parts).alias("p")).select(
        "window_id", "p.*"
    )


def window_periods(windows: DataFrame, rebalances: DataFrame, last_idx: int) -> DataFrame:
    """Holding periods of each window part; the last one runs to the last price date, as in a plain backtest."""
    named = windows.withColumn("portfolio", F.concat_ws(":", "window_id", "part"))
    return rebalances.join(bounded(named), F.col("reb_no").between(F.col("lo_no"), F.col("hi_no"))).select(
        "portfolio",
        "window_id",
        "part",
        "reb_no",
        "reb_date",
        "reb_idx",
        F.when(F.col("reb_no") == F.col("hi_no"), F.lit(last_idx)).otherwise(F.col("end_idx")).alias("end_idx"),
    )


def walk_forward(weights: DataFrame, periods: DataFrame, panel: DataFrame, cut) -> DataFrame:
    """Train and test CAGR, Sharpe and drawdown of one strategy per window.

    weights(reb_no, stock_id, weight) of the strategy are shared by all windows.
    """
    w = weights.select("reb_no", "stock_id", "weight").join(bounded(periods.select("portfolio", "reb_no")), "reb_no")
    p = periods.select("portfolio", "reb_no", "reb_idx", "end_idx")
    s = bt.summary(cut(bt.backtest(w.select("portfolio", "reb_no", "stock_id", "weight"), p, panel, cut=cut)))
    spans = periods.groupBy("portfolio", "window_id", "part").agg(
        F.min("reb_date").alias("d0"), F.max("reb_date").alias("d1")
    )
    j = s.join(spans, "portfolio")
    cols = [
        F.max(F.when(F.col("part") == part, F.col(c))).alias(f"{part}_{name}")
        for part in ("train", "test")
        for c, name in (("cagr", "cagr"), ("sharpe", "sharpe"), ("max_drawdown", "maxdd"))
    ]
    return j.groupBy("window_id").agg(F.min("d0").alias("window_start"), F.max("d1").alias("window_end"), *cols)


def sensitivity_weightings() -> list[tuple[str, float, float, float, float]]:
    """Momentum weight from 0.15 to 0.35 in six steps, the other weights rescaled: (name, quality, growth, momentum, value)."""
    base = fac.FACTOR_WEIGHTS
    other = base["quality"] + base["growth"] + base["value"]
    rows = []
    for s in range(MOMENTUM_STEPS + 1):
        mom = 0.15 + 0.20 * s / MOMENTUM_STEPS
        k = (1.0 - mom) / other
        rows.append((f"{mom:.3f}", base["quality"] * k, base["growth"] * k, mom, base["value"] * k))
    return rows


def single_factor_weightings() -> list[tuple[str, float, float, float, float]]:
    names = ("momentum", "quality", "value", "growth")
    return [(n, float(n == "quality"), float(n == "growth"), float(n == "momentum"), float(n == "value")) for n in names]


def weighting_backtests(
    factors: DataFrame, weightings: Sequence[tuple], rebalances: DataFrame, panel: DataFrame, cut, top_n: int = 20
) -> DataFrame:
    """Equal-weight backtest summary per weighting; only the score dates in use are re-ranked."""
    dates = rebalances.select(F.col("score_date").alias("date")).distinct()
    ranked = fac.weighted_scores(factors.join(bounded(dates), "date", "left_semi"), weightings)
    on = rebalances.select("reb_no", "reb_date", F.col("score_date").alias("date"))
    cands = ranked.join(bounded(on), "date")
    top = pf.top_ranked(cands, ["weighting", "reb_no"], top_n)
    n = F.count(F.lit(1)).over(pf.Window.partitionBy("weighting", "reb_no"))
    w = cut(top.select(F.col("weighting").alias("portfolio"), "reb_no", "stock_id", (1.0 / n).alias("weight")))
    return bt.summary(cut(bt.backtest(w, rebalances, panel, cut=cut))).withColumnRenamed("portfolio", "weighting")


def report_flags(walk: DataFrame, sens: DataFrame, single: DataFrame, full: DataFrame, regime: DataFrame) -> DataFrame:
    """One row per section of the validation report: (section, value, flagged)."""
    gap = walk.agg(
        F.lit("overfitting_gap").alias("section"), (F.avg("train_sharpe") - F.avg("test_sharpe")).alias("value")
    ).withColumn("flagged", F.col("value") > 1.0)
    spread = sens.agg(F.lit("sensitivity_std").alias("section"), F.stddev_samp("sharpe").alias("value")).withColumn(
        "flagged", F.col("value") > 0.5
    )
    both = single.agg(F.max("sharpe").alias("b")).join(bounded(full.agg(F.max("sharpe").alias("f"))))
    share = F.when((F.col("f") > 0) & (F.col("b") > 0), F.col("b") / F.col("f"))
    dominance = both.select(
        F.lit("single_factor_share").alias("section"), share.alias("value"), F.coalesce(share >= 0.8, F.lit(False)).alias("flagged")
    )
    diff = regime.agg(F.lit("regime_difference").alias("section"), F.max("regime_difference").alias("value")).withColumn(
        "flagged", F.col("value") > 0.2
    )
    return gap.unionByName(spread).unionByName(dominance).unionByName(diff)
