"""Rebalance calendar and portfolio weights for all rebalance dates at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions.asof import asof_dates
from quantfold.tables import bounded

VOL_OFFSET = 2.0
EQUAL_WEIGHT = ("equal_weight", "equal_weight_top_n")
INVERSE_VOL = "inverse_volatility"


def month_ends(calendar: DataFrame) -> DataFrame:
    """Last trading date of each calendar month."""
    return calendar.groupBy(F.trunc("date", "MM").alias("month")).agg(
        F.max("date").alias("reb_date"), F.max("idx").alias("reb_idx")
    )


def rebalance_calendar(calendar: DataFrame, score_dates: DataFrame) -> DataFrame:
    """Month ends with their latest score date on or before, the period end and a running number.

    The last period runs to the last price date.
    """
    found = asof_dates(month_ends(calendar), score_dates, "reb_date", "date", "score_date", "backward").where(
        F.col("score_date").isNotNull()
    )
    order = Window.partitionBy(F.lit(0)).orderBy("reb_date")
    end = calendar.agg(F.max("idx").alias("last_idx"), F.max("date").alias("last_date"))
    return found.join(bounded(end)).select(
        F.row_number().over(order).alias("reb_no"),
        "reb_date",
        "reb_idx",
        "score_date",
        F.coalesce(F.lead("reb_date").over(order), F.col("last_date")).alias("end_date"),
        F.coalesce(F.lead("reb_idx").over(order), F.col("last_idx")).alias("end_idx"),
    )


def candidates(scored: DataFrame, rebalances: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Ranked stocks on each rebalance date's score date, optionally per portfolio membership."""
    dates = rebalances.select("reb_no", "reb_date", F.col("score_date").alias("date"))
    snap = scored.join(bounded(dates), "date").select(
        "reb_no", "reb_date", "stock_id", "rank", "composite_score", "volatility_score"
    )
    return snap if members is None else snap.join(members.select("portfolio", "stock_id"), "stock_id")


def _share(value: Column, keys: list[str]) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*keys))


def top_ranked(cands: DataFrame, keys: list[str], top_n: Column | int) -> DataFrame:
    """First ``top_n`` rows per key by rank, ties by stock id."""
    n = F.lit(top_n) if isinstance(top_n, int) else top_n
    order = Window.partitionBy(*keys).orderBy("rank", "stock_id")
    return cands.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def strategy_weights(
    cands: DataFrame, specs: DataFrame | Sequence[tuple[str, str, int]], *, null_vol_as_zero: bool = False
) -> DataFrame:
    """Equal and inverse-volatility weights of the top names per portfolio and rebalance date.

    cands(portfolio?, reb_no, reb_date, stock_id, rank, volatility_score);
    specs(portfolio, strategy, top_n): a table joined on the portfolio, or, when the
    candidates have no portfolio column, parameter rows that all share them. Parameter rows
    bound the names per date, so Spark cuts each map task's output before the shuffle.
    """
    if "portfolio" in cands.columns:
        wide = cands.join(specs, "portfolio")
        keys = ["portfolio", "reb_no", "reb_date"]
        top = top_ranked(wide, keys, F.col("top_n"))
    else:
        shared = top_ranked(cands, ["reb_no", "reb_date"], max((n for _, _, n in specs), default=0))
        rows = F.array(
            *[F.struct(F.lit(p).alias("portfolio"), F.lit(s).alias("strategy"), F.lit(n).alias("top_n")) for p, s, n in specs]
        )
        top = (
            shared.withColumn("_s", F.explode(rows))
            .select(*shared.columns, "_s.*")
            .where(F.col("position") <= F.col("top_n"))
        )
        keys = ["portfolio", "reb_no", "reb_date"]
    vol = F.coalesce("volatility_score", F.lit(0.0)) if null_vol_as_zero else F.col("volatility_score")
    inverse = F.lit(1.0) / F.greatest(vol + F.lit(VOL_OFFSET), F.lit(1e-8))
    raw = F.when(F.col("strategy").isin(*EQUAL_WEIGHT), F.lit(1.0)).when(F.col("strategy") == INVERSE_VOL, inverse)
    return (
        top.withColumn("_raw", raw)
        .where(F.col("_raw").isNotNull())
        .withColumn("weight", _share(F.col("_raw"), keys))
        .select(*keys, "stock_id", "weight")
    )


def custom_weights(cands: DataFrame, custom: DataFrame) -> DataFrame:
    """User weights by stock, kept for stocks that are ranked that day and rescaled to one.

    custom(portfolio, stock_id, custom_weight). A total of zero or less is left as it is.
    """
    keys = ["portfolio", "reb_no", "reb_date"]
    held = cands.select("reb_no", "reb_date", "stock_id").join(custom, "stock_id")
    total = held.groupBy(*keys).agg(F.sum("custom_weight").alias("_t"))
    return held.join(total, keys).select(
        *keys,
        "stock_id",
        F.when(F.col("_t") > 0, F.col("custom_weight") / F.col("_t")).otherwise(F.col("custom_weight")).alias("weight"),
    )


def allocation_checks(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Sum, extremes and count of the weights of each stored portfolio."""
    return weights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_stocks"),
        F.sum("weight").alias("weight_sum"),
        F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"),
    )


def allocation_view(weights: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Weights with symbol, name, sector and score for display."""
    return weights.join(
        snapshot.select("stock_id", "symbol", "name", "sector", "composite_score", "rank"), "stock_id", "left"
    )
