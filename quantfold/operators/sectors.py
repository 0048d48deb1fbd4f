"""Sector maps, performance, exposure and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions.exprs import SQRT_YEAR, TRADING_DAYS
from quantfold.operators.backtest import equity_curve

MIN_DAYS = 5
UNCLASSIFIED = "Unclassified"


def sector_map(stocks: DataFrame) -> DataFrame:
    return stocks.where(F.col("sector").isNotNull() & (F.col("sector") != "")).select("stock_id", "symbol", "sector")


def stocks_by_sector(stocks: DataFrame) -> DataFrame:
    """Members of each sector, one row per stock (counts ride along), ordered by symbol inside the sector."""
    w = Window.partitionBy("sector").orderBy("symbol", "stock_id")
    return sector_map(stocks).withColumn("position", F.row_number().over(w))


def sector_performance(
    panel: DataFrame, stocks: DataFrame, start: Column, end: Column, day_scores: DataFrame | None = None
) -> DataFrame:
    """Equal-weight daily sector return over [start, end] with CAGR, Sharpe, drawdown and average score.

    The first row of each stock inside the range has no return. Sectors with
    fewer than five return days are dropped.
    """
    members = sector_map(stocks)
    rows = panel.where((F.col("date") >= start) & (F.col("date") <= end)).join(members, "stock_id")
    first = panel.where((F.col("date") >= start) & (F.col("date") <= end)).agg(F.min("idx").alias("first_idx"))
    inside = rows.join(F.broadcast(first)).withColumn("r", F.when(F.col("idx") > F.col("first_idx"), F.col("ret")))
    daily = (
        inside.where(F.col("r").isNotNull()).groupBy("sector", "date").agg(F.avg("r").alias("daily_return"))
    )
    curve = equity_curve(daily, ("sector",))
    perf = curve.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.product(1 + F.col("daily_return")).alias("growth"),
        F.avg("daily_return").alias("mean"),
        (F.stddev_pop("daily_return") * F.lit(SQRT_YEAR)).alias("volatility"),
        F.min("drawdown").alias("max_drawdown"),
    )
    present = rows.groupBy("stock_id", "sector").agg(F.count(F.lit(1)).alias("_k"))
    if day_scores is not None:
        present = present.join(
            day_scores.select("stock_id", F.coalesce("composite_score", F.lit(0.0)).alias("_score")), "stock_id", "left"
        )
    else:
        present = present.withColumn("_score", F.lit(None).cast("double"))
    counts = present.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n_stocks"), F.coalesce(F.avg("_score"), F.lit(0.0)).alias("avg_score")
    )
    return (
        perf.where(F.col("n_days") >= MIN_DAYS)
        .join(counts, "sector")
        .select(
            "sector",
            "n_stocks",
            (F.pow("growth", F.lit(float(TRADING_DAYS)) / F.col("n_days")) - 1).alias("cagr"),
            F.when(F.col("volatility") > 0, F.col("mean") * TRADING_DAYS / F.col("volatility"))
            .otherwise(F.lit(0.0))
            .alias("sharpe"),
            "max_drawdown",
            "volatility",
            "avg_score",
        )
    )


def sector_exposure(weights: DataFrame, stocks: DataFrame, keys: list[str]) -> DataFrame:
    """Weight, count and share per sector of each portfolio; unknown sectors come last as Unclassified."""
    tagged = weights.join(stocks.select("stock_id", "sector"), "stock_id", "left").withColumn(
        "sector", F.coalesce(F.when(F.col("sector") != "", F.col("sector")), F.lit(UNCLASSIFIED))
    )
    per = tagged.groupBy(*keys, "sector").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_stocks"))
    part = Window.partitionBy(*keys)
    total = F.sum("weight").over(part)
    order = part.orderBy((F.col("sector") == UNCLASSIFIED).cast("int"), F.desc("weight"), "sector")
    return per.withColumn("_t", total).select(
        *keys,
        "sector",
        "weight",
        "n_stocks",
        F.when(F.col("_t") > 0, F.col("weight") / F.col("_t") * 100).otherwise(F.lit(0.0)).alias("pct"),
        F.row_number().over(order).alias("position"),
    )


def sector_rankings(perf: DataFrame, snapshot: DataFrame, top_sectors: int = 10, per_sector: int = 3) -> DataFrame:
    """Sectors by CAGR with the best-ranked stocks of each."""
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("cagr"), "sector")
    best = perf.withColumn("sector_rank", F.row_number().over(place)).where(F.col("sector_rank") <= top_sectors)
    inside = Window.partitionBy("sector").orderBy("rank", "stock_id")
    names = (
        snapshot.withColumn("_k", F.row_number().over(inside))
        .where(F.col("_k") <= per_sector)
        .select("sector", F.col("_k").alias("position"), "symbol", "rank", F.col("composite_score").alias("score"))
    )
    return best.join(names, "sector", "left")
