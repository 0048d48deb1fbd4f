"""Answers of the read API as tables for the whole universe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfold.tables import bounded


def price_movement(panel: DataFrame, calendar: DataFrame, stocks: DataFrame, days: int) -> DataFrame:
    """First, last, highest and lowest close and percentage change over the last ``days`` calendar days."""
    end = calendar.agg(F.date_sub(F.max("date"), days).alias("start_date"))
    recent = panel.join(bounded(end), F.col("date") >= F.col("start_date"))
    return (
        recent.groupBy("stock_id")
        .agg(
            F.min_by("close", "idx").alias("start_price"),
            F.max_by("close", "idx").alias("end_price"),
            F.max("close").alias("high"),
            F.min("close").alias("low"),
        )
        .withColumn("pct_change", (F.col("end_price") / F.col("start_price") - 1) * 100)
        .join(stocks.select("stock_id", "symbol"), "stock_id")
        .select("symbol", "start_price", "end_price", "pct_change", "high", "low")
    )


def stock_summary(signals: DataFrame, stocks: DataFrame, factors: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Scores in percent, latest factors (falling back to the last day with quality data) and fundamentals."""
    three = ["quality_score", "value_score", "growth_score"]
    newest = factors.groupBy("stock_id").agg(
        F.max_by(F.struct(*three), "date").alias("now"),
        F.max_by(F.struct(*three), F.when(F.col("quality_score") > 0, F.col("date"))).alias("back"),
        F.max(F.when(F.col("quality_score") > 0, F.col("date"))).alias("back_date"),
    )
    blank = (F.col("now.quality_score") == 0) & (F.col("now.value_score") == 0) & (F.col("now.growth_score") == 0)
    picked = newest.select(
        "stock_id",
        *[
            (
                F.when(~blank, F.col(f"now.{c}")).when(F.col("back_date").isNotNull(), F.col(f"back.{c}")) * 100
            ).alias(c.removesuffix("_score"))
            for c in three
        ],
    )
    last = (
        fundamentals.groupBy("stock_id")
        .agg(F.max("quarter").alias("period"), F.max_by(F.struct("revenue", "net_income", "eps", "roe"), "quarter").alias("f"))
        .select("stock_id", "period", "f.revenue", "f.net_income", "f.eps", (F.col("f.roe") * 100).alias("roe"))
    )
    return (
        signals.join(stocks.select("stock_id", "symbol"), "stock_id")
        .join(picked, "stock_id", "left")
        .join(last, "stock_id", "left")
        .select(
            "symbol",
            (F.col("composite_score") * 100).alias("composite_score"),
            "rank",
            (F.coalesce("momentum_score", F.lit(0.0)) * 100).alias("momentum"),
            (F.coalesce("volatility_score", F.lit(0.0)) * 100).alias("volatility"),
            "quality",
            "value",
            "growth",
            "period",
            "revenue",
            "net_income",
            "eps",
            "roe",
            F.col("regime").alias("current_regime"),
            "trend_direction",
            "recommendation",
        )
    )


def portfolio_review(members: DataFrame, signals: DataFrame, stocks: DataFrame) -> DataFrame:
    """Signal of each member stock of each saved portfolio."""
    return (
        members.join(signals, "stock_id")
        .join(stocks.select("stock_id", "symbol"), "stock_id")
        .select(
            "portfolio",
            "symbol",
            (F.col("composite_score") * 100).alias("score"),
            "recommendation",
            "rank",
        )
    )


def recommendation_counts(review: DataFrame) -> DataFrame:
    """Buy, Hold and Reduce counts per portfolio."""
    return review.groupBy("portfolio").agg(
        *[
            F.count(F.when(F.col("recommendation") == label, 1)).alias(label.lower())
            for label in ("Buy", "Hold", "Reduce")
        ],
        F.count(F.lit(1)).alias("stock_count"),
    )


def find_portfolio(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Portfolio whose name equals the query text (any case), else the first that contains it or is contained in it.

    names(portfolio), wanted(query): a handful of rows each. No match keeps the
    query with a null portfolio and the list of available names.
    """
    a, b = F.lower("portfolio"), F.lower(F.trim("query"))
    score = F.when(a == b, 0).when((b != "") & (a.contains(b) | b.contains(a)), 1)
    hits = (
        wanted.join(F.broadcast(names), score.isNotNull())
        .groupBy("query")
        .agg(F.min_by("portfolio", F.struct(score, "portfolio")).alias("portfolio"))
    )
    every = names.agg(F.array_join(F.array_sort(F.collect_list("portfolio")), ",").alias("all_names"))
    return wanted.join(hits, "query", "left").join(F.broadcast(every)).select(
        "query", "portfolio", F.when(F.col("portfolio").isNull(), F.col("all_names")).alias("available")
    )
