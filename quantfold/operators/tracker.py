"""Valuation of tracked positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions.exprs import ratio


def normalise_positions(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Valid positions: trimmed upper-case symbol, numeric amounts, invested >= 0, quantity > 0.

    The last row of a symbol wins; ``order`` names the input position column.
    """
    typed = rows.select(
        *[c for c in rows.columns if c not in ("symbol", "invested_amount", "quantity")],
        F.upper(F.trim(F.coalesce(F.col("symbol").cast("string"), F.lit("")))).alias("symbol"),
        F.expr("try_cast(invested_amount AS double)").alias("invested_amount"),
        F.expr("try_cast(quantity AS double)").alias("quantity"),
    )
    valid = typed.where(
        (F.col("symbol") != "") & (F.col("invested_amount") >= 0) & (F.col("quantity") > 0)
    )
    if order is None:
        return valid
    keys = [c for c in ("user_id",) if c in rows.columns]
    last = Window.partitionBy(*keys, "symbol").orderBy(F.desc(order))
    return valid.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", order)


def latest_prices(prices: DataFrame, stocks: DataFrame) -> DataFrame:
    """Last close and its date per symbol, one aggregation instead of a self join."""
    return (
        prices.groupBy("stock_id")
        .agg(F.max_by("close", "date").alias("current_price"), F.max("date").alias("price_date"))
        .join(stocks.select("stock_id", "symbol"), "stock_id")
        .select("symbol", "current_price", "price_date")
    )


def valuation(positions: DataFrame, latest: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """Average cost, value and profit per position; overlay prices win over stored ones."""
    df = positions.join(latest, "symbol", "left").withColumn("price_source", F.lit("database"))
    if overlay is not None:
        live = overlay.where(F.col("current_price").isNotNull()).select(
            "symbol", F.col("current_price").alias("_p"), F.col("price_date").alias("_d")
        )
        df = (
            df.join(live, "symbol", "left")
            .withColumn("price_source", F.when(F.col("_p").isNotNull(), "live").otherwise(F.col("price_source")))
            .withColumn("current_price", F.coalesce("_p", "current_price"))
            .withColumn("price_date", F.when(F.col("_p").isNotNull(), F.col("_d")).otherwise(F.col("price_date")))
            .drop("_p", "_d")
        )
    amount = F.col("current_price") * F.col("quantity")
    pnl = amount - F.col("invested_amount")
    return (
        df.withColumn("average_cost", ratio("invested_amount", "quantity"))
        .withColumn("current_amount", amount)
        .withColumn("pnl", pnl)
        .withColumn("pnl_pct", F.when(F.col("invested_amount") > 0, pnl / F.col("invested_amount")))
    )


def missing_prices(valued: DataFrame) -> DataFrame:
    return valued.where(F.col("current_price").isNull()).select("user_id", "symbol")


def valuation_summary(valued: DataFrame) -> DataFrame:
    """Totals per user; missing prices count as zero value."""
    zero = F.lit(0.0)
    out = valued.groupBy("user_id").agg(
        F.sum(F.coalesce("invested_amount", zero)).alias("total_invested"),
        F.sum(F.coalesce("current_amount", zero)).alias("total_current"),
        F.count("current_price").alias("priced_positions"),
        F.count(F.lit(1)).alias("total_positions"),
        F.max("price_date").alias("latest_price_date"),
    )
    pnl = F.col("total_current") - F.col("total_invested")
    return out.withColumn("total_pnl", pnl).withColumn(
        "total_pnl_pct", F.when(F.col("total_invested") > 0, pnl / F.col("total_invested"))
    )
