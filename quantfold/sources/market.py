"""Price history and calendar built from trade lines (see FIXTURES.md for the mapping)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantfold.tables import bounded

BURN_IN = 60


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_table(spark, sf_dir, "supplier")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    return supplier.join(bounded(geo), supplier.s_nationkey == geo.n_nationkey, "left").select(
        F.col("s_suppkey").cast("bigint").alias("stock_id"),
        F.col("s_name").alias("symbol"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("sector"),
        F.col("s_acctbal").alias("market_cap"),
    )


def daily_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded value and quantity per stock and day.

    Partial aggregation runs before the shuffle, so a stock that owns a third of
    the lines contributes at most one row per day and map task.
    """
    return (
        read_table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").cast("bigint").alias("stock_id"),
            F.to_date("l_shipdate").alias("date"),
            "l_extendedprice",
            "l_quantity",
        )
        .groupBy("stock_id", "date")
        .agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))
    )


def sparse_prices(trades: DataFrame, burn_in: int = BURN_IN) -> DataFrame:
    """Volume-weighted close over the last ``burn_in`` traded days; the burn-in itself is dropped."""
    by_day = Window.partitionBy("stock_id").orderBy("date")
    frame = by_day.rowsBetween(-(burn_in - 1), 0)
    return (
        trades.withColumn("rn", F.row_number().over(by_day))
        .withColumn("close", F.sum("v").over(frame) / F.sum("q").over(frame))
        .where(F.col("rn") >= burn_in)
        .select("stock_id", "date", "close", F.col("q").alias("volume"))
    )


def trading_calendar(prices: DataFrame) -> DataFrame:
    """Distinct price dates numbered from 1: one row per trading day."""
    return prices.select("date").distinct().select(
        F.row_number().over(Window.orderBy("date")).alias("idx"), "date"
    )


def dense_panel(prices: DataFrame, calendar: DataFrame, last_idx: int) -> DataFrame:
    """One row per stock and trading day from its first price on, last close carried forward.

    Each price row is repeated up to the day before the next one, so no stock x
    calendar product is formed. ``prev_close`` and ``ret`` ride along.
    """
    by_day = Window.partitionBy("stock_id").orderBy("idx")
    numbered = prices.where(F.col("close").isNotNull()).join(bounded(calendar), "date")
    filled = (
        numbered.select(
            "stock_id",
            "close",
            "idx",
            F.coalesce(F.lead("idx").over(by_day) - 1, F.lit(last_idx)).alias("until"),
        )
        .select("stock_id", "close", F.explode(F.sequence("idx", "until")).alias("idx"))
        .join(bounded(calendar), "idx")
    )
    prev = F.lag("close").over(by_day)
    return filled.select(
        "stock_id",
        "idx",
        "date",
        "close",
        F.try_divide("close", prev).alias("_g"),
    ).select("stock_id", "idx", "date", "close", (F.col("_g") - 1).alias("ret"))


def ohlcv_normalised(raw: DataFrame) -> DataFrame:
    """Price input with any column case: lower-case names, missing columns as null, plain dates, sorted."""
    low = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    for name in ("open", "high", "low", "close", "volume"):
        if name not in low.columns:
            low = low.withColumn(name, F.lit(None).cast("double"))
    keys = [c for c in ("symbol", "stock_id") if c in low.columns]
    return low.select(
        *keys,
        F.to_date("date").alias("date"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
    ).where(F.col("date").isNotNull())


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly revenue and net income per stock; ratios that the source lacks stay null."""
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("bigint").alias("stock_id"),
        F.concat(
            F.year("l_shipdate").cast("string"), F.lit("-Q"), F.quarter("l_shipdate").cast("string")
        ).alias("quarter"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        "l_tax",
        "l_extendedprice",
    )
    none = F.lit(None).cast("double")
    return li.groupBy("stock_id", "quarter").agg(
        F.sum("net").alias("revenue"),
        (F.sum(F.col("net") * (1 - F.col("l_tax"))) - F.sum(F.col("l_extendedprice") * 0.8)).alias("net_income"),
    ).select("*", *[none.alias(c) for c in ("eps", "roe", "roce", "debt_equity", "free_cash_flow")])


def tracker_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions per user: what each customer bought from each supplier."""
    orders = read_table(spark, sf_dir, "orders")
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").cast("bigint").alias("stock_id"), "l_extendedprice", "l_quantity"
    )
    names = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("stock_id"), F.col("s_name").alias("symbol")
    )
    return (
        lines.join(orders.select("o_orderkey", "o_custkey"), lines.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").cast("bigint").alias("user_id"), "stock_id")
        .agg(F.sum("l_extendedprice").alias("invested_amount"), F.sum("l_quantity").alias("quantity"))
        .join(names, "stock_id")
        .select("user_id", "symbol", "invested_amount", "quantity")
    )


def user_portfolios(stocks_df: DataFrame, region: DataFrame) -> DataFrame:
    """One saved portfolio per region, strategy and regime mode alternating by region key."""
    even = F.col("r_regionkey") % 2 == 0
    return region.select(
        F.col("r_name").alias("portfolio"),
        F.when(even, "equal_weight").otherwise("inverse_volatility").alias("strategy"),
        F.when(even, "static").otherwise("volatility_targeting").alias("regime_mode"),
        F.lit(5).alias("top_n"),
    )
