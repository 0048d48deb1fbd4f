"""Idempotent merges and writers over parquet tables.

The merge functions are pure (DataFrame in, DataFrame out); the ``write_*``
functions apply them to a path. Keys are compared null-safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantfold.functions.exprs import listed_symbol


def _same_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key."""
    fresh = incoming.dropDuplicates(list(keys)).alias("n")
    old = existing.select(*keys).alias("o")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
    return fresh.join(old, cond, "left_anti")


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the largest values of ``order`` (then of the other columns), whatever the order of arrival."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in (*order, *rest)])
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def append_counts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Inserted and skipped row counts per ``by`` of an insert-only append."""
    got = incoming.groupBy(*by).agg(F.count(F.lit(1)).alias("offered"))
    put = new_rows(existing, incoming, keys).groupBy(*by).agg(F.count(F.lit(1)).alias("_i"))
    inserted = F.coalesce("_i", F.lit(0))
    return got.join(put, list(by), "left").select(
        *by, inserted.alias("inserted"), (F.col("offered") - inserted).alias("skipped")
    )


def upserted(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows with incoming ones put over them, key by key."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn", "_new")


def replaced(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows without the groups that the incoming rows bring, plus the incoming rows."""
    groups = incoming.select(*keys).distinct()
    return existing.join(groups, list(keys), "left_anti").unionByName(incoming)


def replace_counts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows inserted and deleted per replaced group."""
    ins = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("inserted"))
    dele = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"))
    return ins.join(dele, list(keys), "left").select(*keys, "inserted", F.coalesce("_d", F.lit(0)).alias("deleted"))


def write_new(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Append rows with new keys to a parquet table; returns (inserted, skipped). Safe to repeat."""
    offered = incoming.count()
    existing = read_or_empty(spark, path, incoming)
    before = existing.count()
    new_rows(existing, incoming, keys).write.mode("append").parquet(path)
    inserted = spark.read.schema(incoming.schema).parquet(path).count() - before
    return inserted, offered - inserted


def write_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Replace exactly the partitions that ``df`` brings, with one task (or more, where they are large) per partition."""
    df.repartition(*partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stored table, or no rows where there is none yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def last_price_dates(prices: DataFrame) -> DataFrame:
    """Newest stored date per stock (the ingest watermark)."""
    return prices.groupBy("stock_id").agg(F.max("date").alias("last_date"))


def normalised_universe(raw: DataFrame, name_fields: Sequence[str]) -> DataFrame:
    """Symbol from the first filled field, trimmed, with the exchange suffix, once each."""
    filled = [F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in name_fields]
    return raw.select(listed_symbol(F.coalesce(*filled)).alias("symbol")).where(F.col("symbol").isNotNull()).distinct()


def merged_universe(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert missing symbols; fill the sector only where it is empty.

    stored/incoming(symbol, name, sector); ``change`` says what happened to each row.
    """
    o, n = stored.alias("o"), incoming.alias("n")
    joined = o.join(n, F.col("o.symbol") == F.col("n.symbol"), "full_outer")
    blank = F.col("o.sector").isNull() | (F.col("o.sector") == "")
    return joined.select(
        F.coalesce("o.symbol", "n.symbol").alias("symbol"),
        F.coalesce("o.name", "n.name").alias("name"),
        F.when(blank, F.coalesce("n.sector", "o.sector")).otherwise(F.col("o.sector")).alias("sector"),
        F.when(F.col("o.symbol").isNull(), "inserted")
        .when(blank & F.col("n.sector").isNotNull(), "updated")
        .otherwise("kept")
        .alias("change"),
    )


def enriched_sectors(stocks: DataFrame, sector_map: DataFrame) -> DataFrame:
    """Null sectors filled from a symbol map."""
    m = sector_map.select("symbol", F.col("sector").alias("_s"))
    return stocks.join(m, "symbol", "left").withColumn("sector", F.coalesce("sector", "_s")).drop("_s")


def trimmed_history(history: DataFrame, keys: Sequence[str], order: str, keep: int = 36) -> DataFrame:
    """Newest ``keep`` entries per key."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(order))
    return history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def rebalance_calls(calls: DataFrame, forced: Column | None = None) -> DataFrame:
    """Which of a series of calls (user, call_date) rebalance: the first in each calendar month, or forced ones."""
    w = Window.partitionBy("user_id", F.trunc("call_date", "MM")).orderBy("call_date")
    first = F.row_number().over(w) == 1
    run = first if forced is None else first | forced
    return calls.withColumn("status", F.when(run, "rebalanced").otherwise("skipped"))


def metrics_snapshot(stats: DataFrame, portfolio_type: str, rebalance_date: Column) -> DataFrame:
    """Snapshot row of a hybrid build. The expected Sharpe also fills the cagr column, as a forward proxy."""
    return stats.select(
        F.lit(None).cast("bigint").alias("user_id"),
        F.lit(portfolio_type).alias("portfolio_type"),
        F.lit(None).cast("string").alias("portfolio_name"),
        rebalance_date.alias("rebalance_date"),
        F.col("expected_sharpe").alias("cagr"),
        F.col("expected_volatility").alias("volatility"),
        F.col("expected_sharpe").alias("sharpe"),
        F.lit(0.0).alias("max_drawdown"),
        F.lit(0.0).alias("calmar"),
        F.col("n_stocks").cast("int").alias("n_stocks"),
        "expected_volatility",
        "expected_sharpe",
        "avg_pairwise_corr",
    )


def latest_snapshot(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest metrics row per key."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), "rebalance_date").alias("_v")).select(
        *keys, *[F.col(f"_v.{c}").alias(c) for c in rest]
    )


def load_portfolios(portfolios: DataFrame, members: DataFrame) -> DataFrame:
    """Saved portfolios with their symbols, a row each; a portfolio without stocks has one row without a symbol."""
    return portfolios.join(members.select("portfolio", "symbol"), "portfolio", "left")


def allocation_history(allocations: DataFrame, since=None, until=None, names: Sequence[str] | None = None) -> DataFrame:
    """Stored allocations with their place by weight inside each portfolio and date; dates (inclusive) and names are optional filters.

    A portfolio has at most a few dozen stocks per date, so places are taken directly."""
    out = allocations
    if since is not None:
        out = out.where(F.col("rebalance_date") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("rebalance_date") <= F.lit(until))
    if names is not None:
        out = out.where(F.col("portfolio_name").isin(list(names))) if names else out.limit(0)
    place = Window.partitionBy("user_id", "portfolio_type", "portfolio_name", "rebalance_date").orderBy(F.desc("weight"), "stock_id")
    return out.withColumn("position", F.row_number().over(place))


def save_portfolio(members: DataFrame, name: str, incoming: DataFrame) -> DataFrame:
    """Member table with one portfolio's stock list replaced."""
    return members.where(F.col("portfolio") != name).unionByName(incoming)


def delete_portfolio(members: DataFrame, name: str) -> DataFrame:
    return members.where(F.col("portfolio") != name)


def save_positions(stored: DataFrame, positions: DataFrame, stocks: DataFrame, user_id: int | None) -> DataFrame:
    """Tracker table with one user's positions replaced and stock ids resolved (unknown symbols keep null)."""
    uid = F.lit(user_id).cast("bigint")
    fresh = positions.join(stocks.select("symbol", "stock_id"), "symbol", "left").select(
        uid.alias("user_id"), "stock_id", "symbol", "invested_amount", "quantity"
    )
    return stored.where(~F.col("user_id").eqNullSafe(uid)).unionByName(fresh)


def table_health(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Row count and newest date of each table: {name: (table, date column or None)}."""
    out: DataFrame | None = None
    for name, (df, date_col) in tables.items():
        newest = F.max(date_col).cast("date") if date_col else F.lit(None).cast("date")
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), newest.alias("max_date"))
        out = row if out is None else out.unionByName(row)
    return out


def write_report(sections: dict[str, DataFrame], summary: DataFrame, folder: str) -> None:
    """Validation report: one CSV folder per section and a JSON summary."""
    for name, df in sections.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
