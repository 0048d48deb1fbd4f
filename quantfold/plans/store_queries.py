"""Ingest, storage and streaming queries (batch twins of the writers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfold.operators import portfolio as pf
from quantfold.plans.core_queries import both_weights, members, user_specs
from quantfold.plans.hybrid_queries import hybrid, hybrid_stats
from quantfold.plans.market import Market
from quantfold.plans.registry import query, tidy
from quantfold.sources import market as src
from quantfold.sources import writers as wr
from quantfold.streaming import ingest
from quantfold.streaming.rescoring import ScoreStore, rescore_from_prices


def _cutoff(m: Market, back: int):
    """Date ``back`` days before the last, or the first of a shorter calendar."""
    at = F.greatest(F.lit(m.last_idx - back), F.min("idx"))
    return m.calendar.agg(at.alias("idx")).join(m.calendar, "idx").first()["date"]


@query("incremental_append", "S11 J16")
def incremental_append(m: Market) -> DataFrame:
    """Stored: all but the last 60 days. Offered: the last 90 days. Counts per stock."""
    stored = m.prices.where(F.col("date") <= F.lit(_cutoff(m, 60)))
    offered = m.prices.where(F.col("date") > F.lit(_cutoff(m, 90)))
    return wr.append_counts(stored, offered, ["stock_id", "date"], ["stock_id"])


@query("ingest_watermarks", "S10")
def ingest_watermarks(m: Market) -> DataFrame:
    return wr.last_price_dates(m.prices)


@query("normalised_ohlcv", "S9")
def normalised_ohlcv(m: Market) -> DataFrame:
    """Supplier prices handed in with odd column names and no open, high and low."""
    raw = m.prices.select("stock_id", F.col("date").cast("string").alias("Date"), F.col("close").alias(" Close"), F.col("volume").alias("VOLUME"))
    out = src.ohlcv_normalised(raw)
    return tidy(out.withColumn("close", F.col("close") + F.lit(1e-9)))


@query("normalised_universe", "S12")
def normalised_universe(m: Market) -> DataFrame:
    raw = m.table("supplier").select(
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit(" "), F.lower("s_name"))).alias("Symbol"), F.col("s_name").alias("Ticker")
    )
    return wr.normalised_universe(raw, ["Symbol", "Ticker"])


@query("universe_upsert", "S13")
def universe_upsert(m: Market) -> DataFrame:
    """Stored: stocks with positive market cap, the poorer half without a sector. Incoming: all stocks."""
    stored = m.stocks.where(F.col("market_cap") > 0).select(
        "symbol", "name", F.when(F.col("market_cap") > 5000, F.col("sector")).alias("sector")
    )
    return wr.merged_universe(stored, m.stocks.select("symbol", "name", "sector"))


@query("sector_enrichment", "S14 F8")
def sector_enrichment(m: Market) -> DataFrame:
    bare = m.stocks.select("symbol", F.when(F.col("market_cap") > 0, F.col("sector")).alias("sector"))
    return wr.enriched_sectors(bare, m.stocks.select("symbol", F.upper("sector").alias("sector")))


@query("score_upsert", "S15")
def score_upsert(m: Market) -> DataFrame:
    """Scores of the last 30 days replaced by shifted ones; totals per date."""
    stored = m.composites.select("stock_id", "date", "composite_score")
    fresh = stored.where(F.col("date") > F.lit(_cutoff(m, 30))).withColumn("composite_score", F.col("composite_score") + 1)
    out = wr.upserted(stored, fresh, ["stock_id", "date"])
    return tidy(out.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.sum("composite_score").alias("total")))


@query("portfolio_replace", "S16")
def portfolio_replace(m: Market) -> DataFrame:
    """Top-10 equal weights of every date put over the stored top-20 allocations."""
    stored = both_weights(m).select(
        F.col("reb_date").alias("date"), F.col("portfolio").alias("strategy_type"), "stock_id", "weight"
    )
    ten = pf.strategy_weights(pf.candidates(m.rebalance_scored, m.rebalances), [("equal_weight", "equal_weight", 10)])
    fresh = ten.select(F.col("reb_date").alias("date"), F.col("portfolio").alias("strategy_type"), "stock_id", "weight")
    counts = wr.replace_counts(stored, fresh, ["date", "strategy_type"])
    left = wr.replaced(stored, fresh, ["date", "strategy_type"]).groupBy("date").agg(F.count(F.lit(1)).alias("rows_after"))
    return counts.join(left, "date")


def allocations(m: Market) -> DataFrame:
    w, _ = hybrid(m)
    dates = m.rebalances.select(F.col("reb_no").alias("grp"), "reb_date", "reb_no")
    return w.join(F.broadcast(dates), "grp").select(
        F.lit(None).cast("bigint").alias("user_id"),
        F.lit("auto_hybrid").alias("portfolio_type"),
        F.lit(None).cast("string").alias("portfolio_name"),
        F.col("reb_date").alias("rebalance_date"),
        "stock_id",
        "weight",
        "reb_no",
    )


ALLOCATION_KEY = ["user_id", "portfolio_type", "portfolio_name", "rebalance_date", "stock_id"]


@query("monthly_allocation_append", "S17")
def monthly_allocation_append(m: Market) -> DataFrame:
    """Stored: all but the last 8 rebalances. Offered: the last 14. Null user and name count as equal."""
    a = allocations(m)
    last = m.rebalances.agg(F.max("reb_no")).first()[0]
    stored, offered = a.where(F.col("reb_no") <= last - 8), a.where(F.col("reb_no") >= last - 13)
    return wr.append_counts(stored, offered, ALLOCATION_KEY, ["rebalance_date"])


def snapshots(m: Market) -> DataFrame:
    s = hybrid_stats(m).join(
        F.broadcast(m.rebalances.select(F.col("reb_no").cast("int").alias("grp"), "reb_date")), "grp"
    )
    return wr.metrics_snapshot(s, "auto_hybrid", F.col("reb_date"))


@query("metrics_snapshot_append", "S18")
def metrics_snapshot_append(m: Market) -> DataFrame:
    s = snapshots(m)
    keys = ["user_id", "portfolio_type", "portfolio_name", "rebalance_date"]
    stored = s.where(F.col("rebalance_date") <= F.lit(_cutoff(m, 200)))
    return tidy(wr.new_rows(stored, s, keys).drop("user_id", "portfolio_name"))


@query("allocation_history", "S19 F4")
def allocation_history(m: Market) -> DataFrame:
    """All allocations with their place by weight inside each date."""
    return tidy(wr.allocation_history(allocations(m)).select("rebalance_date", "stock_id", "weight", "position"))


@query("latest_metrics_snapshot", "S20")
def latest_metrics_snapshot(m: Market) -> DataFrame:
    return tidy(wr.latest_snapshot(snapshots(m).drop("user_id", "portfolio_name"), ["portfolio_type"]))


@query("saved_portfolios", "S21 J18")
def saved_portfolios(m: Market) -> DataFrame:
    mem = m.stocks.select(F.col("sector").alias("portfolio"), "symbol")
    return wr.load_portfolios(user_specs(m), mem)


@query("rebalance_state", "S24")
def rebalance_state(m: Market) -> DataFrame:
    """Newest 36 rebalances with their expectations."""
    s = snapshots(m).select("rebalance_date", "n_stocks", "expected_volatility", "expected_sharpe")
    return tidy(wr.trimmed_history(s, [], "rebalance_date", 36))


@query("monthly_rebalance_guard", "R1 F14")
def monthly_rebalance_guard(m: Market) -> DataFrame:
    """One call per trading day: only the first of each month rebalances."""
    calls = m.calendar.select(F.lit(1).cast("bigint").alias("user_id"), F.col("date").alias("call_date"))
    return wr.rebalance_calls(calls)


@query("table_health", "S26 S27")
def table_health(m: Market) -> DataFrame:
    return wr.table_health(
        {
            "stocks": (m.stocks, None),
            "prices": (m.prices, "date"),
            "scores": (m.composites, "date"),
            "orders": (m.table("orders"), "o_orderdate"),
            "events": (m.table("events"), "ts"),
        }
    )


@query("positions_per_user", "S22 S26")
def positions_per_user(m: Market) -> DataFrame:
    return tidy(
        src.tracker_positions(m.spark, m.sf_dir).groupBy("user_id").agg(
            F.count(F.lit(1)).alias("positions"), F.sum("quantity").alias("quantity")
        )
    )


@query("daily_bars", "T2")
def daily_bars(m: Market) -> DataFrame:
    return tidy(ingest.daily_bars(m.table("events"), "user_id", "value"))


@query("streamed_daily_bars", "T2")
def streamed_daily_bars(m: Market) -> DataFrame:
    """The same bars from a file stream; only days that the one-day watermark has closed are written."""
    if m.stage.get("bars") is None:
        schema = m.table("events").schema
        stream = ingest.file_stream(m.spark, m.sf_dir, schema, "events.parquet")
        out = f"{m.stage.root}/bars"
        ingest.write_bars(stream, out, f"{m.stage.root}/bars_checkpoint", "user_id", "value").awaitTermination()
        m.stage._tables["bars"] = m.spark.read.parquet(out)
    return tidy(m.stage.get("bars"))


@query("streamed_price_ingest", "T1")
def streamed_price_ingest(m: Market) -> DataFrame:
    """Price files streamed into a table twice (the second run finds nothing new); rows per month."""
    if m.stage.get("ingested") is None:
        root = m.stage.root
        m.prices.select("stock_id", "date", "close", "volume").repartition(4, "date").write.mode("overwrite").parquet(f"{root}/price_files")
        schema = m.prices.select("stock_id", "date", "close", "volume").schema
        for _ in range(2):
            stream = ingest.file_stream(m.spark, f"{root}/price_files", schema)
            ingest.append_prices(stream, f"{root}/price_table", f"{root}/price_checkpoint").awaitTermination()
        m.stage._tables["ingested"] = m.spark.read.parquet(f"{root}/price_table")
    return tidy(
        m.stage.get("ingested").groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))
    )


@query("streamed_rescoring", "T3")
def streamed_rescoring(m: Market) -> DataFrame:
    """Scores made from streamed prices; totals per date, equal to those of the batch run.

    First come the prices up to 120 days before the end, less one row in 40 that comes late and with one
    in 50 closes wrong; then, as a second batch, the late rows, the corrections and the last 120 days.
    """
    if m.stage.get("rescored") is None:
        root = m.stage.root
        prices = m.prices.select("stock_id", "date", "close", "volume")
        pick = F.xxhash64("stock_id", "date")
        late = (F.col("date") > F.lit(_cutoff(m, 120))) | (F.pmod(pick, F.lit(40)) == 0)
        wrong = F.pmod(pick, F.lit(50)) == 1
        first = prices.where(~late).withColumn("close", F.when(wrong, F.col("close") * 1.25).otherwise(F.col("close")))
        for rows in (first, prices.where(late | wrong)):
            rows.write.mode("append").parquet(f"{root}/streamed_prices")
            stream = ingest.file_stream(m.spark, f"{root}/streamed_prices", prices.schema)
            rescore_from_prices(stream, f"{root}/rescoring", f"{root}/rescoring_checkpoint").awaitTermination()
        m.stage._tables["rescored"] = ScoreStore(m.spark, f"{root}/rescoring").scores()
    return tidy(
        m.stage.get("rescored").groupBy("date").agg(
            F.count(F.lit(1)).alias("rows"), F.max("rank").alias("worst_rank"), F.sum(F.abs("composite_score")).alias("total")
        )
    )
