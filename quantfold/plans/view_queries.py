"""Sector, tracker, signal and view queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfold.operators import factors as fac
from quantfold.operators import risk
from quantfold.operators import sectors as sec
from quantfold.operators import signals as sig
from quantfold.operators import tracker as trk
from quantfold.operators import views
from quantfold.plans.core_queries import both_weights, members, user_specs, user_weights
from quantfold.plans.market import Market
from quantfold.plans.registry import query, tidy
from quantfold.plans.risk_queries import universe_sls
from quantfold.sources import market as src
from quantfold.tables import bounded


def day_scores(m: Market) -> DataFrame:
    return m.last_scored


@query("sector_map", "Z1 F8")
def sector_map(m: Market) -> DataFrame:
    return sec.stocks_by_sector(m.stocks)


@query("sector_performance", "Z2 A8")
def sector_performance(m: Market) -> DataFrame:
    """Whole history up to the last score date."""
    return tidy(
        sec.sector_performance(
            m.panel, m.stocks, F.lit("1900-01-01").cast("date"), F.lit(m.last_score_date), day_scores(m)
        )
    )


@query("sector_exposure", "Z3 A12 J15")
def sector_exposure(m: Market) -> DataFrame:
    return tidy(sec.sector_exposure(both_weights(m), m.stocks, ["portfolio", "reb_no"]))


@query("sector_rankings", "Z4 J19")
def sector_rankings(m: Market) -> DataFrame:
    """180-day sector ranking with the three best stocks of each sector."""
    last = F.lit(m.last_score_date)
    perf = sec.sector_performance(m.panel, m.stocks, F.date_sub(last, 180), last, day_scores(m))
    dates = m.score_dates.agg(F.max("date").alias("date"))
    return tidy(sec.sector_rankings(perf, fac.ranked_snapshot(m.last_scored, m.stocks, dates)))


def positions(m: Market) -> DataFrame:
    return src.tracker_positions(m.spark, m.sf_dir)


@query("tracker_positions", "Y1 F13 S22")
def tracker_positions(m: Market) -> DataFrame:
    """Raw position lines as text, padded and lower-cased, after validation."""
    raw = positions(m).select(
        "user_id",
        F.concat(F.lit("  "), F.lower("symbol"), F.lit(" ")).alias("symbol"),
        F.format_string("%.2f", "invested_amount").alias("invested_amount"),
        F.when(F.col("quantity") < 20, F.lit("n/a")).otherwise(F.format_string("%.1f", "quantity")).alias("quantity"),
    )
    return tidy(trk.normalise_positions(raw))


def valued(m: Market) -> DataFrame:
    return trk.valuation(trk.normalise_positions(positions(m)), _latest(m))


def _latest(m: Market) -> DataFrame:
    names = m.stocks.withColumn("symbol", F.upper("symbol"))
    return trk.latest_prices(m.prices, names)


@query("latest_prices", "J10 S10")
def latest_prices(m: Market) -> DataFrame:
    return tidy(_latest(m).withColumn("current_price", F.col("current_price") + F.lit(1e-9)))


@query("tracker_valuation", "Y2")
def tracker_valuation(m: Market) -> DataFrame:
    return valued(m)


@query("tracker_summary", "Y3 A18")
def tracker_summary(m: Market) -> DataFrame:
    return trk.valuation_summary(valued(m))


@query("tracker_overlay", "Y4")
def tracker_overlay(m: Market) -> DataFrame:
    """Stored prices overlaid by a newer source (here: two percent up, where market cap is positive)."""
    names = m.stocks.where(F.col("market_cap") > 0).select(F.upper("symbol").alias("symbol"))
    overlay = _latest(m).join(names, "symbol", "left_semi").select(
        "symbol", (F.col("current_price") * 1.02).alias("current_price"), F.date_add("price_date", 1).alias("price_date")
    )
    return trk.valuation(trk.normalise_positions(positions(m)), _latest(m), overlay)


@query("latest_scores", "N1")
def latest_scores(m: Market) -> DataFrame:
    return tidy(sig.latest_scores(m.newest_scored))


@query("score_trend", "N2 W22")
def score_trend(m: Market) -> DataFrame:
    return trend(m)


def single_stop_loss(m: Market) -> DataFrame:
    """Each stock scored on its own (absolute maps) at the last score date."""
    key = "sls_single"
    if m.stage.get(key) is None:
        last = m.score_dates.agg(F.max("date").alias("as_of"))
        span = risk.spans(last.select(F.lit(0).alias("grp"), "as_of"), m.calendar, risk.SLS_CALENDAR_DAYS)
        cut = (
            m.panel.join(F.broadcast(span.drop("grp")), F.col("idx").between(F.col("lo_idx"), F.col("hi_idx")))
            .select(F.col("stock_id").alias("grp"), "stock_id", "idx", "close", "ret")
        )
        m.stage.plain(key, risk.own_market_stop_loss(cut, display=False))
    return m.stage.get(key)


@query("single_stock_stop_loss", "K2")
def single_stock_stop_loss(m: Market) -> DataFrame:
    out = single_stop_loss(m)
    return tidy(out.withColumn("trigger_threshold", F.col("trigger_threshold") + F.lit(1e-9)))


def trend(m: Market) -> DataFrame:
    first = m.newest_dates.agg(F.date_sub(F.min("date"), sig.TREND_DAYS).alias("first"))
    recent = m.composites.join(bounded(first), F.col("date") >= F.col("first"))
    return sig.score_trend(recent, m.newest_dates)


def signals(m: Market) -> DataFrame:
    key = "signals"
    return m.stage.get(key) or m.stage.plain(key, sig.stock_signals(m.newest_scored, single_stop_loss(m), trend(m)))


@query("stock_signals", "N3 N4 N5")
def stock_signals(m: Market) -> DataFrame:
    return tidy(signals(m))


@query("unscored_stock_signals", "N6")
def unscored_stock_signals(m: Market) -> DataFrame:
    return tidy(sig.unscored_signals(m.prices))


@query("recommendations", "N7")
def recommendations(m: Market) -> DataFrame:
    return tidy(sig.recommendations(signals(m)).drop("risk_commentary", "explanation"))


@query("recommendation_texts", "N7")
def recommendation_texts(m: Market) -> DataFrame:
    return sig.recommendations(signals(m)).select("stock_id", "risk_profile", "conviction", "recommendation", "explanation", "risk_commentary")


@query("stock_summaries", "O1 O2")
def stock_summaries(m: Market) -> DataFrame:
    f = src.fundamentals(m.spark, m.sf_dir)
    return tidy(views.stock_summary(signals(m), m.stocks, m.composites, f), 2)


@query("portfolio_reviews", "O5")
def portfolio_reviews(m: Market) -> DataFrame:
    return tidy(views.portfolio_review(members(m), signals(m), m.stocks), 4)


@query("recommendation_counts", "A19")
def recommendation_counts(m: Market) -> DataFrame:
    return views.recommendation_counts(views.portfolio_review(members(m), signals(m), m.stocks))


@query("portfolio_lookup", "F12")
def portfolio_lookup(m: Market) -> DataFrame:
    """Every region name looked up by itself, by its first three letters and by a name that does not exist."""
    names = user_specs(m).select("portfolio")
    wanted = names.select(F.lower("portfolio").alias("query")).unionByName(
        names.select(F.substring("portfolio", 1, 3).alias("query"))
    ).unionByName(names.select(F.concat(F.lit("zz"), F.substring("portfolio", 1, 1)).alias("query"))).distinct()
    return views.find_portfolio(names, wanted)


@query("fundamentals_by_quarter", "O2")
def fundamentals_by_quarter(m: Market) -> DataFrame:
    f = src.fundamentals(m.spark, m.sf_dir)
    return tidy(f.select("stock_id", "quarter", "revenue", "net_income"), 4)
