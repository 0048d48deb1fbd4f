"""Stop-loss and responsiveness scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantfold.operators import risk
from quantfold.plans.market import Market
from quantfold.plans.registry import query, tidy
from quantfold.plans.core_queries import TIE_BREAK


def steady(df: DataFrame) -> DataFrame:
    return tidy(df.withColumn("trigger_threshold", F.col("trigger_threshold") + F.lit(TIE_BREAK)))


def rebalance_as_of(m: Market) -> DataFrame:
    return m.rebalances.select(F.col("reb_no").alias("grp"), F.col("reb_date").alias("as_of"))


def _spans(m: Market, days: int) -> DataFrame:
    key = f"spans_{days}"
    return m.stage.get(key) or m.stage.plain(key, risk.spans(rebalance_as_of(m), m.calendar, days))


def universe_rrc(m: Market) -> DataFrame:
    key = "rrc_5y"
    if m.stage.get(key) is None:
        m.stage.plain(key, risk.responsiveness(m.panel, _spans(m, risk.RRC_CALENDAR_DAYS), cut=m.stage.cut))
    return m.stage.get(key)


def universe_sls(m: Market) -> DataFrame:
    key = "sls_universe"
    if m.stage.get(key) is None:
        m.stage.plain(key, risk.stop_loss(m.panel, _spans(m, risk.SLS_CALENDAR_DAYS), display=False, cut=m.stage.cut))
    return m.stage.get(key)


@query("stop_loss_scores", "K1 K1a K1b K1c K1e K1f K1g W7 W17 A4 A9")
def stop_loss_scores(m: Market) -> DataFrame:
    """Every stock at every rebalance date, ranked against the whole universe."""
    return steady(universe_sls(m))


def stock_error_bias(m: Market) -> DataFrame:
    """Error that the calibration known at each rebalance expects of each stock."""
    from quantfold.operators import error_model as em
    from quantfold.plans.hybrid_queries import coefficients_as_of

    dates = F.broadcast(m.rebalances.select(F.col("reb_no").alias("grp"), F.col("score_date").alias("date")))
    return em.calibrated_bias(m.rebalance_scored.join(dates, "date"), coefficients_as_of(m))


@query("stop_loss_with_error_bias", "K1d")
def stop_loss_with_error_bias(m: Market) -> DataFrame:
    """With an error bias per stock, from the error model."""
    out = risk.stop_loss(
        m.panel, _spans(m, risk.SLS_CALENDAR_DAYS), error_bias=m.stage.cut(stock_error_bias(m)), display=False, cut=m.stage.cut
    )
    return tidy(out.select("grp", "stock_id", "err_score", "stop_loss_score", "risk_level"))


@query("stop_loss_profiles", "K2 O7")
def stop_loss_profiles(m: Market) -> DataFrame:
    """Profiles of every supplier at every rebalance, with the Unknown default."""
    last = m.rebalances.agg(F.max("reb_no")).first()[0] or 0
    wanted = m.stocks.select("stock_id", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("grp")) if last else m.stocks.select("stock_id", F.lit(0).alias("grp")).limit(0)
    return steady(risk.profiles(universe_sls(m), wanted))


@query("sector_set_stop_loss", "K1 K2")
def sector_set_stop_loss(m: Market) -> DataFrame:
    """Scores inside each sector's five best names at every rebalance (absolute maps for small sets)."""
    from quantfold.plans.core_queries import user_weights

    named = F.concat_ws("@", "portfolio", "reb_no").alias("grp")
    return steady(_set_stop_loss(m, user_weights(m).select(named, "stock_id", "reb_no")))


def _set_stop_loss(m: Market, members: DataFrame) -> DataFrame:
    """Stop-loss of the sets members(grp, stock_id, reb_no), each scored strictly inside itself at its rebalance."""
    span = _spans(m, risk.SLS_CALENDAR_DAYS).withColumnRenamed("grp", "reb_no")
    windows = members.select("grp", "reb_no").distinct().join(F.broadcast(span), "reb_no").drop("reb_no")
    obs, cut = risk.set_observations(m.panel, members.select("grp", "stock_id"), windows)
    obs, cut = m.stage.cut(obs), m.stage.cut(cut)
    return risk.stop_loss(obs, cut, scope=("grp",), display=False, cut=m.stage.cut)


@query("top_stocks_with_risk", "O7 K2 L3")
def top_stocks_with_risk(m: Market) -> DataFrame:
    """The ten best stocks of every rebalance with their risk columns, scored inside the ten."""
    dates = m.rebalances.select("reb_no", "reb_date", F.col("score_date").alias("date"))
    best = m.rebalance_scored.where(F.col("rank") <= 10).join(F.broadcast(dates), "date")
    top = best.withColumn("position", F.row_number().over(Window.partitionBy("reb_no").orderBy("rank", "stock_id"))).where("position <= 10")
    top = m.stage.cut(top.select("reb_no", "reb_date", "stock_id", "rank", "position", "composite_score"))
    sls = _set_stop_loss(m, top.select(F.col("reb_no").cast("string").alias("grp"), "stock_id", "reb_no"))
    risks = sls.select(F.col("grp").cast("int").alias("reb_no"), "stock_id", "stop_loss_score", "risk_level", "recommended_action", "trigger_threshold", "raw_drawdown")
    return steady(top.join(risks, ["reb_no", "stock_id"], "left").join(m.stocks.select("stock_id", "symbol", "sector"), "stock_id"))


@query("stock_responsiveness", "K3 W14 W16 W18 W19 W20 J20")
def stock_responsiveness(m: Market) -> DataFrame:
    """Five-year responsiveness of every stock at every rebalance date."""
    return tidy(universe_rrc(m))


@query("single_stock_responsiveness", "K4")
def single_stock_responsiveness(m: Market) -> DataFrame:
    """Each stock as its own market over the five years to the last score date."""
    last = m.score_dates.agg(F.max("date").alias("as_of"))
    whole = risk.spans(last.select(F.lit(0).alias("grp"), "as_of"), m.calendar, risk.RRC_CALENDAR_DAYS)
    sets = m.stocks.select(F.col("stock_id").alias("grp"), "stock_id")
    cut = (
        sets.join(F.broadcast(whole.drop("grp")))
        .join(m.panel.select("stock_id", "idx", "close", "ret"), "stock_id")
        .where(F.col("idx").between(F.col("lo_idx"), F.col("hi_idx")))
    )
    return tidy(risk.own_market_responsiveness(cut))
