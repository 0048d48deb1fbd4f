"""Estimator and hybrid portfolio queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantfold.operators import backtest as bt
from quantfold.operators import error_model as em
from quantfold.operators import estimators as est
from quantfold.operators import hybrid as hy
from quantfold.operators import portfolio as pf
from quantfold.operators import risk
from quantfold.plans.market import Market
from quantfold.plans.registry import query, tidy
from quantfold.plans.risk_queries import _spans, rebalance_as_of, universe_rrc
from quantfold.tables import literal_rows

TOP_N = 15


def by_grp(df: DataFrame) -> DataFrame:
    return df.withColumn("grp", F.col("reb_no").cast("int"))


def hybrid_cands(m: Market) -> DataFrame:
    return by_grp(pf.candidates(m.rebalance_scored, m.rebalances)).select(
        "grp", "stock_id", "rank", "composite_score", "volatility_score"
    )


def hybrid(m: Market) -> tuple[DataFrame, DataFrame]:
    if m.stage.get("hybrid_w") is None:
        w, r = hy.build(
            hybrid_cands(m),
            universe_rrc(m),
            m.panel,
            _spans(m, est.LOOKBACK_CALENDAR),
            _spans(m, risk.SLS_CALENDAR_DAYS),
            TOP_N,
            cut=m.stage.cut,
        )
        m.stage.plain("hybrid_w", w)
        m.stage.plain("hybrid_r", r)
    return m.stage.get("hybrid_w"), m.stage.get("hybrid_r")


def hybrid_stats(m: Market) -> DataFrame:
    key = "hybrid_stats"
    return m.stage.get(key) or m.stage.plain(key, hy.expectations(*hybrid(m)))


@query("trailing_return_windows", "S4 F10 F11")
def trailing_return_windows(m: Market) -> DataFrame:
    """Count, mean and deviation of the last 90 returns of every ranked stock at every rebalance."""
    r = est.trailing_returns(hybrid_cands(m), m.panel, _spans(m, est.LOOKBACK_CALENDAR), universe=True)
    return tidy(
        r.groupBy("grp", "stock_id").agg(
            F.count("ret").alias("n"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("std_ret")
        ),
        8,
    )


@query("shrunk_returns", "E1 E2 E3")
def shrunk_returns(m: Market) -> DataFrame:
    r = est.trailing_returns(hybrid_cands(m), m.panel, _spans(m, est.LOOKBACK_CALENDAR), universe=True)
    return tidy(est.shrunk_returns(r, annualize=252, cut=m.stage.cut).drop("n_obs", "last_idx"))


def coefficients_as_of(m: Market) -> DataFrame:
    """The blended calibration that each rebalance could know."""
    from quantfold.plans.error_queries import as_of, history

    key = "coefficients"
    return m.stage.get(key) or m.stage.plain(key, em.calibration_as_of(as_of(m).withColumn("grp", F.col("grp").cast("int")), history(m)))


@query("error_corrected_returns", "E4 E5 J17")
def error_corrected_returns(m: Market) -> DataFrame:
    """Annualised shrunk returns minus the bias that the calibration known at each rebalance expects."""
    r = est.trailing_returns(hybrid_cands(m), m.panel, _spans(m, est.LOOKBACK_CALENDAR), universe=True)
    mu = est.shrunk_returns(r, annualize=252, cut=m.stage.cut).select("grp", "stock_id", "mu")
    dates = F.broadcast(m.rebalances.select(F.col("reb_no").cast("int").alias("grp"), F.col("score_date").alias("date")))
    f = m.rebalance_scored.join(dates, "date").select(
        "grp", "stock_id", "momentum_score", "quality_score", "value_score", "volatility_score"
    )
    return tidy(est.error_corrected(mu, f, coefficients_as_of(m)))


@query("hybrid_expectations_calibrated", "H5 E5")
def hybrid_expectations_calibrated(m: Market) -> DataFrame:
    """Expectations with the calibration known at each rebalance; as in the product the correction only sees the volatility score."""
    w, r = hybrid(m)
    return tidy(hy.expectations(w, r, coefficients_as_of(m)))


@query("hybrid_candidate_pool", "H1 L6")
def hybrid_candidate_pool(m: Market) -> DataFrame:
    return tidy(hy.candidate_pool(hybrid_cands(m), universe_rrc(m)))


@query("hybrid_weights", "H2 H3 H4 H7 X4 J14")
def hybrid_weights(m: Market) -> DataFrame:
    w, _ = hybrid(m)
    return tidy(w.select("grp", "stock_id", "pick", "score", "vol", "weight"))


@query("hybrid_expectations", "H5 H6 A11")
def hybrid_expectations(m: Market) -> DataFrame:
    return tidy(hybrid_stats(m))


@query("covariance_diagnostics", "E6 E7 E8")
def covariance_diagnostics(m: Market) -> DataFrame:
    """Shrunk covariance of the hybrid holdings at every rebalance."""
    w, r = hybrid(m)
    rows = est.complete_rows(r.join(w.select("grp", "stock_id"), ["grp", "stock_id"], "left_semi"))
    # jitter and eigenvalues near 1e-8 are the point of this table: nothing is rounded
    return est.covariance_report(rows.select("grp", "stock_id", "idx", "ret"))


def held_covariance(m: Market) -> DataFrame:
    key = "covariance"
    if m.stage.get(key) is None:
        w, r = hybrid(m)
        rows = est.complete_rows(r.join(w.select("grp", "stock_id"), ["grp", "stock_id"], "left_semi"))
        m.stage.plain(key, est.covariance_entries(m.stage.cut(rows.select("grp", "stock_id", "idx", "ret"))))
    return m.stage.get(key)


@query("covariance_entries", "E6 E7 E8 A10")
def covariance_entries(m: Market) -> DataFrame:
    """Blended covariance of the hybrid holdings at every rebalance, entry by entry."""
    return tidy(held_covariance(m), 12)


@query("covariance_pivots", "E7 E8")
def covariance_pivots(m: Market) -> DataFrame:
    return tidy(est.covariance_pivots(held_covariance(m)), 12)


@query("covariance_summary", "E8")
def covariance_summary(m: Market) -> DataFrame:
    e = held_covariance(m)
    s = est.covariance_summary(e, m.stage.cut(est.covariance_pivots(e)))
    return tidy(s.withColumn("log_det", F.round("log_det", 6)), 12)


@query("covariance_ledoit_wolf", "E6")
def covariance_ledoit_wolf(m: Market) -> DataFrame:
    w, r = hybrid(m)
    rows = est.complete_rows(r.join(w.select("grp", "stock_id"), ["grp", "stock_id"], "left_semi"))
    out = est.covariance_report(rows.select("grp", "stock_id", "idx", "ret"), method="ledoit_wolf")
    return tidy(out.select("grp", "n_assets", "n_obs", "shrinkage"))


def as_portfolio(w: DataFrame, name: str) -> DataFrame:
    return w.select(
        F.lit(name).alias("portfolio"), F.col("grp").alias("reb_no"), "stock_id", "weight"
    )


def hybrid_curve(m: Market) -> DataFrame:
    if m.stage.get("curve_hybrid") is None:
        w, _ = hybrid(m)
        target = literal_rows(m.spark, [("portfolio", "string"), ("target_vol", "double")], [("hybrid", hy.TARGET_VOL)])
        m.stage.plain(
            "curve_hybrid",
            bt.backtest(as_portfolio(w, "hybrid"), m.rebalances, m.panel, target, cut=m.stage.cut),
        )
    return m.stage.get("curve_hybrid")


@query("hybrid_backtest_curve", "H8")
def hybrid_backtest_curve(m: Market) -> DataFrame:
    return tidy(hybrid_curve(m).drop("idx", "reb_no"))


@query("hybrid_backtest_summary", "H8")
def hybrid_backtest_summary(m: Market) -> DataFrame:
    corr = hybrid_stats(m).agg(F.avg("avg_pairwise_corr").alias("avg_pairwise_corr"))
    spread = hy.period_sharpe_spread(hybrid_curve(m))
    return tidy(bt.summary(hybrid_curve(m), population=True).join(spread, "portfolio").join(F.broadcast(corr)))


@query("stop_loss_ablation", "B13")
def stop_loss_ablation(m: Market) -> DataFrame:
    """Hybrid backtest with and without the stop-loss layer, differences and rule flags."""
    w, r = hybrid(m)
    if m.stage.get("hybrid_nosls") is None:
        plain, _ = hy.build(
            hybrid_cands(m),
            universe_rrc(m),
            m.panel,
            _spans(m, est.LOOKBACK_CALENDAR),
            _spans(m, risk.SLS_CALENDAR_DAYS),
            TOP_N,
            use_sls=False,
            cut=m.stage.cut,
        )
        m.stage.plain("hybrid_nosls", plain)
    both = as_portfolio(w, "with_sls").unionByName(as_portfolio(m.stage.get("hybrid_nosls"), "without_sls"))
    both = m.stage.cut(both)
    curve = m.stage.cut(bt.backtest(both, m.rebalances, m.panel, cut=m.stage.cut))
    turn = bt.turnover(both, curve.select("portfolio", "reb_no")).groupBy("portfolio").agg(
        (F.sum("turnover") * bt.COST_RATE).alias("turnover_cost")
    )
    s = bt.summary(curve, population=True).join(turn, "portfolio")
    cols = ["cagr", "sharpe", "max_drawdown", "volatility", "turnover_cost"]
    wide = s.groupBy().agg(
        *[F.max(F.when(F.col("portfolio") == p, F.col(c))).alias(f"{c}_{p}") for c in cols for p in ("with_sls", "without_sls")]
    )
    for c in cols:
        wide = wide.withColumn(f"d_{c}", F.col(f"{c}_with_sls") - F.col(f"{c}_without_sls"))
    return tidy(
        wide.withColumn("alpha_loss", F.col("d_cagr") < -0.05).withColumn(
            "turnover_up", F.col("turnover_cost_with_sls") > F.col("turnover_cost_without_sls") * 1.05
        )
    )


@query("hybrid_correlation_matrix", "O8")
def hybrid_correlation_matrix(m: Market) -> DataFrame:
    """Correlations of the latest hybrid holdings (at most 15 names) for display."""
    w, r = hybrid(m)
    last = w.agg(F.max("grp").alias("grp"))
    rows = r.join(F.broadcast(last), "grp").join(w.select("grp", "stock_id"), ["grp", "stock_id"], "left_semi")
    from quantfold.functions.exprs import safe_corr

    a = rows.select("idx", F.col("stock_id").alias("stock_a"), F.col("ret").alias("ra"))
    b = rows.select("idx", F.col("stock_id").alias("stock_b"), F.col("ret").alias("rb"))
    return tidy(a.join(b, "idx").groupBy("stock_a", "stock_b").agg(safe_corr("ra", "rb").alias("correlation")))
