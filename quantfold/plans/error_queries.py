"""Calibration and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfold.operators import error_model as em
from quantfold.operators import estimators as est
from quantfold.plans.market import Market
from quantfold.plans.registry import query, tidy
from quantfold.plans.risk_queries import _spans

KEYS = ["window_start", "window_end"]


def priced(m: Market) -> DataFrame:
    key = "priced"
    return m.stage.get(key) or m.stage.bucketed(
        key, em.untouched_returns(m.prices, m.calendar), "stock_id", ["stock_id", "idx"]
    )


def as_of(m: Market) -> DataFrame:
    return m.rebalances.select(F.col("reb_no").alias("grp"), F.col("reb_date").alias("as_of"), "score_date")


def observations(m: Market, method: str = "shrinkage") -> DataFrame:
    key = f"obs_{method}"
    return m.stage.get(key) or m.stage.plain(
        key,
        em.observation_panel(
            as_of(m), m.rebalance_scored, priced(m), m.calendar, _spans(m, est.LOOKBACK_CALENDAR), method, m.stage.cut
        ),
    )


def windows(m: Market) -> DataFrame:
    """Five-year windows ending at every June and December month end."""
    ends = m.rebalances.where(F.month("reb_date").isin(6, 12)).select(F.col("reb_date").alias("window_end"))
    return em.calibration_windows(ends)


def window_rows(m: Market) -> DataFrame:
    key = "obs_numbered"
    rows = m.stage.get(key) or m.stage.plain(key, em.numbered_in_day(observations(m)))
    return em.in_windows(rows, windows(m))


def fits(m: Market) -> DataFrame:
    return m.stage.get("fits") or m.stage.plain("fits", em.error_coefficients(window_rows(m), KEYS))


@query("forward_returns", "E11 J4")
def forward_returns(m: Market) -> DataFrame:
    return tidy(est.forward_returns(as_of(m).select("grp", "as_of"), m.calendar, priced(m)).drop("as_of", "exit_date"))


@query("predicted_returns", "E9 E10")
def predicted_returns(m: Market) -> DataFrame:
    """Shrinkage prediction next to the score proxy."""
    day = m.rebalance_scored.join(F.broadcast(as_of(m).select("grp", F.col("score_date").alias("date"))), "date")
    r = est.trailing_returns(day, priced(m), _spans(m, est.LOOKBACK_CALENDAR), None, universe=True)
    proxy = day.select("grp", "stock_id", est.predicted_from_score(F.col("composite_score")).alias("score_return"))
    mu = est.predicted_from_shrinkage(r, m.stage.cut).drop("last_idx")
    return tidy(proxy.join(mu, ["grp", "stock_id"], "left"))


@query("observation_panel", "C1 J8 J9")
def observation_panel(m: Market) -> DataFrame:
    return tidy(observations(m).drop("newest_source", "exit_date"))


@query("observation_panel_score_method", "C1 E10")
def observation_panel_score_method(m: Market) -> DataFrame:
    return tidy(observations(m, "score").select("grp", "stock_id", "predicted_return", "actual_return", "error"))


@query("error_coefficients", "C2 C3 A15 A17")
def error_coefficients(m: Market) -> DataFrame:
    return tidy(fits(m))


@query("annual_refits", "C4")
def annual_refits(m: Market) -> DataFrame:
    return tidy(em.annual_refits(window_rows(m)))


@query("refit_stability", "C4")
def refit_stability(m: Market) -> DataFrame:
    return tidy(em.refit_stability(em.annual_refits(window_rows(m))), 5)


def history(m: Market) -> DataFrame:
    return m.stage.get("calib") or m.stage.plain("calib", em.blended_history(fits(m)))


@query("blended_calibrations", "C5 C6 S23")
def blended_calibrations(m: Market) -> DataFrame:
    return tidy(history(m))


@query("calibration_due", "C6 R3")
def calibration_due(m: Market) -> DataFrame:
    return tidy(em.calibration_due(m.rebalances.select(F.col("reb_date").alias("today")), history(m)))


@query("current_coefficients", "C7 S23")
def current_coefficients(m: Market) -> DataFrame:
    return tidy(em.current_coefficients(history(m)))


@query("coefficient_table", "C8")
def coefficient_table(m: Market) -> DataFrame:
    return tidy(em.coefficient_table(history(m), F.lit(m.last_score_date)))


@query("coefficient_stability", "G3 W25")
def coefficient_stability(m: Market) -> DataFrame:
    out = em.coefficient_stability(window_rows(m), fits(m), KEYS)
    return tidy(out.withColumn("cv", F.when(F.col("cv") < 1e6, F.col("cv"))), 5)


@query("out_of_sample_check", "G4 W26 A16")
def out_of_sample_check(m: Market) -> DataFrame:
    return tidy(em.out_of_sample(window_rows(m), KEYS))


@query("window_overlaps", "G1 G2")
def window_overlaps(m: Market) -> DataFrame:
    return em.overlapping_windows(windows(m))


@query("integrity_audit", "G5 G1 G2")
def integrity_audit(m: Market) -> DataFrame:
    rows = window_rows(m)
    stab = m.stage.cut(em.coefficient_stability(rows, fits(m), KEYS))
    oos = m.stage.cut(em.out_of_sample(rows, KEYS))
    return tidy(em.integrity_audit(rows, fits(m), windows(m), stab, oos, KEYS))
