"""Stability, regime, rating and portfolio comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfold.operators import backtest as bt
from quantfold.operators import rating as rt
from quantfold.operators import stability as st
from quantfold.plans.core_queries import both_curve, both_weights, user_curve, user_weights
from quantfold.plans.market import Market
from quantfold.plans.registry import query, tidy


@query("rolling_portfolio_metrics", "Q1 W10 W11 W12 X1")
def rolling_portfolio_metrics(m: Market) -> DataFrame:
    return tidy(st.rolling_metrics(user_curve(m)).drop("n"))


@query("regime_sharpe_split", "K7 Q3 W13")
def regime_sharpe_split(m: Market) -> DataFrame:
    return tidy(st.regime_sharpe(user_curve(m)))


@query("regime_cagr_split", "K6 W15")
def regime_cagr_split(m: Market) -> DataFrame:
    return tidy(st.regime_cagr(both_curve(m)))


def user_stability(m: Market) -> DataFrame:
    return m.stage.get("stab_user") or m.stage.plain("stab_user", st.stability(user_curve(m)))


@query("stability_scores", "Q2 Q4 X2")
def stability_scores(m: Market) -> DataFrame:
    return tidy(user_stability(m))


@query("stability_with_history", "Q2 A14 W23")
def stability_with_history(m: Market) -> DataFrame:
    """Both strategies with their turnovers and the correlations inside their holding periods."""
    w = both_weights(m)
    turn = bt.turnover(w, both_curve(m).select("portfolio", "reb_no"))
    return tidy(st.stability(both_curve(m), turn.select("portfolio", "seq", "turnover"), correlations(m)))


def correlations(m: Market) -> DataFrame:
    key = "corr_both"
    return m.stage.get(key) or m.stage.plain(key, st.correlation_history(both_weights(m), m.rebalances, m.panel))


@query("correlation_history", "W23 A10 A11")
def correlation_history(m: Market) -> DataFrame:
    """Mean correlation inside each holding period of both strategies."""
    return tidy(correlations(m))


def user_rrc(m: Market) -> DataFrame:
    key = "rrc_user"
    return m.stage.get(key) or m.stage.plain(
        key, st.portfolio_responsiveness(user_curve(m), st.mean_of_portfolios(user_curve(m)))
    )


@query("portfolio_responsiveness", "K5 J13")
def portfolio_responsiveness(m: Market) -> DataFrame:
    return tidy(user_rrc(m))


def user_summary(m: Market) -> DataFrame:
    return m.stage.get("sum_user") or m.stage.plain("sum_user", bt.summary(user_curve(m)))


def user_correlation(m: Market) -> DataFrame:
    key = "corr_user"
    return m.stage.get(key) or m.stage.plain(
        key, bt.average_pairwise_correlation(user_weights(m), user_curve(m), m.panel)
    )


def user_rating_input(m: Market) -> DataFrame:
    return rt.rating_input(user_summary(m), user_stability(m), user_correlation(m), user_rrc(m))


@query("rating_input", "Q6")
def rating_input(m: Market) -> DataFrame:
    return tidy(user_rating_input(m))


@query("composite_ratings", "Q5 Q8 W6")
def composite_ratings(m: Market) -> DataFrame:
    return tidy(rt.composite_rating(user_rating_input(m), display=False))


@query("top_rated_portfolio", "Q7")
def top_rated_portfolio(m: Market) -> DataFrame:
    return tidy(rt.top_portfolio(rt.composite_rating(user_rating_input(m), display=False)))


@query("normalised_ratings", "Q9")
def normalised_ratings(m: Market) -> DataFrame:
    return tidy(rt.normalised_rating(rt.minmax_metrics(user_summary(m))))


@query("portfolio_correlation_matrix", "Q10 A10 J13")
def portfolio_correlation_matrix(m: Market) -> DataFrame:
    return tidy(rt.portfolio_correlation(user_curve(m)))


@query("portfolio_comparison", "Q11 O6 X3")
def portfolio_comparison(m: Market) -> DataFrame:
    """Comparison table: metrics, rating, grade and warnings of every saved portfolio."""
    rated = rt.composite_rating(user_rating_input(m), display=False)
    warn = bt.sanity_warnings(user_summary(m)).select(
        "portfolio", "total_return", "win_rate", F.array_join("warnings", ",").alias("warnings")
    )
    return tidy(
        rated.select("portfolio", "cagr", "sharpe", "max_drawdown", "stability_score", "composite_score", "grade", "rank").join(
            warn, "portfolio"
        )
    )


@query("research_anomalies", "Q12")
def research_anomalies(m: Market) -> DataFrame:
    out = rt.anomaly_flags(user_summary(m).unionByName(bt.summary(both_curve(m))))
    return out.select("portfolio", F.array_join("anomalies", ",").alias("anomalies"))
