"""Auto-N, meta-portfolio, validation and governance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantfold.operators import auto_n as an
from quantfold.operators import backtest as bt
from quantfold.operators import estimators as est
from quantfold.operators import factors as fac
from quantfold.operators import governance as gov
from quantfold.operators import hybrid as hy
from quantfold.operators import meta as mt
from quantfold.operators import portfolio as pf
from quantfold.operators import rating as rt
from quantfold.operators import risk
from quantfold.operators import stability as st
from quantfold.operators import validation as val
from quantfold.plans.core_queries import both_curve, both_weights, members, user_curve, user_specs, user_weights
from quantfold.plans.error_queries import KEYS, fits, window_rows
from quantfold.plans.hybrid_queries import hybrid_cands
from quantfold.plans.market import Market
from quantfold.plans.rating_queries import user_rating_input, user_stability, user_summary
from quantfold.plans.registry import query, tidy
from quantfold.plans.risk_queries import _spans


def _auto_n(m: Market) -> DataFrame:
    """Evaluation table of every rebalance date."""
    if m.stage.get("auto_n") is None:
        cut = m.stage.cut
        pool = cut(
            pf.top_ranked(hybrid_cands(m), ["grp"], an.POOL).select("grp", "stock_id")
        )
        obs, spans = risk.set_observations(m.panel, pool, _spans(m, risk.RRC_CALENDAR_DAYS))
        rrc = cut(risk.responsiveness(cut(obs), cut(spans), scope=("grp",), cut=cut))
        obs, spans = risk.set_observations(m.panel, pool, _spans(m, risk.SLS_CALENDAR_DAYS))
        sls = cut(risk.stop_loss(cut(obs), cut(spans), scope=("grp",), cut=cut))
        held, returns = hy.build(
            hybrid_cands(m),
            rrc,
            m.panel,
            _spans(m, est.LOOKBACK_CALENDAR),
            _spans(m, risk.SLS_CALENDAR_DAYS),
            an.MAX_N,
            sls=sls,
            cut=cut,
        )
        w = cut(an.prefixes(held))
        longer = est.trailing_returns(
            held.select("grp", "stock_id"), m.panel, _spans(m, an.STABILITY_CALENDAR), an.STABILITY_LOOKBACK
        )
        m.stage.plain("auto_n", an.benefit(an.evaluate(w, held, returns, cut(longer), sls, rrc)))
    return m.stage.get("auto_n")


@query("auto_n_evaluation", "H9 H10 A21 A22")
def auto_n_evaluation(m: Market) -> DataFrame:
    return tidy(_auto_n(m))


@query("auto_n_selection", "H11 H12")
def auto_n_selection(m: Market) -> DataFrame:
    return tidy(an.optimal_n(_auto_n(m)))


@query("auto_n_due", "R2")
def auto_n_due(m: Market) -> DataFrame:
    """Each rebalance date against a selection made two dates before or three dates after it."""
    w = Window.partitionBy(F.lit(0)).orderBy("reb_date")
    base = m.rebalances.select(
        F.col("reb_date").alias("as_of"), F.lag("reb_date", 2).over(w).alias("a"), F.lead("reb_date", 3).over(w).alias("b")
    )
    states = base.select("as_of", F.explode(F.array("a", "b")).alias("last_run"))
    return an.reselection_due(states)


def meta_scores(m: Market) -> DataFrame:
    """Stop-loss and responsiveness scores of the saved portfolios as assets."""
    if m.stage.get("meta_scores") is None:
        cut = m.stage.cut
        obs, span = mt.as_observations(user_curve(m))
        sls = risk.stop_loss(cut(obs), cut(span), scope=("grp",), display=False, cut=cut)
        rrc = st.portfolio_responsiveness(user_curve(m), st.mean_of_portfolios(user_curve(m)))
        m.stage.plain(
            "meta_scores",
            sls.select(F.col("stock_id").alias("portfolio"), "stop_loss_score").join(
                rrc.select("portfolio", "rrc_score"), "portfolio"
            ),
        )
    return m.stage.get("meta_scores")


@query("meta_asset_scores", "M1 K1")
def meta_asset_scores(m: Market) -> DataFrame:
    return tidy(meta_scores(m))


@query("meta_weights_search", "M1")
def meta_weights_search(m: Market) -> DataFrame:
    names = [r.portfolio for r in user_specs(m).select("portfolio").orderBy("portfolio").take(mt.MOST_PORTFOLIOS + 1)]
    return tidy(mt.searched_weights(user_curve(m), meta_scores(m), names))


def meta_weights(m: Market) -> DataFrame:
    return m.stage.get("meta_w") or m.stage.plain("meta_w", mt.heuristic_weights(user_summary(m)))


@query("meta_weights_heuristic", "M2")
def meta_weights_heuristic(m: Market) -> DataFrame:
    return tidy(meta_weights(m))


def meta_curve(m: Market) -> DataFrame:
    return m.stage.get("meta_c") or m.stage.plain("meta_c", mt.meta_curve(user_curve(m), meta_weights(m)))


@query("meta_portfolio_curve", "M3")
def meta_portfolio_curve(m: Market) -> DataFrame:
    return tidy(meta_curve(m).drop("idx"))


@query("meta_portfolio_metrics", "M3 U2")
def meta_portfolio_metrics(m: Market) -> DataFrame:
    """Metrics of the meta curve with its weighted stop-loss score and own responsiveness."""
    sls = meta_scores(m).join(F.broadcast(meta_weights(m)), "portfolio").agg(
        F.sum(F.col("weight") * F.col("stop_loss_score")).alias("meta_stop_loss_score")
    )
    rrc = st.portfolio_responsiveness(meta_curve(m), st.mean_of_portfolios(user_curve(m))).select("portfolio", "rrc_score")
    return tidy(bt.summary(meta_curve(m), population=True).join(rrc, "portfolio").join(F.broadcast(sls)))


def user_ratings(m: Market) -> DataFrame:
    rated = rt.composite_rating(user_rating_input(m))
    return rated.select("portfolio", (F.col("composite_score") / 100.0).alias("rating_score"))


@query("meta_winner", "M4")
def meta_winner(m: Market) -> DataFrame:
    meta = bt.summary(meta_curve(m), population=True)
    return tidy(mt.winner(mt.relative_rating(meta, user_summary(m)), user_ratings(m)))


@query("full_ratings_with_meta", "Q8 U2")
def full_ratings_with_meta(m: Market) -> DataFrame:
    """Saved portfolios and the meta row rated together (neutral defaults for what the meta row lacks)."""
    meta = bt.summary(meta_curve(m), population=True)
    row = rt.rating_input(meta, st.stability(meta_curve(m)))
    return tidy(rt.composite_rating(user_rating_input(m).unionByName(row, allowMissingColumns=True), display=False))


def stock_blend(m: Market) -> DataFrame:
    if m.stage.get("blend_w") is None:
        last = m.score_dates.agg(F.max("date").alias("score_date"))
        as_of = last.select(F.lit(0).alias("reb_no"), F.col("score_date").alias("reb_date"), "score_date")
        w = pf.strategy_weights(
            pf.candidates(m.last_scored, as_of, members(m)), user_specs(m).select("portfolio", "strategy", "top_n")
        )
        alloc = w.select("portfolio", "stock_id", F.col("weight").alias("stock_weight"))
        m.stage.plain("blend_w", mt.stock_blend(meta_weights(m), alloc))
    return m.stage.get("blend_w")


@query("meta_stock_blend", "M5")
def meta_stock_blend(m: Market) -> DataFrame:
    return tidy(stock_blend(m).join(m.stocks.select("stock_id", "symbol"), "stock_id", "left"))


@query("meta_stock_blend_winner", "M5")
def meta_stock_blend_winner(m: Market) -> DataFrame:
    """Blend held from the first rebalance to the last price date, rated against the saved portfolios."""
    period = m.rebalances.agg(F.min("reb_idx").alias("reb_idx"), F.max("end_idx").alias("end_idx")).withColumn(
        "reb_no", F.lit(1)
    )
    w = stock_blend(m).select(F.lit("stock_blend").alias("portfolio"), F.lit(1).alias("reb_no"), "stock_id", "weight")
    daily = bt.period_returns(w, period, m.panel)
    metrics = bt.summary(m.stage.cut(bt.equity_curve(daily)), population=True)
    out = mt.winner(mt.relative_rating(metrics, user_summary(m)), user_ratings(m))
    return tidy(out.join(metrics.select("portfolio", "cagr", "sharpe", "max_drawdown", "total_return"), "portfolio"))


@query("equal_blend_curve", "M6")
def equal_blend_curve(m: Market) -> DataFrame:
    return tidy(mt.blended_equally(user_curve(m)).drop("idx"))


def eq_weights(m: Market) -> DataFrame:
    return both_weights(m).where("portfolio = 'equal_weight'")


@query("walk_forward_split", "V1")
def walk_forward_split(m: Market) -> DataFrame:
    p = m.stage.cut(val.window_periods(val.split_windows(m.rebalances), m.rebalances, m.last_idx))
    return tidy(val.walk_forward(eq_weights(m), p, m.panel, m.stage.cut))


@query("walk_forward_rolling", "V2")
def walk_forward_rolling(m: Market) -> DataFrame:
    p = m.stage.cut(val.window_periods(val.rolling_windows(m.rebalances), m.rebalances, m.last_idx))
    return tidy(val.walk_forward(eq_weights(m), p, m.panel, m.stage.cut))


def _weightings(m: Market, key: str, rows) -> DataFrame:
    if m.stage.get(key) is None:
        m.stage.plain(
            key,
            val.weighting_backtests(m.rebalance_factors, rows, m.rebalances, m.panel, m.stage.cut),
        )
    return m.stage.get(key)


@query("weight_sensitivity", "V3 B9 D7")
def weight_sensitivity(m: Market) -> DataFrame:
    out = _weightings(m, "sens", val.sensitivity_weightings())
    return tidy(out.select("weighting", "cagr", "sharpe", "max_drawdown"))


@query("single_factor_tests", "V4 B9")
def single_factor_tests(m: Market) -> DataFrame:
    out = _weightings(m, "single", val.single_factor_weightings())
    return tidy(out.select("weighting", "cagr", "sharpe", "max_drawdown"))


@query("validation_report", "V5")
def validation_report(m: Market) -> DataFrame:
    eq = both_curve(m).where("portfolio = 'equal_weight'")
    return tidy(
        val.report_flags(
            walk_forward_split(m),
            _weightings(m, "sens", val.sensitivity_weightings()),
            _weightings(m, "single", val.single_factor_weightings()),
            bt.summary(eq),
            st.regime_cagr(eq),
        )
    )


def governance_input(m: Market) -> DataFrame:
    """Metrics of the saved portfolios with turnover, calm-regime CAGR, error R2 and sign flips."""
    turn = bt.turnover(user_weights(m), user_curve(m).select("portfolio", "reb_no")).where("seq > 1")
    monthly = turn.groupBy("portfolio").agg((F.avg("turnover") / 2).alias("monthly_turnover"))
    from quantfold.operators.error_model import coefficient_stability

    last = fits(m).groupBy().agg(F.max_by("r_squared", "window_end").alias("error_r2"))
    newest = fits(m).agg(F.max("window_end").alias("window_end"))
    flips = (
        coefficient_stability(window_rows(m), fits(m), KEYS)
        .join(F.broadcast(newest), "window_end")
        .agg(F.coalesce(F.sum(F.col("sign_flip_rate") * F.col("n_chunks")), F.lit(0.0)).alias("coefficient_flips"))
    )
    return (
        user_summary(m)
        .select("portfolio", "sharpe", "cagr", "volatility")
        .join(monthly, "portfolio")
        .join(st.regime_cagr(user_curve(m)).select("portfolio", "cagr_low_vol"), "portfolio")
        .join(user_stability(m).select("portfolio", "stability_score"), "portfolio")
        .join(F.broadcast(last))
        .join(F.broadcast(flips))
    )


@query("model_governance", "V6 V7 V8")
def model_governance(m: Market) -> DataFrame:
    out = gov.governance_score(gov.conservatism(gov.overfitting(governance_input(m))))
    return tidy(
        out.select(
            "portfolio",
            "overfitting_risk",
            F.array_join("overfit_flags", ",").alias("overfit_flags"),
            "overfit_penalty",
            "classification",
            "impact_score",
            F.array_join("conservative_flags", ",").alias("conservative_flags"),
            "conservative_penalty",
            "governance_score",
        )
    )


@query("quality_checks", "G6")
def quality_checks(m: Market) -> DataFrame:
    """Property checks of the pipeline's outputs as rows: (check, violations)."""
    from quantfold.plans.risk_queries import universe_rrc, universe_sls

    one = F.lit(1)

    def row(name: str, df: DataFrame, bad) -> DataFrame:
        return df.agg(F.lit(name).alias("check"), F.count(F.when(bad, one)).alias("violations"), F.count(one).alias("rows_checked"))

    shr = est.shrunk_returns(est.trailing_returns(hybrid_cands(m), m.panel, _spans(m, est.LOOKBACK_CALENDAR), universe=True), cut=m.stage.cut)
    lo, hi = F.least("sample_mean", "prior"), F.greatest("sample_mean", "prior")
    dense = fac.rank_summary(m.composites)
    return (
        row("stop_loss_in_range", universe_sls(m), ~F.col("stop_loss_score").between(0, 100))
        .unionByName(row("responsiveness_in_range", universe_rrc(m), ~F.col("rrc_score").between(0, 100)))
        .unionByName(row("shrinkage_bounded", shr, (F.col("mu") < lo - 1e-12) | (F.col("mu") > hi + 1e-12)))
        .unionByName(row("ranks_dense", dense, (F.col("top") != F.col("k")) | (F.col("low") != 1)))
        .unionByName(
            row(
                "weights_sum_to_one",
                both_weights(m).groupBy("portfolio", "reb_no").agg(F.sum("weight").alias("s")),
                F.abs(F.col("s") - 1) > 1e-9,
            )
        )
    )
