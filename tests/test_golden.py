"""Hand-computed values and limits of single operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantfold.functions import exprs as ex
from quantfold.functions import linalg
from quantfold.functions.ols import ols
from quantfold.operators import auto_n, error_model, estimators, factors, governance, meta, portfolio, rating, risk, signals, stability, tracker
from quantfold.tables import literal_rows


def frame(spark, pdf, schema=None):
    return spark.createDataFrame(pdf, schema) if schema else spark.createDataFrame(pdf)


def test_equal_factors_share_rank_one(spark):
    pdf = pd.DataFrame(
        [(i, dt.date(2026, 1, 1), 1.0, 0.0, 0.0, 0.0) for i in (1, 2, 3)],
        columns=["stock_id", "date", "quality_score", "growth_score", "momentum_score", "value_score"],
    )
    assert [r["rank"] for r in factors.scores(frame(spark, pdf)).collect()] == [1, 1, 1]


def test_one_hot_factors(spark):
    pdf = pd.DataFrame(
        [(1, dt.date(2026, 1, 1), 1.0, 0.0, 0.0, 0.0), (2, dt.date(2026, 1, 1), 0.0, 1.0, 0.0, 0.0), (3, dt.date(2026, 1, 1), 0.0, 0.0, 1.0, 0.0)],
        columns=["stock_id", "date", "quality_score", "growth_score", "momentum_score", "value_score"],
    )
    got = {r["stock_id"]: (round(r["composite_score"], 6), r["rank"]) for r in factors.scores(frame(spark, pdf)).collect()}
    assert got == {1: (0.30, 1), 2: (0.25, 2), 3: (0.25, 2)}


def test_few_stocks_on_a_date_are_skipped(spark):
    raw = pd.DataFrame(
        [(i, dt.date(2026, 1, d), float(i), 1.0, float(i * d)) for d, n in ((1, 4), (2, 5)) for i in range(n)],
        columns=["stock_id", "date", "momentum_6m", "momentum_12m", "volatility"],
    )
    out = factors.normalised_factors(frame(spark, raw)).toPandas()
    assert set(out["date"]) == {dt.date(2026, 1, 2)}
    # momentum_12m is constant: its z-score is 0, so the mean z comes from momentum_6m alone
    z = (np.arange(5) - 2) / np.std(np.arange(5), ddof=1)
    assert np.allclose(out.sort_values("stock_id")["momentum_score"], z / 2)


def test_shrinkage_by_hand(spark):
    rows = [(1, s, i, r) for s, rs in ((1, [0.01, 0.02, 0.03, 0.04]), (2, [-0.01, 0.0, -0.01, 0.0])) for i, r in enumerate(rs)]
    df = frame(spark, pd.DataFrame(rows, columns=["grp", "stock_id", "idx", "ret"]))
    got = {r["stock_id"]: r["mu"] for r in estimators.shrunk_returns(df).collect()}
    assert got[1] == pytest.approx(0.0109375, abs=1e-9) and got[2] == pytest.approx(0.0090625, abs=1e-9)


@pytest.mark.parametrize("t,k,want", [(90, 60, 0.6), (252, 60, 0.807692), (0, 60, 0.0), (10, 0, 1.0)])
def test_shrinkage_lambda(spark, t, k, want):
    got = spark.range(1).select(estimators.shrinkage_lambda(F.lit(t), k).alias("x")).first()["x"]
    assert got == pytest.approx(want, abs=1e-6)


def test_error_correction(spark):
    pred = frame(spark, pd.DataFrame({"grp": [1, 1], "stock_id": [1, 2], "mu": [0.10, 0.20]}))
    fac = frame(spark, pd.DataFrame({"grp": [1, 1], "stock_id": [1, 2], "momentum_score": [1.0, None]}))
    cal = literal_rows(
        spark,
        [(c, "double") for c in ("intercept", "beta_momentum", "beta_quality", "beta_value", "beta_volatility")],
        [(0.01, 0.02, 0.5, 0.5, 0.5)],
    )
    got = {r["stock_id"]: r["mu"] for r in estimators.error_corrected(pred, fac, cal).collect()}
    assert got[1] == pytest.approx(0.07) and got[2] == pytest.approx(0.19)
    same = {r["stock_id"]: r["mu"] for r in estimators.error_corrected(pred, fac, None).collect()}
    assert same == {1: 0.10, 2: 0.20}
    off = estimators.error_corrected(pred, fac, cal, enabled=False).collect()
    assert {r["stock_id"]: r["mu"] for r in off} == same


def test_covariance_edges():
    singular = np.array([[1.0, 1.0], [1.0, 1.0]])
    fixed, jitter = linalg.positive_definite(singular)
    assert jitter > 0 and np.linalg.eigvalsh(fixed).min() > 0
    # the steps add up: 1e-8 does not lift -5e-8, 1e-8 + 1e-7 does
    lifted, added = linalg.positive_definite(np.diag([1.0, -5e-8]))
    assert added == pytest.approx(1.1e-7) and lifted[1, 1] == pytest.approx(6e-8)
    one = linalg.robust_covariance(pd.DataFrame({"a": [0.01, -0.02, 0.03]}))
    assert one.matrix.shape == (1, 1) and one.matrix[0, 0] > 0
    rng = np.random.default_rng(42)
    x = pd.DataFrame(rng.normal(0, 0.02, (60, 5)))
    out = linalg.robust_covariance(x)
    s = x.cov().to_numpy()
    assert np.allclose(out.matrix, (0.8 * s + 0.2 * np.diag(s).mean() * np.eye(5)) * 252)
    assert 0 <= linalg.ledoit_wolf_intensity(x.to_numpy()) <= 1


def test_portfolio_variance_needs_no_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.02, (90, 4))
    w = np.array([0.4, 0.3, 0.2, 0.1])
    rows = pd.DataFrame([(1, s, t, x[t, s]) for t in range(90) for s in range(4)], columns=["grp", "stock_id", "idx", "ret"])
    weights = pd.DataFrame({"grp": 1, "stock_id": range(4), "weight": w})
    got = estimators.portfolio_moments(frame(spark, rows), frame(spark, weights), []).first()["expected_volatility"]
    cov = linalg.robust_covariance(pd.DataFrame(x)).matrix
    assert got == pytest.approx(math.sqrt(w @ cov @ w), rel=1e-9)


def test_ols_recovers_coefficients(spark):
    rng = np.random.default_rng(7)
    x1, x2 = rng.normal(size=200), rng.normal(size=200)
    y = 0.01 + 0.5 * x1 - 0.2 * x2 + rng.normal(0, 0.01, 200)
    pdf = pd.DataFrame({"g": 1, "a_score": x1, "b_score": x2, "z_score": 0.0, "y": y})
    r = ols(frame(spark, pdf), ["g"], "y", ["a_score", "b_score", "z_score"]).first()
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(200), x1, x2]), y, rcond=None)
    assert r["intercept"] == pytest.approx(beta[0], abs=1e-9)
    assert r["beta_a"] == pytest.approx(beta[1], abs=1e-9) and r["beta_b"] == pytest.approx(beta[2], abs=1e-9)
    assert r["beta_z"] == 0.0 and r["r_squared"] > 0.99
    few = ols(frame(spark, pdf.head(5)), ["g"], "y", ["a_score", "b_score", "z_score"]).first()
    assert few["intercept"] is None and few["n"] == 5


@pytest.mark.parametrize("score,want", [(50.0, 0.0), (100.0, 0.021), (0.0, -0.021)])
def test_score_proxy(spark, score, want):
    got = spark.range(1).select(estimators.predicted_from_score(F.lit(score)).alias("x")).first()["x"]
    assert got == pytest.approx(want)


@pytest.mark.parametrize(
    "new,old,w,want", [(0.4, 0.2, 0.6, 0.32), (0.4, 0.2, 1.0, 0.4), (0.4, 0.2, 0.0, 0.2), (None, 0.2, 0.6, 0.2), (0.4, None, 0.6, 0.4)]
)
def test_blend(spark, new, old, w, want):
    c = error_model.blend(F.lit(new).cast("double"), F.lit(old).cast("double"), w)
    assert spark.range(1).select(c.alias("x")).first()["x"] == pytest.approx(want)


@pytest.mark.parametrize(
    "a,b,want", [("2023-01-15", "2023-07-15", 6.0), ("2023-01-01", "2023-01-01", 0.0), ("2023-02-01", "2023-01-01", -1.0), ("2020-01-01", "2025-01-16", 60.5)]
)
def test_months_between(spark, a, b, want):
    c = ex.months_between_30(F.lit(a).cast("date"), F.lit(b).cast("date"))
    assert spark.range(1).select(c.alias("x")).first()["x"] == pytest.approx(want)


def walk(spark, series):
    rows = []
    for sid, p in series.items():
        p = np.asarray(p, dtype=float)
        for i, v in enumerate(p):
            rows.append((1, sid, i + 1, float(v), None if i == 0 else float(v / p[i - 1] - 1)))
    n = max(len(p) for p in series.values())
    obs = spark.createDataFrame(rows, "grp int, stock_id long, idx int, close double, ret double")
    return obs, spark.createDataFrame([(1, 1, n)], "grp int, lo_idx int, hi_idx int")


def test_stop_loss_crash_and_rally(spark):
    n = 260
    obs, span = walk(spark, {1: np.linspace(100, 50, n), 2: np.linspace(100, 150, n)})
    bias = spark.createDataFrame([(1, 1, 0.05), (1, 2, -0.05)], "grp int, stock_id long, error_bias double")
    got = {r["stock_id"]: r for r in risk.stop_loss(obs, span, scope=("grp",), error_bias=bias).collect()}
    assert got[1]["mom_score"] == 100 and got[2]["mom_score"] == 0
    assert got[1]["err_score"] == 50 and got[2]["err_score"] == 0
    assert got[1]["dd_score"] > got[2]["dd_score"]
    assert 0 <= got[2]["stop_loss_score"] < got[1]["stop_loss_score"] <= 100


def test_responsiveness_needs_half_a_year(spark):
    obs, span = walk(spark, {1: np.linspace(100, 90, 100), 2: np.linspace(100, 120, 100)})
    assert {r["rrc_score"] for r in risk.responsiveness(obs, span, scope=("grp",)).collect()} == {50.0}


def test_constant_prices_do_not_fail(spark):
    obs, span = walk(spark, {1: np.full(200, 10.0), 2: np.full(200, 20.0)})
    out = risk.stop_loss(obs, span, scope=("grp",)).collect()
    assert len(out) == 2 and all(r["dd_score"] == 0 and r["var_score"] == 0 for r in out)


def curve(spark, values, name="p"):
    d0 = dt.date(2020, 1, 1)
    rows = [(name, i, d0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "portfolio string, idx int, date date, daily_return double")


def test_stability_edges(spark):
    short = stability.stability(curve(spark, [0.01] * 50)).first()
    assert short["stability_score"] == 0 and short["data_sufficiency"] == "insufficient" and short["grade"] == "N/A"
    flat = stability.stability(curve(spark, [0.0] * 200)).first()
    assert flat["data_sufficiency"] == "limited" and 0 <= flat["stability_score"] <= 100


def test_governance_values(spark):
    bad = pd.DataFrame([("x", 3.5, 0.7, 0.9, 5.0, 0.05, 0.2, 0.04)], columns=["portfolio", "sharpe", "monthly_turnover", "error_r2", "coefficient_flips", "volatility", "beta", "cagr"])
    out = governance.conservatism(governance.overfitting(frame(spark, bad))).first()
    assert out["overfitting_risk"] == "High" and len(out["overfit_flags"]) == 4
    assert out["classification"] == "Overly Conservative Model"
    good = pd.DataFrame([("x", 1.5, 0.2, 0.2, 0.0, 0.15, 1.0, 0.15)], columns=bad.columns)
    out = governance.conservatism(governance.overfitting(frame(spark, good))).first()
    assert out["overfitting_risk"] == "Low" and out["classification"] == "Balanced"
    points = pd.DataFrame([(5, 3, 80.0)], columns=["overfit_penalty", "conservative_penalty", "stability_score"])
    assert governance.governance_score(frame(spark, points)).first()["governance_score"] == pytest.approx(88.0)


def test_rating_bounds(spark):
    rows = pd.DataFrame(
        [("a", 1.2, 0.2, -0.1, 0.15, 2.0, 70.0, "B", 0.5, 0.4, 60.0), ("b", 0.5, 0.1, -0.3, 0.2, 0.3, 50.0, "C", 1.0, 0.5, 50.0), ("c", 3.0, 0.4, -0.05, 0.1, 8.0, 100.0, "A", 0.0, 0.2, 100.0)],
        columns=["portfolio", "sharpe", "cagr", "max_drawdown", "volatility", "calmar", "stability_score", "stability_grade", "regime_sharpe_gap", "avg_pairwise_corr", "rrc_score"],
    )
    got = {r["portfolio"]: r for r in rating.composite_rating(frame(spark, rows)).collect()}
    assert got["c"]["composite_score"] == 100 and got["c"]["grade"] == "A+" and got["c"]["rank"] == 1
    assert [got[p]["rank"] for p in "cab"] == [1, 2, 3]


def test_portfolio_correlation_diagonal(spark):
    both = curve(spark, [0.01, -0.005, 0.002], "A").unionByName(curve(spark, [0.009, -0.004, 0.003], "B"))
    got = {(r["portfolio_a"], r["portfolio_b"]): r["correlation"] for r in rating.portfolio_correlation(both).collect()}
    assert got[("A", "A")] == pytest.approx(1) and got[("A", "B")] == pytest.approx(np.corrcoef([0.01, -0.005, 0.002], [0.009, -0.004, 0.003])[0, 1])


def test_meta_weights_bounds(spark):
    m = spark.createDataFrame([("a", 2.0), ("b", 0.1), ("c", -1.0)], "portfolio string, sharpe double")
    w = {r["portfolio"]: r["weight"] for r in meta.heuristic_weights(m).collect()}
    assert sum(w.values()) == pytest.approx(1) and w["c"] == 0
    # clipped to 0.6 and renormalised once
    assert w["a"] == pytest.approx(0.6 / (0.6 + 0.1 / 2.1))


def test_meta_search_beats_the_heuristic(spark):
    rng = np.random.default_rng(3)
    c = None
    for p, mu in (("a", 0.002), ("b", 0.0005), ("c", -0.001)):
        one = curve(spark, rng.normal(mu, 0.01, 200), p)
        c = one if c is None else c.unionByName(one)
    scores = spark.createDataFrame([(p, 20.0, 60.0) for p in "abc"], "portfolio string, stop_loss_score double, rrc_score double")
    out = meta.searched_weights(c, scores, ["a", "b", "c"]).collect()
    assert sum(r["weight"] for r in out) == pytest.approx(1) and max(r["weight"] for r in out) <= 0.6 + 1e-9
    assert {r["portfolio"]: r["weight"] for r in out}["a"] == pytest.approx(0.6)


def test_n_benefit_is_sixty_percent(spark):
    rows = [(1, n, 1.0, 0.15, 0.5, 0.0, 0.0, 100.0, 50.0) for n in range(10, 31, 2)]
    cols = "grp int, n int, sharpe_raw double, exp_vol double, avg_corr double, top_3_weight double, sls_agg double, rrc_agg double, stability_score double"
    t = auto_n.benefit(spark.createDataFrame(rows, cols))
    last = t.where("n = 30").first()
    assert last["portfolio_benefit"] == pytest.approx(0.60)
    assert auto_n.optimal_n(t).first()["optimal_n"] == 30


def test_tracker_valuation(spark):
    stocks = spark.createDataFrame([(1, "TCS"), (2, "INFY")], "stock_id long, symbol string")
    prices = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), 3500.0), (1, dt.date(2024, 1, 2), 3600.0), (2, dt.date(2024, 1, 1), 1500.0)],
        "stock_id long, date date, close double",
    )
    raw = spark.createDataFrame(
        [(1, " tcs ", "9", "9", 1), (1, "TCS", "10000", "3", 2), (1, "infy", "5000", "2", 3), (1, "BAD", "x", "2", 4), (1, "NEG", "5", "-1", 5)],
        "user_id long, symbol string, invested_amount string, quantity string, pos int",
    )
    pos = tracker.normalise_positions(raw, order="pos")
    v = tracker.valuation(pos, tracker.latest_prices(prices, stocks))
    got = {r["symbol"]: r["current_amount"] for r in v.collect()}
    assert got == {"TCS": 10800.0, "INFY": 3000.0}
    s = tracker.valuation_summary(v).first()
    assert (s["total_invested"], s["total_current"], s["total_pnl"], s["priced_positions"]) == (15000.0, 13800.0, -1200.0, 2)
    live = spark.createDataFrame([("TCS", 3700.0, dt.date(2024, 1, 3))], "symbol string, current_price double, price_date date")
    o = {r["symbol"]: r for r in tracker.valuation(pos, tracker.latest_prices(prices, stocks), live).collect()}
    assert o["TCS"]["current_amount"] == 11100.0 and o["TCS"]["price_source"] == "live" and o["INFY"]["price_source"] == "database"


@pytest.mark.parametrize("rank,n,want", [(1, 100, 5), (20, 100, 5), (21, 100, 5), (100, 100, 1), (None, 100, 3), (3, 0, 3)])
def test_signal_strength(spark, rank, n, want):
    c = signals.strength(F.lit(rank).cast("int"), F.lit(n))
    assert spark.range(1).select(c.alias("x")).first()["x"] == want


def test_recommendation_overrides(spark):
    rows = [(1, 90.0, 1, 5, "improving", "low_vol", "Buy", 85.0), (2, 90.0, 1, 5, "improving", "low_vol", "Buy", 65.0), (3, 90.0, 1, 5, "improving", "low_vol", "Buy", 10.0)]
    s = spark.createDataFrame(rows, "stock_id long, composite_score double, rank int, signal_strength int, trend_direction string, regime string, recommendation string, stop_loss_score double")
    got = {r["stock_id"]: (r["recommendation"], r["conviction"], r["allocation_max"]) for r in signals.recommendations(s, {"moderate": (0.0, 0.10)}).collect()}
    assert got[1] == ("Exit", "Low", 0.0)
    assert got[2][0] == "Hold" and got[2][2] == pytest.approx(0.04)
    assert got[3] == ("Buy", "High", 0.10)


def test_portfolios_of_any_size(spark):
    rows = [(1, dt.date(2024, 1, 31), i, i, 0.1) for i in range(1, 81)]
    cands = spark.createDataFrame(rows, "reb_no int, reb_date date, stock_id long, rank int, volatility_score double")
    assert portfolio.strategy_weights(cands, [("big", "equal_weight", 60), ("small", "equal_weight", 5)]).groupBy("portfolio").count().orderBy("portfolio").collect() == [("big", 60), ("small", 5)]
    specs = spark.createDataFrame([("big", "equal_weight", 60)], "portfolio string, strategy string, top_n int")
    own = cands.withColumn("portfolio", F.lit("big"))
    assert portfolio.strategy_weights(own, specs).count() == 60
