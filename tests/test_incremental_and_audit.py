"""Price-driven scores, window summaries, covariance rows and the audit against plain recomputations."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantfold.operators import error_model as em
from quantfold.operators import estimators as est
from quantfold.operators import factors as fac
from quantfold.operators import stability as st
from quantfold.sources import market as src
from quantfold.sources import writers as wr
from quantfold.streaming import rescoring as rs

DAY = dt.date(2020, 1, 1)


def batch_scores(prices):
    calendar = src.trading_calendar(prices)
    panel = src.dense_panel(prices, calendar, calendar.count())
    return {(r.stock_id, r.date): (round(r.composite_score, 9), r["rank"]) for r in fac.scores(fac.normalised_factors(fac.raw_factors(panel))).collect()}


def test_corrected_prices_give_the_scores_of_a_full_run(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for s in range(8):
        close = 100.0
        for d in range(330):
            close *= 1 + rng.uniform(-0.03, 0.03)
            if rng.random() < 0.9 and not (s == 7 and d < 40):
                rows.append((s, DAY + dt.timedelta(days=d), close, 1.0))
    schema = "stock_id long, date date, close double, volume double"
    old = [r for r in rows if r[1] < DAY + dt.timedelta(days=310) and r[:2] != (2, DAY + dt.timedelta(days=30))]
    wrong = [(s, d, c * 1.5 if (s, d) == (3, DAY + dt.timedelta(days=20)) else c, v) for s, d, c, v in old]
    store = rs.ScoreStore(spark, str(tmp_path / "store"))
    # repeats inside a batch: the largest close counts, whatever the order
    rs.apply_prices(store, spark.createDataFrame([*wrong, (wrong[0][0], wrong[0][1], wrong[0][2] / 2, 9.0)], schema))
    early = batch_scores(spark.createDataFrame(wrong, schema))
    read = lambda: {(r.stock_id, r.date): (round(r.composite_score, 9), r["rank"]) for r in store.scores().collect()}
    assert read() == early
    fresh = [r for r in rows if r not in wrong]
    for _ in range(2):  # a replay changes nothing
        rs.apply_prices(store, spark.createDataFrame(fresh, schema))
        got = read()
        assert got == batch_scores(spark.createDataFrame(rows, schema)) and got != early


def test_unions_of_ranges(spark):
    rng = random.Random(5)
    rows = [(k % 3, a, a + rng.randrange(6)) for k in range(40) for a in [rng.randrange(60)]]
    got = {(r.k, r.lo, r.hi) for r in rs.islands(spark.createDataFrame(rows, "k int, lo int, hi int"), ["k"]).collect()}
    want = set()
    for k in range(3):
        days = sorted({d for q, a, b in rows if q == k for d in range(a, b + 1)})
        start = [d for d in days if d - 1 not in days]
        want |= {(k, d, next(e for e in range(d, 99) if e + 1 not in days)) for d in start}
    assert got == want


@pytest.mark.parametrize("n", [70, 300, 530])
def test_rolling_drawdowns(spark, n):
    rng = np.random.default_rng(n)
    r = rng.normal(0, 0.02, n)
    rows = [("p", DAY + dt.timedelta(days=i), float(x)) for i, x in enumerate(r)]
    got = st.rolling_metrics(spark.createDataFrame(rows, "portfolio string, date date, daily_return double")).orderBy("date").collect()
    w = 252 if n >= 252 else n // 2
    want = []
    for i in range(w // 2 - 1, n):
        c = np.cumprod(1 + r[max(0, i - w + 1) : i + 1])
        want.append((c / np.maximum.accumulate(c) - 1).min())
    assert np.allclose([x.rolling_maxdd for x in got], want, atol=1e-12)


def test_correlations_of_a_period_without_pairs(spark):
    rng = np.random.default_rng(8)
    r = rng.normal(0, 0.01, (20, 5))
    panel = [(s, i + 1, float(r[i, s])) for i in range(20) for s in range(5) if (s, i) != (4, 3)]
    weights = spark.createDataFrame([("p", 1, s, 0.2) for s in range(5)], "portfolio string, reb_no int, stock_id int, weight double")
    periods = spark.createDataFrame([(1, 0, 20)], "reb_no int, reb_idx int, end_idx int")
    got = st.correlation_history(weights, periods, spark.createDataFrame(panel, "stock_id int, idx int, ret double")).first()
    c = np.corrcoef(r[:, :4].T)
    assert abs(got.avg_pairwise_corr - c[np.triu_indices(4, 1)].mean()) < 1e-12


def test_pivots_of_a_covariance(spark):
    rng = np.random.default_rng(9)
    r = rng.normal(0, 0.01, (40, 6))
    rows = [(1, s, i, float(r[i, s])) for i in range(40) for s in range(6)]
    entries = est.covariance_entries(spark.createDataFrame(rows, "grp int, stock_id int, idx int, ret double"))
    s = np.cov(r.T)
    want = 0.8 * s + 0.2 * np.trace(s) / 6 * np.eye(6)
    assert np.allclose([x.value for x in entries.orderBy("a", "b").collect()], want.ravel(), rtol=1e-12)
    pivots = est.covariance_pivots(entries)
    assert np.allclose([x.pivot_value for x in pivots.orderBy("position").collect()], np.diag(np.linalg.cholesky(want)) ** 2, rtol=1e-10)
    one = est.covariance_summary(entries, pivots).first()
    assert one.is_positive_definite and abs(one.log_det - np.linalg.slogdet(want)[1]) < 1e-8


def test_calibration_known_at_a_date(spark):
    dates = spark.createDataFrame([(1, DAY), (2, DAY + dt.timedelta(days=40)), (3, DAY + dt.timedelta(days=90))], "grp int, as_of date")
    history = spark.createDataFrame(
        [(DAY + dt.timedelta(days=40), 0.1, 1.0, 0.0, 0.0, 0.0), (DAY + dt.timedelta(days=80), 0.2, 2.0, 0.0, 0.0, 0.0)],
        "window_end date, intercept double, beta_momentum double, beta_quality double, beta_value double, beta_volatility double",
    )
    known = em.calibration_as_of(dates, history)
    assert {r.grp: r.intercept for r in known.collect()} == {1: None, 2: 0.1, 3: 0.2}
    scores = spark.createDataFrame([(g, 5, 0.5, None, 1.0, 1.0) for g in (1, 2, 3)], "grp int, stock_id int, momentum_score double, quality_score double, value_score double, volatility_score double")
    assert {r.grp: r.error_bias for r in em.calibrated_bias(scores, known).collect()} == {1: 0.0, 2: 0.6, 3: 1.2}
    mu = spark.createDataFrame([(g, 5, 2.0) for g in (1, 2, 3)], "grp int, stock_id int, mu double")
    assert {r.grp: r.mu for r in est.error_corrected(mu, scores, known).collect()} == {1: 2.0, 2: 1.4, 3: 0.8}


def test_a_late_row_fails_the_audit(spark):
    end = DAY + dt.timedelta(days=600)
    keys = ["window_start", "window_end"]
    rows = [(DAY, end, DAY + dt.timedelta(days=10), DAY + dt.timedelta(days=10), end), (DAY, end, end, end, end + dt.timedelta(days=30)), (DAY, end, DAY, DAY + dt.timedelta(days=1), DAY)]
    schema = "window_start date, window_end date, rebalance_date date, newest_source date, exit_date date"
    windows = spark.createDataFrame([(DAY, end)], "window_start date, window_end date")
    fit = windows.select(*keys, F.lit(40).alias("n_observations"), *[F.lit(0.1).alias(c) for c in ("r_squared", "mean_error", "residual_std")])
    stable = windows.select(*keys, F.lit(True).alias("stable"))
    oos = windows.select(*keys, F.lit(0.1).alias("delta_rmse"), F.lit(True).alias("improvement"))

    def look_ahead(part):
        audit = em.integrity_audit(spark.createDataFrame(part, schema), fit, windows, stable, oos, keys)
        return [(r.passed, r.value) for r in audit.collect() if r.check == "no_lookahead"]

    assert look_ahead(rows[:1]) == [(True, 0.0)] and look_ahead(rows) == [(False, 2.0)]


def test_history_filters(spark):
    rows = [(None, "t", "a", DAY, 1, 0.4), (None, "t", "a", DAY, 2, 0.6), (None, "t", "b", DAY + dt.timedelta(days=9), 1, 1.0)]
    stored = spark.createDataFrame(rows, "user_id long, portfolio_type string, portfolio_name string, rebalance_date date, stock_id int, weight double")
    places = {(r.portfolio_name, r.stock_id): r.position for r in wr.allocation_history(stored).collect()}
    assert places == {("a", 2): 1, ("a", 1): 2, ("b", 1): 1}
    assert wr.allocation_history(stored, since=DAY + dt.timedelta(days=1)).count() == 1
    assert wr.allocation_history(stored, until=DAY).count() == 2
    assert wr.allocation_history(stored, names=["b", "unknown"]).count() == 1 and wr.allocation_history(stored, names=[]).count() == 0
