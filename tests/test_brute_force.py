"""Scalable forms against the plain pandas computation, on skewed inputs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantfold.functions.ranking import pct_ranks, with_rank
from quantfold.operators import backtest as bt
from quantfold.operators import factors as fac
from quantfold.operators import hybrid as hy
from quantfold.operators import stability as st
from quantfold.sources import market as src


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(5)
    # one group holds most rows; many ties; some nulls
    g = np.where(rng.random(3000) < 0.6, "hot", rng.choice(list("abcdef"), 3000))
    v = np.round(rng.normal(size=3000), 1)
    pdf = pd.DataFrame({"id": range(3000), "g": g, "v": v})
    pdf.loc[rng.random(3000) < 0.05, "v"] = np.nan
    return pdf


@pytest.mark.parametrize("kind,method,desc", [("dense", "dense", True), ("min", "min", True), ("dense", "dense", False), ("min", "min", False)])
def test_ranks_match_pandas(spark, skewed, kind, method, desc):
    df = spark.createDataFrame(skewed).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = with_rank(df, ["g"], "v", out="r", kind=kind, descending=desc, pieces=7).toPandas().set_index("id")["r"]
    want = skewed.groupby("g")["v"].rank(method=method, ascending=not desc)
    assert np.array_equal(got.sort_index().to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_percent_ranks_match_pandas(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("u", -F.col("v"))
    got = pct_ranks(df, "g", "id", [("v", "up", False), ("u", "down", True)]).toPandas().set_index("id").sort_index()
    want = skewed.groupby("g")["v"].rank(pct=True)
    assert np.allclose(got["up"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)
    assert np.allclose(got["down"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def price_rows(spark, n_stocks=6, n_days=400, late=None, seed=2):
    rng = np.random.default_rng(seed)
    d0 = dt.date(2020, 1, 1)
    rows = []
    for s in range(n_stocks):
        p = 100 * np.exp(np.cumsum(rng.normal(5e-4, 0.02, n_days)))
        for i in range((late or {}).get(s, 0), n_days):
            if rng.random() < 0.8 or i == (late or {}).get(s, 0) or s == 0:
                rows.append((s, d0 + dt.timedelta(days=i), float(p[i]), 1.0))
    return pd.DataFrame(rows, columns=["stock_id", "date", "close", "volume"])


def dense(spark, pdf):
    prices = spark.createDataFrame(pdf)
    cal = src.trading_calendar(prices).persist()
    return src.dense_panel(prices, cal, cal.count()).persist(), cal


def test_panel_and_raw_factors_match_pandas(spark):
    pdf = price_rows(spark, late={3: 50})
    panel, _ = dense(spark, pdf)
    wide = pdf.pivot(index="date", columns="stock_id", values="close").sort_index().ffill()
    got = panel.toPandas().pivot(index="date", columns="stock_id", values="close").sort_index()
    assert np.allclose(got.to_numpy(), wide.to_numpy(), equal_nan=True)
    raw = fac.raw_factors(panel).toPandas()
    ret = wide.pct_change(fill_method=None)
    vol = ret.rolling(252, min_periods=252).std() * np.sqrt(252)
    m12 = wide / wide.shift(252) - 1
    want = pd.concat({"v": vol.stack(), "m": m12.stack()}, axis=1).dropna()
    have = raw.set_index(["date", "stock_id"]).sort_index()
    assert len(have) == len(want)
    assert np.allclose(have["volatility"], want.sort_index()["v"], rtol=1e-9)
    assert np.allclose(have["momentum_12m"], want.sort_index()["m"])


def test_average_correlation_with_late_stocks(spark):
    pdf = price_rows(spark, late={3: 120, 4: 200})
    panel, cal = dense(spark, pdf)
    w = spark.createDataFrame([("p", 1, s, 1 / 6) for s in range(6)], "portfolio string, reb_no int, stock_id long, weight double")
    span = spark.createDataFrame([("p", 10, 380)], "portfolio string, a int, b int")
    curve = span.select("portfolio", F.explode(F.sequence("a", "b")).alias("idx"))
    got = bt.average_pairwise_correlation(w, curve, panel).first()["avg_pairwise_corr"]
    wide = pdf.pivot(index="date", columns="stock_id", values="close").sort_index().ffill()
    c = wide.iloc[9:380].pct_change(fill_method=None).corr().to_numpy()
    assert got == pytest.approx(c[np.triu_indices(6, 1)].mean(), abs=1e-9)


def test_backtest_matches_a_loop(spark):
    pdf = price_rows(spark, n_days=130, late={5: 60})
    panel, cal = dense(spark, pdf)
    periods = [(1, 20, 50), (2, 50, 80), (3, 80, 130)]
    rng = np.random.default_rng(9)
    weights = {k: dict(zip(rng.choice(6, 3, replace=False).tolist(), [0.5, 0.3, 0.2])) for k, _, _ in periods}
    weights[2] = {}
    w = spark.createDataFrame(
        [("p", k, int(s), x) for k, ws in weights.items() for s, x in ws.items()], "portfolio string, reb_no int, stock_id long, weight double"
    )
    p = spark.createDataFrame(periods, "reb_no int, reb_idx int, end_idx int")
    got = bt.backtest(w, p, panel).orderBy("idx").toPandas()
    wide = pdf.pivot(index="date", columns="stock_id", values="close").sort_index().ffill()
    out, old = {}, {}
    for k, a, b in periods:
        if not weights[k]:
            continue
        r = wide.iloc[a - 1 : b].pct_change(fill_method=None).dropna(how="all")
        ws = pd.Series({s: x for s, x in weights[k].items() if wide.iloc[a - 1 : b][s].notna().any()})
        day = (r[ws.index] * (ws / ws.sum())).sum(axis=1)
        cost = 0.002 * sum(abs(weights[k].get(s, 0) - old.get(s, 0)) for s in set(weights[k]) | set(old))
        day.iloc[0] -= cost
        out.update(day.to_dict())
        old = weights[k]
    want = pd.Series(out).sort_index()
    assert np.allclose(got["daily_return"], want)
    cum = (1 + want).cumprod()
    assert np.allclose(got["drawdown"], (cum - cum.cummax()) / cum.cummax())


def test_rolling_metrics_match_pandas(spark):
    rng = np.random.default_rng(11)
    for n in (150, 400):
        r = pd.Series(rng.normal(3e-4, 0.01, n))
        d0 = dt.date(2020, 1, 1)
        df = spark.createDataFrame([("p", d0 + dt.timedelta(days=i), float(x)) for i, x in enumerate(r)], "portfolio string, date date, daily_return double")
        got = st.rolling_metrics(df).orderBy("date").toPandas()
        w = 252 if n >= 252 else n // 2
        roll = r.rolling(w, min_periods=w // 2)

        def mdd(x):
            c = np.cumprod(1 + x)
            return ((c - np.maximum.accumulate(c)) / np.maximum.accumulate(c)).min()

        assert np.allclose(got["rolling_sharpe"], (roll.mean() / roll.std() * np.sqrt(252)).dropna())
        assert np.allclose(got["rolling_maxdd"], roll.apply(mdd, raw=True).dropna())
        assert np.allclose(got["rolling_cagr"], (np.exp(np.log1p(r).rolling(w, min_periods=w // 2).sum()) ** (252 / w) - 1).dropna())


def test_greedy_selection_skips_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.01, (90, 3))
    cols = {1: base[:, 0], 2: base[:, 0] * 2, 3: base[:, 1], 4: base[:, 2], 5: -base[:, 1]}
    rows = [(1, s, i, float(v)) for s, x in cols.items() for i, v in enumerate(x)]
    ret = spark.createDataFrame(rows, "grp int, stock_id long, idx int, ret double")
    pool = spark.createDataFrame([(1, s, s) for s in (1, 2, 3, 4, 5, 6)], "grp int, stock_id long, position int")
    got = [r["stock_id"] for r in hy.uncorrelated_selection(pool, ret, 4).orderBy("pick").collect()]
    assert got == [1, 3, 4, 6]  # 2 copies 1, 5 mirrors 3, 6 has no data and comes last
