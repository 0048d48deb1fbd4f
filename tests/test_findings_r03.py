"""Cases from the findings of the third round."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck, rows_of
from quantfold.operators import risk


def assert_as_sql(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = duck(sf_dir).execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[1] and compare(got, want, tol=1e-6) is None


@pytest.mark.parametrize("name", ["hybrid_backtest_curve", "hybrid_backtest_summary"])
def test_hybrid_backtest_runs_from_an_empty_stage(spark, sf_dir, name):
    assert_as_sql(spark, sf_dir, name)


def fresh_market(spark, sf_dir):
    from quantfold.plans.market import Market

    return Market(spark, sf_dir)


def sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rebalance_queries_do_not_write_scores_of_every_day(spark, sf_dir):
    from quantfold.plans.core_queries import both_weights
    from quantfold.plans.risk_queries import top_stocks_with_risk
    from quantfold.plans.store_queries import rebalance_state
    from quantfold.plans.view_queries import single_stop_loss

    m = fresh_market(spark, sf_dir)
    assert both_weights(m).count() and top_stocks_with_risk(m).count() and single_stop_loss(m).count() and rebalance_state(m).count()
    assert m.stage.get("scored") is None and m.stage.get("raw_factors") is None


def test_scores_of_few_dates_equal_those_of_all(spark, sf_dir):
    m = fresh_market(spark, sf_dir)
    few, last = sorted_rows(m.rebalance_scored), sorted_rows(m.last_scored)
    cols = m.rebalance_scored.columns
    dates = m.rebalances.selectExpr("score_date AS date")
    assert few and [(r[0], r[1]) for r in few] == [(r[0], r[1]) for r in sorted_rows(m.scored.select(*cols).join(dates, "date", "left_semi").select(*cols))]
    all_ranks = {(r["stock_id"], r["date"]): r["rank"] for r in m.scored.collect()}
    at = [cols.index(c) for c in ("stock_id", "date", "rank")]
    assert last and all(all_ranks[r[at[0]], r[at[1]]] == r[at[2]] for r in few + last)


def test_buckets_grow_with_the_trade_lines(spark, sf_dir, monkeypatch):
    from quantfold import tables

    lines = spark.range(1000)
    assert tables.bucket_count(lines) == 4
    monkeypatch.setattr(tables, "BUCKET_LINES", 10)
    assert tables.bucket_count(lines) == 100


def test_returns_of_the_universe_equal_those_of_selected_names(spark, sf_dir):
    from quantfold.operators import estimators as est
    from quantfold.plans.hybrid_queries import hybrid_cands
    from quantfold.plans.risk_queries import _spans

    m = fresh_market(spark, sf_dir)
    names, spans = hybrid_cands(m).where("stock_id % 3 > 0"), _spans(m, est.LOOKBACK_CALENDAR)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for lookback in (90, None):
            a = est.trailing_returns(names, m.panel, spans, lookback, universe=True)
            assert sorted_rows(a) and sorted_rows(a) == sorted_rows(est.trailing_returns(names, m.panel, spans, lookback))
        plan = est.trailing_returns(names, m.panel, spans, universe=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # only the names are dealt out
    assert plan.count("Exchange hashpartitioning") <= 1 and "qf_panel" in plan


def test_places_in_a_window_from_places_in_the_day(spark, sf_dir):
    from quantfold.operators import error_model as em
    from quantfold.plans.error_queries import KEYS, observations, windows

    m = fresh_market(spark, sf_dir)
    whole = em.numbered(em.in_windows(observations(m), windows(m)), KEYS)
    once = em.numbered(em.in_windows(em.numbered_in_day(observations(m)), windows(m)), KEYS)
    cols = [*KEYS, "rebalance_date", "stock_id", "rn", "n"]
    assert sorted_rows(once.select(*cols)) == sorted_rows(whole.select(*cols))


def test_one_decimal_rounds_as_the_sql_does(spark):
    from pyspark.sql import functions as F

    from quantfold.functions.exprs import one_decimal

    values = [round(k * 0.05, 9) for k in range(2001)] + [0.049999999, 0.150000001, 12.25, 12.75, 99.95, 60.0, 1e-9, 100.0]
    con = duckdb.connect()
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(one_decimal(F.col("v"))).collect()]
    assert got == [con.execute("SELECT printf('%.1f', ?::DOUBLE)", [v]).fetchone()[0] for v in values]


def test_recovery_of_the_universe_equals_the_windowed_form_and_forms_no_rows_of_windows(spark):
    import random

    rng = random.Random(4)
    rows = []
    for stock in range(12):
        close = 100.0
        for idx in range(rng.choice([1, 1, 40, 300]), 701):
            close = close if rng.random() < 0.2 else round(close * (1 + rng.gauss(0, 0.02)), 2)
            rows.append((stock, idx, close))
    obs = spark.createDataFrame(rows, "stock_id long, idx int, close double")
    windows = spark.createDataFrame([(g, 1 + 3 * g, 20 + 40 * g) for g in range(18)], "grp int, lo_idx int, hi_idx int")
    got = risk._recovery_rows(obs, windows, ())
    sets = windows.select("grp").crossJoin(obs)
    want = risk._recovery_rows(sets, windows, ("grp",))
    key = lambda df: sorted(map(tuple, df.select("grp", "stock_id", "recovery_days").collect()))
    assert key(got) == key(want) and len({r[2] for r in key(got)}) > 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
