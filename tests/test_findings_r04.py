"""Cases from the findings of the fourth round."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantfold.operators import factors as fac
from quantfold.operators import signals as sig
from quantfold.plans.catalog import all_queries
from quantfold.plans.market import Market
from quantfold.plans.registry import QUERIES
from quantfold.sources import market as src
from quantfold.streaming import rescoring as rs
from quantfold.tables import Stage

all_queries()  # fills the registry

FEW_DATES = [
    "recommendation_texts",
    "top_stocks_filtered",
    "ranked_snapshot_sector",
    "latest_scores",
    "top_stocks",
    "score_engine_validation",
    "score_history",
    "score_trend",
    "score_upsert",
    "ranked_snapshot_latest",
    "ranked_snapshot_symbols",
    "latest_scoring_date",
    "factor_engine_validation",
    "table_health",
    "stock_summaries",
    "composite_scores_ranked",
]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def fresh(spark, sf_dir):
    return Market(spark, sf_dir)


@pytest.mark.parametrize("name", FEW_DATES)
def test_scores_of_every_day_are_not_staged(fresh, name):
    m = fresh
    assert QUERIES[name](m).count()
    assert m.stage.get("scored") is None and m.stage.get("raw_factors") is None


@pytest.fixture(scope="module")
def gaps(spark, sf_dir):
    """A market in which some stocks end early and others miss days."""
    m = Market(spark, sf_dir)
    last = m.last_idx
    ended = (F.col("stock_id") % 4 == 1) & (F.col("idx") > last - 40 * F.col("stock_id"))
    missing = (F.col("stock_id") % 4 == 2) & (F.col("idx") % 3 == 0)
    m.raw_factors = m.stage.bucketed("raw_factors", fac.raw_factors(m.panel).where(~(ended | missing)), "stock_id", ["stock_id", "idx"])
    return m


def test_newest_scores_of_stocks_that_end_early(gaps):
    want = sig.latest_scores(gaps.scored)
    assert want.select("date").distinct().count() > 1
    cols = ["stock_id", "date", "rank"]
    assert rows_of(sig.latest_scores(gaps.newest_scored).select(*cols)) == rows_of(want.select(*cols))


def test_ranks_of_chosen_rows_equal_ranks_of_whole_days(spark):
    rng = random.Random(6)
    rows = [(s, d, rng.randrange(-9, 9) / 10) for d in range(12) for s in range(40)]
    scored = spark.createDataFrame(rows, "stock_id long, date int, composite_score double")
    chosen = scored.where("stock_id % 7 = date % 5 AND date <> 3")
    want = fac.ranked(scored).join(chosen.select("stock_id", "date"), ["stock_id", "date"], "left_semi")
    cols = ["stock_id", "date", "composite_score", "rank"]
    assert rows_of(fac.ranks_of(chosen, scored).select(*cols)) == rows_of(want.select(*cols))


def test_history_of_stocks_that_end_early_or_miss_days(gaps):
    order = Window.partitionBy("stock_id").orderBy(F.desc("date"))
    want = gaps.scored.withColumn("k", F.row_number().over(order)).where("k <= 126").select("stock_id", "date", "rank")
    got = rows_of(QUERIES["score_history"](gaps).select("stock_id", "date", "rank"))
    assert got and got == rows_of(want)


def test_trends_of_stocks_that_end_early(gaps):
    got = rows_of(QUERIES["score_trend"](gaps))
    assert got and got == rows_of(sig.score_trend(gaps.scored, sig.latest_scores(gaps.scored)))


def test_a_close_corrected_to_zero_takes_its_scores_away(spark, tmp_path):
    rng = random.Random(7)
    first, rows = dt.date(2020, 1, 1), []
    for s in range(7):
        close = 100.0
        for d in range(300):
            close *= 1 + rng.uniform(-0.03, 0.03)
            rows.append((s, first + dt.timedelta(days=d), close, 1.0))
    schema = "stock_id long, date date, close double, volume double"
    store = rs.ScoreStore(spark, str(tmp_path / "store"))
    rs.apply_prices(store, spark.createDataFrame(rows, schema))
    before = store.scores().count()
    late = [(3, first + dt.timedelta(days=20), 0.0, 1.0)]
    rs.apply_prices(store, spark.createDataFrame(late, schema))
    prices = spark.createDataFrame([r for r in rows if r[:2] != late[0][:2]] + late, schema)
    panel = src.dense_panel(prices, src.trading_calendar(prices), 300)
    want = fac.scores(fac.normalised_factors(fac.raw_factors(panel)))
    cols = ["stock_id", "date", "rank"]
    got = rows_of(store.scores().select(*cols))
    assert got == rows_of(want.select(*cols)) and 0 < len(got) < before


def test_a_batch_is_dealt_out_by_day_once_and_leaves_no_staged_tables(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(rs, "Stage", lambda *a: made.append(Stage(*a)) or made[-1])
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=d), 100.0 + s + d % (s + 3), 1.0) for s in range(5) for d in range(260)]
    rs.apply_prices(rs.ScoreStore(spark, str(tmp_path / "s")), spark.createDataFrame(rows, "stock_id long, date date, close double, volume double"))
    assert made and not any(files for _, _, files in os.walk(made[0].root))
    assert sorted(os.listdir(tmp_path / "s")) == ["calendar", "closes", "prices", "scores"]


def test_ranks_are_summed_up_where_they_were_made(spark):
    rng = random.Random(8)
    rows = [(s, d, rng.randrange(-9, 9) / 10) for d in range(9) for s in range(30)]
    scored = spark.createDataFrame(rows, "stock_id long, date int, composite_score double")
    want = fac.ranked(scored).groupBy("date").agg(F.max("rank").alias("top"), F.count_distinct("composite_score").alias("k"), F.min("rank").alias("low"))
    got = fac.rank_summary(scored)
    assert rows_of(got) == rows_of(want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # scores are dealt out by date and range only, never by date and score
    assert "Exchange hashpartitioning(date" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "composite_score" in x]
