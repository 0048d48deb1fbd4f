"""Writers are idempotent; streams drop repeats and late rows."""

import datetime as dt

from pyspark.sql import functions as F

from quantfold import schema
from quantfold.sources import writers as wr
from quantfold.streaming import ingest


def test_schema_is_typed():
    assert [f.name for f in schema.SCORES] == ["stock_id", "date", "composite_score", "rank"]


def test_allocation_append_twice(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "auto_hybrid", None, dt.date(2023, 1, 31), 101, 0.6), (1, "auto_hybrid", None, dt.date(2023, 1, 31), 102, 0.4)],
        "user_id long, portfolio_type string, portfolio_name string, rebalance_date date, stock_id long, weight double",
    )
    keys = ["user_id", "portfolio_type", "portfolio_name", "rebalance_date", "stock_id"]
    path = str(tmp_path / "alloc")
    assert wr.write_new(spark, path, rows, keys) == (2, 0)
    assert wr.write_new(spark, path, rows, keys) == (0, 2)


def test_replace_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, x int")
    wr.write_partitions(a, path, ["day"])
    wr.write_partitions(spark.createDataFrame([("d2", 9)], "day string, x int"), path, ["day"])
    assert {(r["day"], r["x"]) for r in spark.read.parquet(path).collect()} == {("d1", 1), ("d2", 9)}


def test_portfolio_and_position_rewrites(spark):
    m = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "Z")], "portfolio string, symbol string")
    saved = wr.save_portfolio(m, "a", spark.createDataFrame([("a", "Q")], m.schema))
    assert {tuple(r) for r in saved.collect()} == {("a", "Q"), ("b", "Z")}
    assert {tuple(r) for r in wr.delete_portfolio(m, "a").collect()} == {("b", "Z")}
    stored = spark.createDataFrame([(None, 1, "X", 1.0, 1.0), (7, 1, "X", 1.0, 1.0)], "user_id long, stock_id long, symbol string, invested_amount double, quantity double")
    pos = spark.createDataFrame([("NEW", 5.0, 2.0)], "symbol string, invested_amount double, quantity double")
    stocks = spark.createDataFrame([("X", 1)], "symbol string, stock_id long")
    out = wr.save_positions(stored, pos, stocks, None).collect()
    assert {(r["user_id"], r["symbol"], r["stock_id"]) for r in out} == {(7, "X", 1), (None, "NEW", None)}


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "window_id int, train_sharpe double")
    wr.write_report({"walk_forward": df}, df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "walk_forward")).count() == 1
    assert spark.read.json(str(tmp_path / "r" / "summary")).first()["train_sharpe"] == 2.0


def test_price_stream_survives_a_replay(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, dt.date(2024, 1, 1), 10.0), (1, dt.date(2024, 1, 1), 10.0), (1, dt.date(2024, 1, 2), 11.0)]
    df = spark.createDataFrame(rows, "stock_id long, date date, close double")
    df.write.parquet(src)
    for run in (1, 2):  # the second run has lost its checkpoint
        s = ingest.file_stream(spark, src, df.schema)
        ingest.append_prices(s, table, str(tmp_path / f"cp{run}")).awaitTermination()
    assert spark.read.parquet(table).count() == 2


def test_price_stream_takes_history_later(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda m, d: dt.date(2024, m, d)
    batches = [[day(3, 1), day(3, 4)], [day(1, 5), day(1, 8), day(3, 4)], [day(3, 5), day(1, 5)]]
    for days in batches:
        df = spark.createDataFrame([(1, d, 10.0) for d in days], "stock_id long, date date, close double")
        df.coalesce(1).write.mode("append").parquet(src)
        ingest.append_prices(ingest.file_stream(spark, src, df.schema), table, str(tmp_path / "cp")).awaitTermination()
    got = sorted(r["date"] for r in spark.read.parquet(table).collect())
    assert got == sorted({d for days in batches for d in days})


def test_late_ticks_do_not_reopen_a_day(spark, tmp_path):
    src, table, cp = (str(tmp_path / x) for x in ("ticks", "bars", "cp"))
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    cols = "event_id long, ts timestamp, user_id long, value double"
    spark.createDataFrame([(1, t(1, 1), 1, 5.0), (2, t(1, 9), 1, 7.0), (3, t(5, 1), 1, 1.0)], cols).coalesce(1).write.mode("append").parquet(src)
    schema_ = spark.read.parquet(src).schema
    ingest.write_bars(ingest.file_stream(spark, src, schema_), table, cp, "user_id", "value").awaitTermination()
    spark.createDataFrame([(4, t(1, 12), 1, 99.0), (5, t(9, 1), 1, 2.0)], cols).coalesce(1).write.mode("append").parquet(src)
    ingest.write_bars(ingest.file_stream(spark, src, schema_), table, cp, "user_id", "value").awaitTermination()
    got = {r["date"].day: (r["open"], r["high"], r["close"], r["volume"]) for r in spark.read.parquet(table).collect()}
    assert got[1] == (5.0, 7.0, 7.0, 2) and got[5] == (1.0, 1.0, 1.0, 1) and 9 not in got
