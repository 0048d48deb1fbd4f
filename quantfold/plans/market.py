"""The base tables of one data folder, staged once per session."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantfold.operators import factors as fac
from quantfold.operators import portfolio as pf
from quantfold.sources import market as src
from quantfold.tables import Stage, bounded, bucket_count, spread


class Market:
    """Lazily staged prices -> panel -> factors -> scores -> rebalance calendar.

    Stock-keyed tables are bucketed on ``stock_id``; date-keyed ones are written
    in date ranges. Everything downstream reads these tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        # joins on stock and day then read the panel's buckets as they are and deal out the other side by stock only
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.sf_dir = sf_dir.rstrip("/")
        self.stage = Stage(spark, self.sf_dir.rsplit("/", 1)[-1], bucket_count(self.table("lineitem")))

    def table(self, name: str) -> DataFrame:
        return src.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def stocks(self) -> DataFrame:
        return src.stocks(self.spark, self.sf_dir)

    @cached_property
    def prices(self) -> DataFrame:
        trades = spread(src.daily_trades(self.spark, self.sf_dir), self.stage.buckets, "stock_id")
        return self.stage.bucketed("prices", src.sparse_prices(trades), "stock_id", ["stock_id", "date"])

    @cached_property
    def calendar(self) -> DataFrame:
        return self.stage.plain("calendar", src.trading_calendar(self.prices))

    @cached_property
    def last_idx(self) -> int:
        return int(self.calendar.agg(F.max("idx")).first()[0] or 0)

    @cached_property
    def panel(self) -> DataFrame:
        dense = src.dense_panel(self.prices, self.calendar, self.last_idx)
        return self.stage.bucketed("panel", dense, "stock_id", ["stock_id", "idx"])

    @cached_property
    def raw_factors(self) -> DataFrame:
        return self.stage.bucketed("raw_factors", fac.raw_factors(self.panel), "stock_id", ["stock_id", "idx"])

    @property
    def factor_rows(self) -> DataFrame:
        """Raw factors as they are staged, else computed from the panel's buckets without writing every day."""
        return self.raw_factors if self.stage.get("raw_factors") is not None else fac.raw_factors(self.panel)

    @cached_property
    def factor_stats(self) -> DataFrame:
        return self.stage.plain("factor_stats", fac.cross_section_stats(self.factor_rows))

    @cached_property
    def factors(self) -> DataFrame:
        return fac.normalised_factors(self.raw_factors, self.factor_stats)

    @cached_property
    def scored(self) -> DataFrame:
        return self.stage.ranged("scored", fac.scores(self.factors), "date", ["rank", "stock_id"])

    @property
    def scored_rows(self) -> DataFrame:
        """``scored`` as it is staged, else ranked without writing every day."""
        return self.scored if self.stage.get("scored") is not None else fac.scores(fac.normalised_factors(self.factor_rows, self.factor_stats))

    def _factors_on(self, dates: DataFrame) -> DataFrame:
        return fac.normalised_factors(self.factor_rows.join(F.broadcast(dates), "date", "left_semi"), self.factor_stats)

    @cached_property
    def rebalance_factors(self) -> DataFrame:
        """``factors`` on the score dates of the rebalances; the other days are not written."""
        dates = self.rebalances.select(F.col("score_date").alias("date")).distinct()
        return self.stage.plain("factors_reb", self._factors_on(dates))

    @cached_property
    def rebalance_scored(self) -> DataFrame:
        """``scored`` on the score dates of the rebalances: each date is ranked by itself, so no other day is."""
        return self.stage.plain("scored_reb", fac.scores(self.rebalance_factors))

    @cached_property
    def last_scored(self) -> DataFrame:
        """``scored`` on the last score date."""
        return self.stage.plain("scored_last", self.scores_on(self.score_dates.agg(F.max("date").alias("date"))))

    @property
    def composites(self) -> DataFrame:
        """Factors and composite score of every stock and score date in the panel's buckets, neither ranked nor written."""
        return fac.composites(fac.normalised_factors(self.factor_rows, self.factor_stats))

    @property
    def dated_factors(self) -> DataFrame:
        """Raw factors of the score dates."""
        return self.factor_rows.join(bounded(self.score_dates), "date", "left_semi")

    def scores_on(self, dates: DataFrame) -> DataFrame:
        """``scored`` on some score dates: each date is ranked by itself."""
        return fac.scores(self._factors_on(dates))

    @cached_property
    def newest_dates(self) -> DataFrame:
        """Newest score date of each stock."""
        return self.stage.plain("newest_dates", self.dated_factors.groupBy("stock_id").agg(F.max("date").alias("date")))

    @cached_property
    def newest_scored(self) -> DataFrame:
        """``scored`` on the dates that are the newest of some stock (all stocks of these dates)."""
        return self.stage.plain("scored_newest", self.scores_on(self.newest_dates.select("date").distinct()))

    @cached_property
    def score_dates(self) -> DataFrame:
        return self.factor_stats.where(F.col("n_stocks") >= fac.MIN_STOCKS).select("date")

    @cached_property
    def rebalances(self) -> DataFrame:
        return self.stage.plain("rebalances", pf.rebalance_calendar(self.calendar, self.score_dates))

    @cached_property
    def last_score_date(self):
        return self.score_dates.agg(F.max("date")).first()[0]


_MARKETS: dict[tuple[str, str], Market] = {}


def market(spark: SparkSession, sf_dir: str) -> Market:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MARKETS:
        _MARKETS[key] = Market(spark, sf_dir)
    return _MARKETS[key]
