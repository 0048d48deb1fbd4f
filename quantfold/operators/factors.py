"""Raw factors, cross-sectional z-scores, composite scores and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions.exprs import SQRT_YEAR
from quantfold.functions.ranking import with_rank
from quantfold.tables import bounded

MOMENTUM_SHORT = 126
MOMENTUM_LONG = 252
VOL_WINDOW = 252
MIN_STOCKS = 5
FACTOR_WEIGHTS = {"quality": 0.30, "growth": 0.25, "momentum": 0.25, "value": 0.20}
# typical size of a composite of z-scores, which only balances the ranking ranges
SCORE_SCALE = 0.3
RAW = ["momentum_6m", "momentum_12m", "volatility"]


def raw_factors(panel: DataFrame) -> DataFrame:
    """6- and 12-month momentum and annualised 252-day volatility for every stock and day.

    The 252-row deviation comes from running sums and their lag: two passes over
    the same sorted partition instead of a 252-row rescan per row.
    """
    w = Window.partitionBy("stock_id").orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = panel.select(
        "stock_id",
        "idx",
        "date",
        "close",
        F.try_divide("close", F.lag("close", MOMENTUM_SHORT).over(w)).alias("g6"),
        F.try_divide("close", F.lag("close", MOMENTUM_LONG).over(w)).alias("g12"),
        F.count("ret").over(upto).alias("n"),
        F.coalesce(F.sum("ret").over(upto), F.lit(0.0)).alias("s1"),
        F.coalesce(F.sum(F.col("ret") * F.col("ret")).over(upto), F.lit(0.0)).alias("s2"),
    )

    def tail(c: str) -> Column:
        return F.col(c) - F.coalesce(F.lag(c, VOL_WINDOW).over(w), F.lit(0))

    n = F.lit(float(VOL_WINDOW))
    var = (F.col("t2") - F.col("t1") * F.col("t1") / n) / (n - 1)
    return (
        sums.select("stock_id", "idx", "date", "g6", "g12", tail("n").alias("tn"), tail("s1").alias("t1"), tail("s2").alias("t2"))
        .select(
            "stock_id",
            "idx",
            "date",
            (F.col("g6") - 1).alias("momentum_6m"),
            (F.col("g12") - 1).alias("momentum_12m"),
            F.when(F.col("tn") >= VOL_WINDOW, F.sqrt(F.greatest(var, F.lit(0.0))) * F.lit(SQRT_YEAR)).alias("volatility"),
        )
        .dropna(how="any", subset=RAW)
    )


def cross_section_stats(raw: DataFrame) -> DataFrame:
    """Mean, sample deviation and stock count per date (partial aggregation, one row per day)."""
    aggs = [F.count(F.lit(1)).alias("n_stocks")]
    for c in RAW:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return raw.groupBy("date").agg(*aggs)


def normalised_factors(raw: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Z-score each raw factor within its date; dates with fewer than five stocks are skipped.

    The moments are aggregated per date and broadcast back (one row per trading
    day), so the panel is not shuffled by date.
    """
    stats = cross_section_stats(raw) if stats is None else stats
    return raw.join(bounded(stats.where(F.col("n_stocks") >= MIN_STOCKS)), "date").select("stock_id", "date", *_factor_scores())


def _factor_scores() -> list[Column]:
    """The factor scores of rows that carry the moments of their date."""

    def z(c: str) -> Column:
        return F.when(F.col(f"std_{c}") > 0, (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).otherwise(F.lit(0.0))

    return [
        F.lit(0.0).alias("value_score"),
        F.lit(0.0).alias("quality_score"),
        F.lit(0.0).alias("growth_score"),
        ((z("momentum_6m") + z("momentum_12m")) / 2).alias("momentum_score"),
        (F.lit(-1.0) * z("volatility")).alias("volatility_score"),
    ]


def scores_by_day(raw: DataFrame) -> DataFrame:
    """Raw factors with scores and dense rank, all from one exchange: for tables that are written by day.

    A day is one task's file there anyway, so it is measured and ranked in that task. Rows of days with
    fewer than five stocks are kept without scores.
    """
    day = Window.partitionBy("date")
    moments = [F.count(F.lit(1)).over(day).alias("n_stocks")]
    for c in RAW:
        moments += [F.avg(c).over(day).alias(f"mean_{c}"), F.stddev_samp(c).over(day).alias(f"std_{c}")]
    rows = raw.select("stock_id", "date", *RAW).repartition("date").select("*", *moments)
    scored = composites(rows.select("stock_id", "date", *RAW, "n_stocks", *_factor_scores()))
    out = scored.withColumn("rank", F.dense_rank().over(day.orderBy(F.desc("composite_score"))))
    made = [c for c in out.columns if c not in ("stock_id", "date", *RAW, "n_stocks")]
    return out.select("stock_id", "date", *RAW, *[F.when(F.col("n_stocks") >= MIN_STOCKS, F.col(c)).alias(c) for c in made])


def composite(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the factor scores, missing factors as zero."""
    weights = weights or FACTOR_WEIGHTS
    terms = [F.lit(float(w)) * F.coalesce(F.col(f"{k}_score"), F.lit(0.0)) for k, w in weights.items()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def composites(factors: DataFrame) -> DataFrame:
    """Composite score of each row, with the factors alongside."""
    return factors.withColumn("composite_score", composite())


def scores(factors: DataFrame) -> DataFrame:
    """Composite score and dense rank (best = 1) per date, with the factors alongside."""
    return ranked(composites(factors))


def rank_summary(scored: DataFrame) -> DataFrame:
    """Per date the worst and best rank and the number of different scores.

    Equal scores lie in one range of their date, so they are counted where they were ranked.
    """
    ranges = ranked(scored.select("date", "composite_score"), piece="part").groupBy("date", "part").agg(
        F.max("rank").alias("top"), F.min("rank").alias("low"), F.count_distinct("composite_score").alias("k")
    )
    return ranges.groupBy("date").agg(F.max("top").alias("top"), F.sum("k").alias("k"), F.min("low").alias("low"))


def ranked(scored: DataFrame, piece: str | None = None) -> DataFrame:
    """Dense rank of the composite score (best = 1) per date."""
    return with_rank(
        scored,
        ["date"],
        "composite_score",
        out="rank",
        kind="dense",
        scale=SCORE_SCALE,
        keep_nulls=False,
        piece=piece,
    )


def recent_since(rows: DataFrame, n: int) -> DataFrame:
    """Date of the n-th newest row of each stock, or of its first one.

    rows(stock_id, idx, date): no row comes ``n`` after a recent one, which needs no second order of the rows.
    """
    later = F.lead("idx", n).over(Window.partitionBy("stock_id").orderBy("idx"))
    return rows.withColumn("_later", later).where(F.col("_later").isNull()).groupBy("stock_id").agg(F.min("date").alias("since"))


def ranks_of(chosen: DataFrame, scored: DataFrame) -> DataFrame:
    """Ranks of chosen rows (stock_id, date, composite_score) among all rows of their dates.

    Only better rows count for a dense rank, so those below the worst chosen score of a date are left
    out before the dates are dealt out and ranked. Hand in staged ``chosen``: it is read twice.
    """
    least = chosen.groupBy("date").agg(F.min("composite_score").alias("_least"))
    counted = scored.select("stock_id", "date", "composite_score").join(bounded(least), "date").where(F.col("composite_score") >= F.col("_least"))
    return ranked(counted.drop("_least")).join(chosen.select("stock_id", "date"), ["stock_id", "date"], "left_semi")


def weighted_scores(factors: DataFrame, weightings: Sequence[tuple[str, float, float, float, float]]) -> DataFrame:
    """Scores and ranks for many weightings at once.

    weightings: (name, quality, growth, momentum, value) parameter rows, unrolled
    as a literal array; the weighting is part of the rank group.
    """
    names = ("quality", "growth", "momentum", "value")
    rows = F.array(
        *[F.struct(F.lit(n).alias("weighting"), *[F.lit(float(x)).alias(k) for k, x in zip(names, ws)]) for n, *ws in weightings]
    )
    total = (
        F.col("quality") * F.coalesce("quality_score", F.lit(0.0))
        + F.col("growth") * F.coalesce("growth_score", F.lit(0.0))
        + F.col("momentum") * F.coalesce("momentum_score", F.lit(0.0))
        + F.col("value") * F.coalesce("value_score", F.lit(0.0))
    )
    per = (
        factors.withColumn("_w", F.explode(rows))
        .select(*factors.columns, "_w.*")
        .withColumn("composite_score", total)
    )
    return with_rank(
        per, ["weighting", "date"], "composite_score", out="rank", kind="dense", scale=SCORE_SCALE, keep_nulls=False
    ).drop(
        "quality", "growth", "momentum", "value"
    )


def factor_validation(factors: DataFrame) -> DataFrame:
    """Mean and deviation of the scores on the last date (should be near 0 and 1)."""
    last = factors.agg(F.max("date").alias("date"))
    return factors.join(bounded(last), "date").groupBy("date").agg(
        F.count(F.lit(1)).alias("n_stocks"),
        F.avg("momentum_score").alias("momentum_mean"),
        F.stddev_samp("momentum_score").alias("momentum_std"),
        F.avg("volatility_score").alias("volatility_mean"),
        F.stddev_samp("volatility_score").alias("volatility_std"),
    )


def score_validation(scored: DataFrame, top: int = 10) -> DataFrame:
    """Best stocks of the last date with the mean and deviation of that day's scores."""
    last = scored.agg(F.max("date").alias("date"))
    day = scored.join(bounded(last), "date")
    stats = day.groupBy("date").agg(
        F.avg("composite_score").alias("mean_score"), F.stddev_samp("composite_score").alias("std_score")
    )
    order = Window.partitionBy("date").orderBy("rank", "stock_id")
    best = day.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)
    return best.join(bounded(stats), "date").select(
        "date", "position", "stock_id", "composite_score", "rank", "mean_score", "std_score"
    )


def latest_scoring_date(scored: DataFrame) -> DataFrame:
    return scored.agg(F.max("date").alias("date"))


def ranked_snapshot(
    scored: DataFrame,
    stocks: DataFrame,
    dates: DataFrame,
    *,
    symbols: list[str] | DataFrame | None = None,
    sector: str | None = None,
) -> DataFrame:
    """Ranked stocks on the given score dates.

    ``symbols=None`` or an empty list means no filter; unknown symbols match nothing.
    A longer list can be a table with the column ``symbol``.
    ``sector`` is a case-insensitive substring.
    """
    names = stocks.select("stock_id", "symbol", "name", "sector")
    if isinstance(symbols, DataFrame):
        names = names.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("stock_id", "symbol", "name", "sector")
    elif symbols:
        names = names.where(F.col("symbol").isin(list(symbols)))
    if sector:
        names = names.where(F.lower("sector").contains(sector.lower()))
    return (
        scored.join(bounded(dates.select("date").distinct()), "date", "left_semi")
        .join(names, "stock_id")
        .select("date", "rank", "stock_id", "symbol", "name", "sector", "composite_score", "volatility_score")
    )
