"""Composite portfolio ratings and portfolio correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions.exprs import clip, ladder, minmax, no_nan, rounded, safe_corr

RATING_WEIGHTS = {"sharpe": 0.30, "drawdown": 0.20, "stability": 0.15, "regime": 0.10, "diversif": 0.15, "rrc": 0.10}
RATING_GRADES = [(90, "A+"), (80, "A"), (70, "B"), (60, "C")]
DEFAULTS = {
    "sharpe": 0.0,
    "cagr": 0.0,
    "max_drawdown": -0.5,
    "volatility": 0.0,
    "calmar": 0.0,
    "stability_score": 50.0,
    "regime_sharpe_gap": 1.0,
    "avg_pairwise_corr": 0.5,
    "rrc_score": 50.0,
}


def rating_input(
    metrics: DataFrame, stability: DataFrame, correlations: DataFrame | None = None, rrc: DataFrame | None = None
) -> DataFrame:
    """One row per portfolio with the neutral defaults where an ingredient is missing."""
    df = metrics.select("portfolio", "sharpe", "cagr", "max_drawdown", "volatility", "calmar").join(
        stability.select("portfolio", "stability_score", F.col("grade").alias("stability_grade"), "regime_sharpe_gap"),
        "portfolio",
        "left",
    )
    if correlations is not None:
        df = df.join(correlations.select("portfolio", "avg_pairwise_corr"), "portfolio", "left")
    if rrc is not None:
        df = df.join(rrc.select("portfolio", "rrc_score"), "portfolio", "left")
    for c, d in DEFAULTS.items():
        have = no_nan(F.col(c)) if c in df.columns else F.lit(None).cast("double")
        df = df.withColumn(c, F.coalesce(have, F.lit(d)))
    return df.withColumn("stability_grade", F.coalesce("stability_grade", F.lit("N/A")))


def components() -> dict[str, Column]:
    """Ingredients on a 0-1 scale, absolute (not relative to peers)."""
    sharpe = F.col("sharpe")
    worst_gap = F.greatest(F.lit(2.0), F.abs(sharpe) * 0.75)
    return {
        "sharpe": clip(sharpe / 2.5, 0, 1),
        "drawdown": clip(1.0 - (F.abs("max_drawdown") - 0.05) / (0.40 - 0.05), 0, 1),
        "stability": F.col("stability_score") / 100.0,
        "regime": 1.0 - clip(F.col("regime_sharpe_gap") / worst_gap, 0, 1),
        "diversif": clip(1.0 - (F.col("avg_pairwise_corr") - 0.2) / (0.8 - 0.2), 0, 1),
        "rrc": F.col("rrc_score") / 100.0,
    }


def composite_rating(rows: DataFrame, peers: list[str] | None = None, display: bool = True) -> DataFrame:
    """Score, grade and competition rank inside each peer group (all rows when none is given)."""
    parts = components()
    total: Column = F.lit(0.0)
    for k, c in parts.items():
        total = total + F.lit(RATING_WEIGHTS[k]) * c * 100.0
    w = Window.partitionBy(*(peers or [F.lit(0)])).orderBy(F.desc("_score"))
    d_score, d_part = (2, 1) if display else (6, 6)
    return (
        rows.withColumn("_score", clip(total, 0, 100))
        .withColumn("rank", F.rank().over(w))
        .select(
            *rows.columns,
            rounded("_score", d_score).alias("composite_score"),
            ladder("_score", RATING_GRADES, "D").alias("grade"),
            "rank",
            *[rounded(c * 100.0, d_part).alias(f"{k}_component") for k, c in parts.items()],
        )
    )


def top_portfolio(rated: DataFrame) -> DataFrame:
    return rated.where(F.col("rank") == 1).select("portfolio", "composite_score", "grade")


def normalised_rating(df: DataFrame) -> DataFrame:
    """Single rating from already normalised Sharpe, CAGR, drawdown and Calmar."""
    score = (
        0.35 * F.col("sharpe_norm")
        + 0.25 * F.col("cagr_norm")
        + 0.20 * (1.0 - F.col("maxdd_norm"))
        + 0.20 * F.col("calmar_norm")
    )
    return df.withColumn("rating_score", score)


def minmax_metrics(metrics: DataFrame, peers: Sequence[str] = ()) -> DataFrame:
    """Peer-normalised metrics: position between the peers' minimum and maximum (peers: all rows, or those of one key)."""
    values = {"sharpe": F.col("sharpe"), "cagr": F.col("cagr"), "maxdd": F.abs("max_drawdown"), "calmar": F.col("calmar")}
    ends = [end(v).alias(f"_{k}_{name}") for k, v in values.items() for name, end in (("lo", F.min), ("hi", F.max))]
    bounds = metrics.groupBy(*peers).agg(*ends)
    both = metrics.join(bounds, list(peers)) if peers else metrics.crossJoin(bounds)
    return both.select(*peers, "portfolio", *[minmax(v, F.col(f"_{k}_lo"), F.col(f"_{k}_hi")).alias(f"{k}_norm") for k, v in values.items()])


def portfolio_correlation(curve: DataFrame, comparison: Sequence[str] = ()) -> DataFrame:
    """Correlation and sample covariance of every pair of portfolios of a comparison on shared dates.

    A comparison (all rows, or those of one key) holds at most six portfolios, which bounds the pairs per date.
    """
    a = curve.select(*comparison, "date", F.col("portfolio").alias("portfolio_a"), F.col("daily_return").alias("ra"))
    b = curve.select(*comparison, "date", F.col("portfolio").alias("portfolio_b"), F.col("daily_return").alias("rb"))
    return (
        a.join(b, [*comparison, "date"])
        .groupBy(*comparison, "portfolio_a", "portfolio_b")
        .agg(safe_corr("ra", "rb").alias("correlation"), F.covar_samp("ra", "rb").alias("covariance"))
    )


def anomaly_flags(metrics: DataFrame) -> DataFrame:
    """Research anomalies: absurd Sharpe, return or a positive drawdown."""
    from quantfold.functions.exprs import flags

    return metrics.withColumn(
        "anomalies",
        flags(
            (F.abs("sharpe") > 5, "sharpe_out_of_range"),
            (F.col("total_return") > 10, "return_out_of_range"),
            (F.col("max_drawdown") > 0, "positive_drawdown"),
        ),
    )
