"""Diversification-aware hybrid portfolio for all rebalance dates in one job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions import linalg
from quantfold.functions.exprs import SQRT_YEAR, flags, minmax, ratio
from quantfold.operators import estimators as est
from quantfold.operators import risk

POOL = 50
MAX_CORR = 0.80
TILT = 0.25
TARGET_VOL = 0.15


def candidate_pool(cands: DataFrame, rrc: DataFrame, min_score: float = 0.0, size: int = POOL) -> DataFrame:
    """Best ``size`` names after the responsiveness adjustment of the score.

    cands(grp, stock_id, composite_score, volatility_score); rrc(grp, stock_id, rrc_score).
    """
    df = cands.where(F.col("composite_score") >= min_score) if min_score > 0 else cands
    rrc_c, score = F.col("rrc_score"), F.col("composite_score")
    adjusted = F.when(rrc_c < 30, score * 0.90).when(rrc_c > 70, score * 1.05).otherwise(score)
    order = Window.partitionBy("grp").orderBy(F.desc("score"), "stock_id")
    return (
        df.join(rrc.select("grp", "stock_id", "rrc_score"), ["grp", "stock_id"], "left")
        .select("grp", "stock_id", adjusted.alias("score"), "volatility_score")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= size)
    )


def uncorrelated_selection(pool: DataFrame, returns: DataFrame, top_n: int, max_corr: float = MAX_CORR) -> DataFrame:
    """Greedy selection in score order; one bounded block (50 names x 90 days) per rebalance date."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.drop_duplicates("stock_id").sort_values("position")["stock_id"].tolist()
        wide = linalg.wide_returns(pdf, order)
        counts = wide.notna().sum()
        wide = wide[[c for c in wide.columns if counts[c] >= 5]]
        if len(wide) < 5:
            picked = order[:top_n]
        else:
            corr = wide.corr() if wide.shape[1] > 1 else wide.corr().iloc[:0, :0]
            known = [s for s in order if s in wide.columns]
            ordered = known + [s for s in order if s not in wide.columns]
            picked = linalg.greedy_low_correlation(corr, ordered, top_n, max_corr)
        out = pd.DataFrame({"grp": key[0], "stock_id": picked, "pick": range(1, len(picked) + 1)})
        return out.astype({"grp": "int32", "stock_id": "int64", "pick": "int32"})

    block = pool.select("grp", "stock_id", "position").join(returns, ["grp", "stock_id"], "left")
    return block.groupBy("grp").applyInPandas(one, "grp int, stock_id long, pick int")


def tilted_weights(selected: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse-volatility weights tilted towards higher scores.

    selected(keys..., stock_id, score, vol): the tilt is up to +25% by the score's
    position between the group's lowest and highest.
    """
    part = Window.partitionBy(*keys)
    inv = F.lit(1.0) / F.greatest("vol", F.lit(1e-8))
    tilt = 1.0 + F.lit(TILT) * minmax("score", F.min("score").over(part), F.max("score").over(part))
    return (
        selected.withColumn("_i", inv)
        .withColumn("_b", F.col("_i") / F.sum("_i").over(part) * tilt)
        .withColumn("weight", F.col("_b") / F.sum("_b").over(part))
        .drop("_i", "_b")
    )


def own_volatility(selected: DataFrame, returns: DataFrame) -> DataFrame:
    """Annualised deviation of the trailing returns, else a proxy from the volatility score, else 1."""
    dev = returns.groupBy("grp", "stock_id").agg(F.stddev_samp("ret").alias("_d"))
    proxy = F.coalesce(F.greatest(F.abs(F.col("volatility_score") + 3.0), F.lit(1e-6)), F.lit(1.0))
    return (
        selected.join(dev, ["grp", "stock_id"], "left")
        .withColumn("vol", F.when(F.col("_d") > 0, F.col("_d") * F.lit(SQRT_YEAR)).otherwise(proxy))
        .drop("_d")
    )


def stop_loss_layer(weights: DataFrame, sls: DataFrame) -> DataFrame:
    """Zero the weight above a score of 75, halve it above 60, rescale; zero weights drop out."""
    s = F.col("stop_loss_score")
    factor = F.when(s > 75, F.lit(0.0)).when(s > 60, F.lit(0.5)).otherwise(F.lit(1.0))
    cut = (
        weights.join(sls.select("grp", "stock_id", "stop_loss_score"), ["grp", "stock_id"], "left")
        .withColumn("adjusted", (F.coalesce(s, F.lit(0.0)) > 60).cast("int"))
        .withColumn("weight", F.col("weight") * factor)
        .where(F.col("weight") > 0)
    )
    return cut.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("grp")))


def build(
    cands: DataFrame,
    rrc: DataFrame,
    panel: DataFrame,
    corr_spans: DataFrame,
    sls_spans: DataFrame,
    top_n: int,
    *,
    min_score: float = 0.0,
    max_corr: float = MAX_CORR,
    use_sls: bool = True,
    sls: DataFrame | None = None,
    cut: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Weights(grp, stock_id, pick, score, vol, weight) and the trailing returns of the pool.

    ``cut`` stages the pool, its returns and the selection; all three have at
    most 50 names per date. ``sls`` supplies scores computed elsewhere (auto-N);
    otherwise the stop-loss scores are taken inside each selected set.
    """
    pool = cut(candidate_pool(cands, rrc, min_score))
    returns = cut(est.trailing_returns(pool, panel, corr_spans))
    picked = uncorrelated_selection(pool, returns, top_n, max_corr)
    selected = own_volatility(picked.join(pool.drop("position"), ["grp", "stock_id"]), returns)
    weights = cut(tilted_weights(selected, ["grp"]))
    if use_sls:
        if sls is None:
            obs, spans = risk.set_observations(panel, weights.select("grp", "stock_id"), sls_spans)
            sls = risk.stop_loss(cut(obs), cut(spans), scope=("grp",), cut=cut)
        weights = cut(stop_loss_layer(weights, sls))
    else:
        weights = weights.withColumn("stop_loss_score", F.lit(None).cast("double")).withColumn("adjusted", F.lit(0))
    return weights, returns


def expectations(weights: DataFrame, returns: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """Expected volatility, Sharpe and average |correlation| per date on days complete for all held names.

    Fewer than two names or five complete days give zeros.
    """
    held = returns.join(weights.select("grp", "stock_id"), ["grp", "stock_id"], "left_semi")
    full = est.complete_rows(held)
    size = full.groupBy("grp").agg(F.max("n_names").alias("n_names"), F.count_distinct("idx").alias("n_days"))
    ok = size.where((F.col("n_names") >= 2) & (F.col("n_days") >= 5)).select("grp")
    rows = full.join(ok, "grp", "left_semi").select("grp", "stock_id", "idx", "ret")
    vol = est.portfolio_moments(rows, weights.select("grp", "stock_id", "weight"), [])
    mu = est.error_corrected(est.shrunk_returns(rows, annualize=252).select("grp", "stock_id", "mu"), weights, calibration)
    exp_ret = mu.join(weights.select("grp", "stock_id", "weight"), ["grp", "stock_id"]).groupBy("grp").agg(
        (F.sum(F.col("mu") * F.col("weight")) / F.sum("weight")).alias("expected_return")
    )
    order = Window.partitionBy("grp").orderBy("pick")
    ranked = weights.select("grp", "stock_id", F.row_number().over(order).alias("position"))
    profile = est.correlation_profile(rows, ranked)
    last = profile.groupBy("grp").agg(F.max_by("avg_abs_corr", "k").alias("avg_pairwise_corr"))
    base = weights.groupBy("grp").agg(F.count(F.lit(1)).alias("n_stocks"), F.sum("adjusted").alias("n_reduced"))
    zero = F.lit(0.0)
    return (
        base.join(vol, "grp", "left")
        .join(exp_ret, "grp", "left")
        .join(last, "grp", "left")
        .select(
            "grp",
            "n_stocks",
            "n_reduced",
            F.coalesce("expected_volatility", zero).alias("expected_volatility"),
            F.coalesce(ratio("expected_return", "expected_volatility", 0.0), zero).alias("expected_sharpe"),
            F.coalesce("avg_pairwise_corr", zero).alias("avg_pairwise_corr"),
        )
        .withColumn(
            "warnings",
            F.array_join(
                flags(
                    (F.col("n_stocks") < 8, "low_diversification"),
                    (F.col("avg_pairwise_corr") > 0.6, "high_concentration"),
                ),
                ",",
            ),
        )
    )


def period_sharpe_spread(curve: DataFrame) -> DataFrame:
    """Deviation of per-period Sharpe ratios; above 2 with three or more periods the strategy is unstable."""
    per = curve.groupBy("portfolio", "reb_no").agg(
        F.count(F.lit(1)).alias("n"), F.avg("daily_return").alias("m"), F.stddev_pop("daily_return").alias("s")
    )
    ps = F.when(F.col("s") > 0, F.col("m") * 252 / (F.col("s") * F.lit(SQRT_YEAR))).otherwise(F.lit(0.0))
    out = per.where(F.col("n") > 1).withColumn("ps", ps).groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("periods"), F.stddev_pop("ps").alias("sharpe_std")
    )
    return out.withColumn("sharpe_unstable", (F.col("periods") >= 3) & (F.col("sharpe_std") > 2.0))
