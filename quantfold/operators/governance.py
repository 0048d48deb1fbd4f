"""Overfitting and conservatism diagnostics and the governance score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantfold.functions.exprs import clip, flags


def _opt(df: DataFrame, name: str, default: float | None = None) -> Column:
    c = F.col(name) if name in df.columns else F.lit(None).cast("double")
    return c if default is None else F.coalesce(c, F.lit(float(default)))


def overfitting(df: DataFrame) -> DataFrame:
    """Six checks; the walk-forward and sensitivity checks count only when supplied.

    Optional columns: sharpe, monthly_turnover, wf_sharpe_gap, max_sensitivity_sharpe,
    min_sensitivity_sharpe, error_r2, coefficient_flips.
    """
    sharpe, turn = _opt(df, "sharpe", 0), _opt(df, "monthly_turnover", 0)
    gap, hi, lo = _opt(df, "wf_sharpe_gap"), _opt(df, "max_sensitivity_sharpe"), _opt(df, "min_sensitivity_sharpe")
    change = F.when(hi > 0, (hi - lo) / F.abs(hi))
    checks = [
        (sharpe > 3.0, "extreme_sharpe", F.lit(1)),
        (turn > 0.60, "excessive_turnover", F.lit(1)),
        (F.coalesce(gap > 1.0, F.lit(False)), "train_test_gap", gap.isNotNull().cast("int")),
        (F.coalesce(change > 0.25, F.lit(False)), "weight_sensitivity", hi.isNotNull().cast("int")),
        (_opt(df, "error_r2", 0) > 0.8, "high_error_r2", F.lit(1)),
        (_opt(df, "coefficient_flips", 0) > 3, "sign_flips", F.lit(1)),
    ]
    failed = sum((c.cast("int") for c, _, _ in checks[1:]), checks[0][0].cast("int"))
    total = sum((k for _, _, k in checks[1:]), checks[0][2])
    share = failed / total
    return df.select(
        "*",
        F.when(share >= 0.5, "High").when(share >= 0.2, "Moderate").otherwise("Low").alias("overfitting_risk"),
        flags(*[(c, name) for c, name, _ in checks]).alias("overfit_flags"),
        (failed * 5).alias("overfit_penalty"),
    )


def conservatism(df: DataFrame) -> DataFrame:
    """Four checks for an overly cautious model. Optional columns: volatility, beta, sharpe, cagr, cagr_low_vol."""
    vol, beta = _opt(df, "volatility", 0), _opt(df, "beta", 1)
    sharpe, cagr = _opt(df, "sharpe", 0), _opt(df, "cagr", 0)
    calm = F.coalesce(_opt(df, "cagr_low_vol"), cagr)
    checks = [
        ((vol > 0) & (vol < 0.08), "low_volatility"),
        (beta < 0.3, "low_beta"),
        ((sharpe > 0.8) & (cagr < 0.05), "suppressed_cagr"),
        (calm < 0.08, "weak_in_calm_regime"),
    ]
    failed = sum((c.cast("int") for c, _ in checks[1:]), checks[0][0].cast("int"))
    return df.select(
        "*",
        F.when(failed >= 3, "Overly Conservative Model")
        .when(failed >= 1, "Slightly Conservative")
        .otherwise("Balanced")
        .alias("classification"),
        (failed / F.lit(4.0) * 100).alias("impact_score"),
        flags(*checks).alias("conservative_flags"),
        (failed * 3).alias("conservative_penalty"),
    )


def governance_score(df: DataFrame) -> DataFrame:
    """100 minus the penalties and up to 20 points for instability, kept in [0, 100]."""
    instability = F.greatest(F.lit(0.0), 20.0 - F.col("stability_score") * 0.2)
    return df.withColumn(
        "governance_score", clip(100.0 - (F.col("overfit_penalty") + F.col("conservative_penalty") + instability), 0, 100)
    )
