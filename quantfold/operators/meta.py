"""Meta-portfolio: saved portfolios treated as assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantfold.functions.exprs import minmax
from quantfold.operators import estimators as est
from quantfold.operators.backtest import equity_curve
from quantfold.tables import bounded

CAP = 0.6
MOST_PORTFOLIOS = 6


def as_observations(curve: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equity curves as one observation set (grp 1) for the risk operators, with its span."""
    w = Window.partitionBy("portfolio").orderBy("idx")
    obs = curve.select(
        F.lit(1).alias("grp"),
        F.col("portfolio").alias("stock_id"),
        "idx",
        F.product(1 + F.col("daily_return")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("close"),
        F.when(F.row_number().over(w) > 1, F.col("daily_return")).alias("ret"),
    )
    span = curve.agg(F.min("idx").alias("lo_idx"), F.max("idx").alias("hi_idx")).select(F.lit(1).alias("grp"), "lo_idx", "hi_idx")
    return obs, span


def heuristic_weights(metrics: DataFrame, peers: Sequence[str] = ()) -> DataFrame:
    """Proportional to positive Sharpe (equal when none is positive), clipped to the cap, renormalised once.

    The weights of each peer group (all rows, or those of one key) sum to one.
    """
    keys = list(peers)
    pos = F.greatest("sharpe", F.lit(0.0))
    sums = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(pos).alias("_pos"))
    both = metrics.select(*keys, "portfolio", "sharpe")
    both = both.join(sums, keys) if keys else both.crossJoin(sums)
    cap = F.when(F.col("_n") * CAP >= 1.0, F.lit(CAP)).otherwise(F.lit(1.0))
    raw = F.when(F.col("_pos") > 0, pos / F.nullif(F.col("_pos"), F.lit(0.0))).otherwise(1.0 / F.col("_n"))
    clipped = both.select(*keys, "portfolio", F.least(raw, cap).alias("_c"))
    total = clipped.groupBy(*keys).agg(F.sum("_c").alias("_t"))
    both = clipped.join(total, keys) if keys else clipped.crossJoin(total)
    return both.select(*keys, "portfolio", (F.col("_c") / F.col("_t")).alias("weight"))


def searched_weights(curve: DataFrame, scores: DataFrame, names: list[str], steps: int = 20, alpha: float = 0.8) -> DataFrame:
    """Best point of a weight grid for Sharpe - 0.2 * stop-loss penalty + 0.1 * responsiveness bonus.

    Weights are multiples of 1/steps, none above the cap, summing to one. The
    grid is generated and scored in parallel; names holds the portfolios that are
    compared, ``MOST_PORTFOLIOS`` at most (a limit of the feature). scores(portfolio, stop_loss_score, rrc_score).
    """
    n = len(names)
    if n > MOST_PORTFOLIOS:
        raise ValueError(f"a comparison holds at most {MOST_PORTFOLIOS} portfolios; choose the ones to compare")
    spark = curve.sparkSession
    cap = CAP if n * CAP >= 1.0 else 1.0
    base = steps + 1
    digits = [F.floor(F.col("id") / base**i) % base for i in range(n - 1)]
    rest = F.lit(steps) - sum(digits[1:], digits[0]) if n > 1 else F.lit(steps)
    w = F.transform(F.array(*digits, rest), lambda d: d.cast("double") / steps)
    grid = spark.range(base ** max(n - 1, 0)).select("id", w.alias("w")).where(
        F.forall("w", lambda x: (x >= 0) & (x <= cap + 1e-12))
    )
    wide = curve.groupBy("date").agg(
        *[F.max(F.when(F.col("portfolio") == p, F.col("daily_return"))).alias(f"r{i}") for i, p in enumerate(names)]
    )
    returns = curve.select(F.lit(1).alias("grp"), F.col("portfolio").alias("stock_id"), "idx", F.col("daily_return").alias("ret"))
    mu = est.shrunk_returns(returns, annualize=252).join(scores.withColumnRenamed("portfolio", "stock_id"), "stock_id")
    info = mu.groupBy().agg(
        *[F.max(F.when(F.col("stock_id") == p, F.col("mu"))).alias(f"mu{i}") for i, p in enumerate(names)],
        *[F.max(F.when(F.col("stock_id") == p, F.col("stop_loss_score"))).alias(f"s{i}") for i, p in enumerate(names)],
        *[F.max(F.when(F.col("stock_id") == p, F.col("rrc_score"))).alias(f"c{i}") for i, p in enumerate(names)],
    )
    cov = wide.agg(*[F.covar_samp(f"r{i}", f"r{j}").alias(f"v{i}_{j}") for i in range(n) for j in range(i, n)])
    one = grid.join(bounded(info)).join(bounded(cov))
    at = [F.col("w")[i] for i in range(n)]
    avg_var = sum((F.col(f"v{i}_{i}") for i in range(1, n)), F.col("v0_0")) / n
    var = F.lit(0.0)
    for i in range(n):
        for j in range(n):
            c = alpha * F.col(f"v{min(i, j)}_{max(i, j)}")
            var = var + at[i] * at[j] * (c + (1 - alpha) * avg_var if i == j else c)
    ret = sum((at[i] * F.col(f"mu{i}") for i in range(1, n)), at[0] * F.col("mu0"))
    penalty = sum((at[i] * F.pow(F.col(f"s{i}") / 100, F.lit(2.0)) for i in range(1, n)), at[0] * F.pow(F.col("s0") / 100, F.lit(2.0)))
    bonus = sum((at[i] * F.col(f"c{i}") for i in range(1, n)), at[0] * F.col("c0")) / 100
    scored = one.select(
        "id", "w", (ret / F.sqrt(var * 252) - 0.2 * penalty + 0.1 * bonus).alias("objective")
    )
    best = scored.groupBy().agg(F.max_by("w", F.struct("objective", "id")).alias("w"), F.max("objective").alias("objective"))
    return best.select(
        F.explode(
            F.arrays_zip(F.array(*[F.lit(p) for p in names]).alias("portfolio"), F.col("w").alias("weight"))
        ).alias("z"),
        "objective",
    ).select("z.portfolio", "z.weight", "objective")


def meta_curve(curve: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted curve on the days where every portfolio has a return."""
    need = weights.agg(F.count(F.lit(1)).alias("need"))
    daily = (
        curve.join(bounded(weights), "portfolio")
        .groupBy("date", "idx")
        .agg(F.sum(F.col("weight") * F.col("daily_return")).alias("daily_return"), F.count("daily_return").alias("have"))
        .join(bounded(need))
        .where(F.col("have") == F.col("need"))
        .select(F.lit("meta").alias("portfolio"), "date", "idx", "daily_return")
    )
    return equity_curve(daily)


def blended_equally(curve: DataFrame) -> DataFrame:
    """Plain mean of the portfolios per day."""
    daily = curve.groupBy("date", "idx").agg(F.avg("daily_return").alias("daily_return")).select(
        F.lit("equal_blend").alias("portfolio"), "date", "idx", "daily_return"
    )
    return equity_curve(daily)


def relative_rating(meta: DataFrame, users: DataFrame) -> DataFrame:
    """Rating of one metric row against the users' minimum and maximum (.35/.25/.20/.20)."""
    spans = users.agg(
        *[
            f(c).alias(f"{a}_{name}")
            for name, c in (
                ("sharpe", F.col("sharpe")),
                ("cagr", F.col("cagr")),
                ("mdd", F.abs("max_drawdown")),
                ("calmar", F.col("calmar")),
            )
            for a, f in (("lo", F.min), ("hi", F.max))
        ]
    )

    def pos(c, name: str):
        return minmax(c, f"lo_{name}", f"hi_{name}")

    score = (
        0.35 * pos(F.col("sharpe"), "sharpe")
        + 0.25 * pos(F.col("cagr"), "cagr")
        + 0.20 * (1.0 - pos(F.abs("max_drawdown"), "mdd"))
        + 0.20 * pos(F.col("calmar"), "calmar")
    )
    return meta.join(bounded(spans)).select("portfolio", score.alias("meta_score"))


def winner(meta_rating: DataFrame, user_ratings: DataFrame) -> DataFrame:
    """Does the meta-portfolio beat the best saved one? user_ratings(portfolio, rating_score)."""
    best = user_ratings.groupBy().agg(
        F.max_by("portfolio", F.struct("rating_score", "portfolio")).alias("best_user_name"),
        F.max("rating_score").alias("best_user_score"),
    )
    return meta_rating.join(bounded(best)).withColumn(
        "winner_type", F.when(F.col("meta_score") > F.col("best_user_score"), "meta").otherwise("user")
    )


def stock_blend(weights: DataFrame, allocations: DataFrame) -> DataFrame:
    """Sum of portfolio weight times stock weight, capped at 0.6 and renormalised.

    weights(portfolio, weight); allocations(portfolio, stock_id, stock_weight).
    """
    raw = (
        allocations.join(bounded(weights), "portfolio")
        .groupBy("stock_id")
        .agg(F.sum(F.col("weight") * F.col("stock_weight")).alias("_w"))
        .withColumn("_c", F.least("_w", F.lit(CAP)))
    )
    total = raw.agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_t") > 0, F.col("_c") / F.col("_t")).otherwise(1.0 / F.col("_n"))
    return raw.join(bounded(total)).select("stock_id", share.alias("weight"))
