"""Stop-loss scores and risk responsiveness for many as-of dates and stock sets.

All operators take an observation table and a table of spans:

obs(scope..., stock_id, idx, close, ret): dense closes (one row per trading day
    from a stock's first price on). With an empty scope one panel serves every
    as-of date; with ``scope=("grp",)`` every group has its own stock set.
spans(grp, lo_idx, hi_idx): first and last trading day of each look-back window.

Rolling statistics are taken once per stock from running sums; the per-as-of
work is joins on the day number against calendar-sized tables and partial
aggregation by (as-of, stock).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from quantfold.functions.exprs import clip, ladder, rounded
from quantfold.functions.ranking import pct_ranks, small_group_pct_rank
from quantfold.tables import bounded

HALF_YEAR = 126
YEAR = 252
MONTH = 21
BETA_WINDOW = 60
SLS_CALENDAR_DAYS = int(252 * 1.6)
RRC_CALENDAR_DAYS = 365 * 5 + 10
W_DD, W_VAR, W_MOM, W_ERR, W_REGIME = 0.25, 0.20, 0.20, 0.20, 0.15
RISK_LEVELS = [(80, "Critical"), (70, "High"), (40, "Moderate")]
ACTIONS = [(80, "Exit"), (70, "Reduce")]
NEUTRAL = 50.0


def spans(as_of: DataFrame, calendar: DataFrame, days: int) -> DataFrame:
    """Trading-day window of the ``days`` calendar days up to each as-of date.

    as_of(grp, as_of). One row per as-of date in and out; the day numbers come
    from the calendar, so no price row is touched.
    """
    bounds = as_of.select("grp", "as_of", F.date_sub("as_of", days).alias("start"))
    days_in = calendar.join(bounded(bounds), F.col("date").between(F.col("start"), F.col("as_of")))
    return days_in.groupBy("grp", "as_of").agg(F.min("idx").alias("lo_idx"), F.max("idx").alias("hi_idx"))


def set_observations(panel: DataFrame, sets: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations of explicit stock sets (a portfolio, a candidate pool) cut to their windows.

    sets(grp, stock_id). Returns the observations and the spans; a window starts
    at the first day on which any member has a price.
    """
    cut = (
        sets.join(windows, "grp")
        .join(panel.select("stock_id", "idx", "close", "ret"), "stock_id")
        .where(F.col("idx").between(F.col("lo_idx"), F.col("hi_idx")))
    )
    lows = cut.groupBy("grp").agg(F.min("idx").alias("lo_idx"), F.max("idx").alias("hi_idx"))
    obs = cut.select(
        "grp",
        "stock_id",
        "idx",
        "close",
        F.when(F.col("idx") > F.col("lo_idx"), F.col("ret")).alias("ret"),
    )
    return obs, lows


def _pct(df: DataFrame, scope: Sequence[str], specs: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Percent ranks inside ``grp``; universe-sized groups are split, selected sets are ranked directly."""
    if not scope:
        return pct_ranks(df, "grp", "stock_id", specs)
    for value, out, descending in specs:
        df = small_group_pct_rank(df, ["grp"], value, out=out, descending=descending)
    return df


def _same(df: DataFrame) -> DataFrame:
    return df


def _side(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Calendar-sized side of a join: with the universe scope it has one row per as-of date and
    look-back day and is broadcast; with many stock sets it grows with them, so Spark chooses."""
    return df if scope else bounded(df)


def spike_starts(flags: Column) -> Column:
    """Onset rows at least 11 rows after the last accepted one; the last three of them."""
    accepted = F.aggregate(
        F.array_sort(flags),
        F.array().cast("array<int>"),
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (x - F.element_at(acc, -1) > 10), F.concat(acc, F.array(x))
        ).otherwise(acc),
    )
    return F.when(F.size(accepted) > 3, F.slice(accepted, -3, 3)).otherwise(accepted)


def deepest_drawdown(values: str) -> Column:
    """Most negative drop from the running peak inside an array of prices."""
    return F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("d")),
        lambda a, x: F.struct(
            F.greatest(a["p"], x).alias("p"),
            F.least(a["d"], (x - F.greatest(a["p"], x)) / F.greatest(a["p"], x)).alias("d"),
        ),
        lambda a: a["d"],
    )


def market_regimes(obs: DataFrame, windows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per (grp, day): equal-weight market sum, 30-day volatility flag and row number in the window.

    Names without a price that day count as a zero return, so the market mean is
    the sum over the number of names in the window.
    """
    sums = obs.groupBy(*scope, "idx").agg(F.sum(F.coalesce("ret", F.lit(0.0))).alias("s"))
    names = (
        obs.join(_side(windows.select("grp", F.col("hi_idx").alias("idx")), scope), [*scope, "idx"])
        .groupBy("grp")
        .agg(F.count(F.lit(1)).alias("n_names"))
    )
    days = windows.select("grp", "lo_idx", "hi_idx", F.explode(F.sequence("lo_idx", "hi_idx")).alias("idx"))
    w = Window.partitionBy("grp").orderBy("idx")
    per_day = (
        days.join(names, "grp")
        .join(sums, [*scope, "idx"], "left")
        .withColumn("row", F.col("idx") - F.col("lo_idx"))
        .withColumn("s", F.when(F.col("row") == 0, F.lit(0.0)).otherwise(F.coalesce("s", F.lit(0.0))))
        .withColumn(
            "vol30",
            F.when(
                F.col("row") >= 29,
                # rounding keeps equal volatilities equal on flat stretches
                F.round(F.stddev_samp(F.col("s") / F.col("n_names")).over(w.rowsBetween(-29, 0)), 12),
            ),
        )
    )
    q = F.percentile("vol30", F.lit(0.75)).over(Window.partitionBy("grp"))
    flagged = per_day.withColumn("q75", q).withColumn(
        "hi", F.coalesce(F.col("vol30") > F.coalesce("q75", F.lit(0.0)), F.lit(False))
    )
    return flagged.withColumn("onset", F.col("hi") & ~F.coalesce(F.lag("hi").over(w), F.lit(True)))


def _rolling_pairs(obs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """60-day covariance with the market sum and variances, twice: plain, and with the oldest day zeroed.

    The zeroed form is what the first full window of a look-back sees, because
    the first day of a look-back has no return.
    """
    k = BETA_WINDOW
    n = F.lit(float(k))
    mw = Window.partitionBy(*scope).orderBy("idx") if scope else Window.partitionBy(F.lit(0)).orderBy("idx")
    base = obs.groupBy(*scope, "idx").agg(F.sum(F.coalesce("ret", F.lit(0.0))).alias("s"))
    market = base.select(
        *scope,
        "idx",
        "s",
        F.sum("s").over(mw.rowsBetween(-(k - 1), 0)).alias("m1"),
        F.sum(F.col("s") * F.col("s")).over(mw.rowsBetween(-(k - 1), 0)).alias("m2"),
        F.coalesce(F.lag("s", k - 1).over(mw), F.lit(0.0)).alias("s_old"),
    )
    sw = Window.partitionBy(*scope, "stock_id").orderBy("idx")
    upto = sw.rowsBetween(Window.unboundedPreceding, 0)
    rows = obs.join(_side(market, scope), [*scope, "idx"]).withColumn("r", F.coalesce("ret", F.lit(0.0)))
    run = rows.select(
        *scope,
        "stock_id",
        "idx",
        "m1",
        "m2",
        "s_old",
        F.coalesce(F.lag("r", k - 1).over(sw), F.lit(0.0)).alias("r_old"),
        F.sum("r").over(upto).alias("c1"),
        F.sum(F.col("r") * F.col("r")).over(upto).alias("c2"),
        F.sum(F.col("r") * F.col("s")).over(upto).alias("cx"),
    )

    def tail(c: str) -> Column:
        return F.col(c) - F.coalesce(F.lag(c, k).over(sw), F.lit(0.0))

    t = run.select(*scope, "stock_id", "idx", "m1", "m2", "s_old", "r_old", tail("c1").alias("r1"), tail("c2").alias("r2"), tail("cx").alias("rx"))

    def stats(m1: Column, m2: Column, r1: Column, r2: Column, rx: Column) -> tuple[Column, Column]:
        cov = (rx - r1 * m1 / n) / (n - 1)
        vm = F.greatest((m2 - m1 * m1 / n) / (n - 1), F.lit(0.0))
        vr = F.greatest((r2 - r1 * r1 / n) / (n - 1), F.lit(0.0))
        return F.try_divide(cov, vm), F.try_divide(cov, F.sqrt(vm) * F.sqrt(vr))

    b, c = stats(F.col("m1"), F.col("m2"), F.col("r1"), F.col("r2"), F.col("rx"))
    so, ro = F.col("s_old"), F.col("r_old")
    bz, cz = stats(
        F.col("m1") - so, F.col("m2") - so * so, F.col("r1") - ro, F.col("r2") - ro * ro, F.col("rx") - ro * so
    )
    return t.select(
        *scope, "stock_id", "idx", b.alias("beta"), c.alias("corr"), bz.alias("beta_z"), cz.alias("corr_z")
    )


def responsiveness(
    obs: DataFrame, windows: DataFrame, scope: Sequence[str] = (), cut: Callable[[DataFrame], DataFrame] = _same
) -> DataFrame:
    """Risk responsiveness (0-100) per (grp, stock): spike drawdown, beta compression, recovery, correlation drift.

    Windows shorter than 126 rows give the neutral 50. More than five names are
    scored by percent rank, five or fewer by absolute maps. ``cut`` may stage the
    per-day market table and the per-stock components before they are ranked.
    """
    regimes = cut(market_regimes(obs, windows, scope))
    pairs = _rolling_pairs(obs, scope)
    warm = F.col("row") < BETA_WINDOW - 1
    edge = F.col("row") == BETA_WINDOW - 1
    per_grp = regimes.groupBy("grp").agg(
        F.max("n_names").alias("n_names"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("hi").cast("int")).alias("n_hi"),
        F.sum((~F.col("hi")).cast("int")).alias("n_no"),
        F.sum((F.col("hi") & warm).cast("int")).alias("w_hi"),
        F.sum((~F.col("hi") & warm).cast("int")).alias("w_no"),
    )
    flags = regimes.select("grp", "idx", "row", "hi", "n_names")
    one = F.lit(1.0)
    beta = F.when(warm, one).when(edge, F.coalesce(F.col("beta_z") * F.col("n_names"), one)).otherwise(
        F.coalesce(F.col("beta") * F.col("n_names"), one)
    )
    corr = F.when(warm, one).when(edge, F.coalesce("corr_z", one)).otherwise(F.coalesce("corr", one))
    hi, no = F.col("hi"), ~F.col("hi")
    sums = (
        pairs.join(_side(flags, scope), [*scope, "idx"])
        .groupBy("grp", "stock_id")
        .agg(
            *[F.sum(F.when(mask, v)).alias(f"s{name}_{side}") for name, v in (("b", beta), ("c", corr)) for side, mask in (("hi", hi), ("no", no))],
            F.count(F.when(hi, 1)).alias("c_hi"),
            F.count(F.when(no, 1)).alias("c_no"),
            F.count(F.when(hi & warm, 1)).alias("cw_hi"),
            F.count(F.when(no & warm, 1)).alias("cw_no"),
        )
    )

    def mean(name: str, side: str) -> Column:
        have = F.coalesce(F.col(f"s{name}_{side}"), F.lit(0.0))
        missing = F.col(f"w_{side}") - F.col(f"cw_{side}") if name == "b" else F.col(f"n_{side}") - F.col(f"c_{side}")
        return (have + missing) / F.col(f"n_{side}")

    enough = (F.col("n_hi") > 5) & (F.col("n_no") > 5)
    drift = sums.join(_side(per_grp, scope), "grp").select(
        "grp",
        "stock_id",
        "n_names",
        "n_rows",
        F.when(enough, mean("b", "no") - mean("b", "hi")).otherwise(F.lit(0.0)).alias("beta_compression"),
        F.when(enough, mean("c", "no") - mean("c", "hi")).otherwise(F.lit(0.0)).alias("corr_drift"),
    )
    merged = (
        drift.join(_spike_drawdown(obs, regimes, scope), ["grp", "stock_id"], "left")
        .join(_recovery_rows(obs, windows, scope), ["grp", "stock_id"], "left")
        .withColumn("spike_dd", F.coalesce("spike_dd", F.lit(0.0)))
    )
    # drop rounding noise so that equal values tie exactly
    merged = merged.withColumn("beta_compression", F.round("beta_compression", 12)).withColumn(
        "corr_drift", F.round("corr_drift", 12)
    )
    merged = _pct(
        cut(merged),
        scope,
        [
            ("spike_dd", "p_spike", False),
            ("beta_compression", "p_beta", False),
            ("corr_drift", "p_corr", False),
            ("recovery_days", "p_rec", True),
        ],
    )
    big = F.col("n_names") > 5
    spike = F.when(big, F.coalesce("p_spike", F.lit(0.5))).otherwise(clip(1 + F.col("spike_dd") / 0.10, 0, 1))
    sbeta = F.when(big, F.coalesce("p_beta", F.lit(0.5))).otherwise(clip(0.5 + F.col("beta_compression"), 0, 1))
    scorr = F.when(big, F.coalesce("p_corr", F.lit(0.5))).otherwise(clip(0.5 + F.col("corr_drift") / 0.4, 0, 1))
    srec = F.when(big, F.coalesce("p_rec", F.lit(0.5))).otherwise(clip(1 - F.col("recovery_days") / 60.0, 0, 1))
    score = clip(100 * (0.30 * spike + 0.25 * sbeta + 0.25 * srec + 0.20 * scorr), 0, 100)
    return merged.select(
        "grp",
        "stock_id",
        F.when(F.col("n_rows") < HALF_YEAR, F.lit(NEUTRAL)).otherwise(F.coalesce(score, F.lit(NEUTRAL))).alias("rrc_score"),
        "spike_dd",
        "beta_compression",
        "recovery_days",
        "corr_drift",
    )


def _spike_drawdown(obs: DataFrame, regimes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Mean over the accepted spikes of the deepest drawdown in the ten rows from the spike."""
    starts = regimes.groupBy("grp").agg(
        spike_starts(F.collect_list(F.when(F.col("onset"), F.col("idx")))).alias("starts"), F.max("hi_idx").alias("hi_idx")
    )
    days = starts.select("grp", "hi_idx", F.posexplode("starts").alias("k", "s_idx")).select(
        "grp", "k", F.explode(F.sequence("s_idx", F.least(F.col("s_idx") + 9, F.col("hi_idx")))).alias("idx")
    )
    w = Window.partitionBy("grp", "k", "stock_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    dd = obs.join(_side(days, scope), [*scope, "idx"]).withColumn("peak", F.max("close").over(w))
    return (
        dd.groupBy("grp", "k", "stock_id")
        .agg(F.min((F.col("close") - F.col("peak")) / F.col("peak")).alias("dd"))
        .groupBy("grp", "stock_id")
        .agg(F.avg("dd").alias("spike_dd"))
    )


def _recovery_rows(obs: DataFrame, windows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rows from the trough of the last 252 to the first half recovery; 0 for drawdowns above -5%."""
    if not scope:
        return _recovery_of_universe(obs, windows)
    days = windows.select(
        "grp", F.explode(F.sequence(F.greatest("lo_idx", F.col("hi_idx") - (YEAR - 1)), "hi_idx")).alias("idx")
    )
    part = Window.partitionBy("grp", "stock_id")
    upto = part.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    dd = (
        obs.select(*scope, "stock_id", "idx", "close")
        .join(_side(days, scope), [*scope, "idx"])
        .withColumn("peak", F.max("close").over(upto))
        .withColumn("dd", (F.col("close") - F.col("peak")) / F.col("peak"))
        .withColumn("worst", F.min("dd").over(part))
        .withColumn("trough", F.min(F.when(F.col("dd") == F.col("worst"), F.col("idx"))).over(part))
    )
    back = F.min(F.when((F.col("idx") >= F.col("trough")) & (F.col("dd") >= F.col("worst") / 2), F.col("idx")))
    found = dd.groupBy("grp", "stock_id").agg(
        F.max("worst").alias("worst"), F.max("trough").alias("trough"), back.alias("back")
    )
    days_taken = F.coalesce((F.col("back") - F.col("trough") + 1).cast("double"), F.lit(float(YEAR)))
    return found.select(
        "grp", "stock_id", F.when(F.col("worst") < -0.05, days_taken).otherwise(F.lit(0.0)).alias("recovery_days")
    )


def _recovery_of_universe(obs: DataFrame, windows: DataFrame) -> DataFrame:
    """``_recovery_rows`` of every stock: its closes are sorted once, and all windows (one per as-of date) are cut from them.

    The rows of the windows, 252 per stock and as-of date, are never formed.
    """
    spans = windows.select("grp", F.greatest("lo_idx", F.col("hi_idx") - (YEAR - 1)).alias("lo"), "hi_idx").collect()
    grps = pa.array([r["grp"] for r in spans])
    lo, hi = (np.array([r[c] for r in spans], np.int64) for c in ("lo", "hi_idx"))
    out = StructType([windows.schema["grp"], obs.schema["stock_id"], StructField("recovery_days", DoubleType())])

    def recover(rows: pa.Table) -> pa.Table:
        idx, close = rows["idx"].to_numpy().astype(np.int64), rows["close"].to_numpy()
        order = np.argsort(idx)
        idx, close = idx[order], close[order]
        begin, end = np.searchsorted(idx, lo), np.searchsorted(idx, hi, "right")
        some = np.flatnonzero(begin < end)
        at = begin[some, None] + np.arange(YEAR)
        inside = at < end[some, None]
        at = np.minimum(at, len(idx) - 1)
        values = close[at]
        peak = np.maximum.accumulate(values, axis=1)
        dd = np.where(inside, (values - peak) / peak, np.inf)
        trough = dd.argmin(axis=1)
        each = np.arange(len(some))
        worst = dd[each, trough]
        back = inside & (np.arange(YEAR) >= trough[:, None]) & (dd >= worst[:, None] / 2)
        taken = np.where(back.any(axis=1), idx[at[each, back.argmax(axis=1)]] - idx[at[each, trough]] + 1, YEAR)
        days = np.where(worst < -0.05, taken, 0).astype(np.float64)
        stock = pa.repeat(rows["stock_id"][0], len(some))
        return pa.table([grps.take(pa.array(some)).cast(kinds[0]), stock.cast(kinds[1]), pa.array(days)], names=out.fieldNames())

    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    return obs.select("stock_id", "idx", "close").groupBy("stock_id").applyInArrow(recover, out)


def _regime_stress(obs: DataFrame, windows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """100 where the 20-day market volatility exceeds the median of its half-year volatility."""
    means = obs.where(F.col("ret").isNotNull()).groupBy(*scope, "idx").agg(F.avg("ret").alias("mr"))
    days = windows.select(
        "grp",
        F.least(F.lit(HALF_YEAR), F.col("hi_idx") - F.col("lo_idx") + 1).alias("w6"),
        (F.col("hi_idx") - F.col("lo_idx")).alias("n_ret"),
        F.explode(F.sequence("lo_idx", "hi_idx")).alias("idx"),
        F.col("lo_idx").alias("lo"),
    ).where(F.col("idx") > F.col("lo"))
    w = Window.partitionBy("grp").orderBy("idx")
    vols = (
        days.join(means, [*scope, "idx"], "left")
        .withColumn("rn", F.row_number().over(w))
        .withColumn("v20", F.when(F.count("mr").over(w.rowsBetween(-19, 0)) >= 20, F.stddev_samp("mr").over(w.rowsBetween(-19, 0))))
        .withColumn(
            "v126",
            F.when(
                (F.col("w6") == HALF_YEAR) & (F.count("mr").over(w.rowsBetween(-(HALF_YEAR - 1), 0)) >= HALF_YEAR),
                F.stddev_samp("mr").over(w.rowsBetween(-(HALF_YEAR - 1), 0)),
            ),
        )
    )
    return vols.groupBy("grp").agg(
        F.max_by("v20", "idx").alias("v20"), F.median("v126").alias("v126"), F.max("n_ret").alias("n_ret")
    )


def stop_loss(
    obs: DataFrame,
    windows: DataFrame,
    scope: Sequence[str] = (),
    error_bias: DataFrame | None = None,
    display: bool = True,
    cut: Callable[[DataFrame], DataFrame] = _same,
) -> DataFrame:
    """Stop-loss score (0-100, higher is riskier) with components per (grp, stock).

    ``display`` rounds scores to two and the drawdown to four decimals.
    """
    w6 = F.least(F.lit(HALF_YEAR), F.col("hi_idx") - F.col("lo_idx") + 1)
    w12 = F.least(F.lit(YEAR), F.col("hi_idx") - F.col("lo_idx") + 1)
    base = windows.select("grp", "lo_idx", "hi_idx", (F.col("hi_idx") - w6 + 1).alias("i6"), (F.col("hi_idx") - w12 + 1).alias("i12"))
    days = base.select("*", F.explode(F.array_union(F.sequence("i6", "hi_idx"), F.array("i12"))).alias("idx"))
    recent = F.col("idx") >= F.col("i6")
    ret = F.when(recent & (F.col("idx") > F.col("lo_idx")), F.col("ret"))
    now = F.col("idx") == F.col("hi_idx")
    feats = (
        obs.select(*scope, "stock_id", "idx", "close", "ret")
        .join(_side(days, scope), [*scope, "idx"])
        .groupBy("grp", "stock_id")
        .agg(
            F.max(F.when(now, F.col("close"))).alias("price"),
            F.max(F.when(recent, F.col("close"))).alias("high"),
            F.max(F.when(now, ret)).alias("ret_now"),
            F.avg(ret).alias("mean"),
            F.stddev_samp(ret).alias("std"),
            F.max(F.when(F.col("idx") == F.col("i6"), F.col("close"))).alias("p6"),
            F.max(F.when(F.col("idx") == F.col("i12"), F.col("close"))).alias("p12"),
        )
        .where(F.col("price").isNotNull())
        .withColumn("dd", (F.col("price") - F.col("high")) / F.col("high"))
        .withColumn("z", F.try_divide(F.col("ret_now") - F.col("mean"), F.col("std")))
    )
    feats = cut(feats)
    names = feats.groupBy("grp").agg(F.count(F.lit(1)).alias("n_names"))
    stress = _regime_stress(obs, windows, scope).join(names, "grp").select(
        "grp",
        "n_names",
        F.when(
            (F.col("n_ret") >= MONTH)
            & (F.col("v20") > F.when(F.col("n_names") > 5, F.col("v126")).otherwise(2.0 * F.col("v126"))),
            F.lit(100.0),
        )
        .otherwise(F.lit(0.0))
        .alias("regime_score"),
    )
    feats = feats.join(_side(stress, scope), "grp")
    ranks = [("dd", "p_dd", True), ("z", "p_z", True)]
    big = F.col("n_names") > 5
    if error_bias is not None:
        feats = feats.join(error_bias, ["grp", "stock_id"], "left").withColumn(
            "error_bias", F.coalesce("error_bias", F.lit(0.0))
        )
        ranks.append(("error_bias", "p_err", False))
    feats = _pct(cut(feats), scope, ranks)
    if error_bias is not None:
        err = F.when(big, F.col("p_err") * 100).otherwise(clip(F.col("error_bias") / 0.10 * 100, 0, 100))
    else:
        err = F.lit(0.0)
    dd_score = F.coalesce(F.when(big, F.col("p_dd") * 100).otherwise(clip(F.abs("dd") / 0.15 * 100, 0, 100)), F.lit(0.0))
    var_score = F.coalesce(
        F.when(big, F.col("p_z") * 100).when(F.col("z") < 0, clip(F.abs("z") / 3.0 * 100, 0, 100)), F.lit(0.0)
    )
    mom = F.when((F.col("price") / F.col("p6") - 1 < 0) & (F.col("price") / F.col("p12") - 1 < 0), F.lit(100.0)).otherwise(
        F.lit(0.0)
    )
    rrc = responsiveness(obs, windows, scope, cut).select("grp", "stock_id", "rrc_score")
    scored = (
        feats.withColumn("dd_score", dd_score)
        .withColumn("var_score", var_score)
        .withColumn("mom_score", mom)
        .withColumn("err_score", err)
        .join(rrc, ["grp", "stock_id"], "left")
    )
    raw = (
        W_DD * F.col("dd_score")
        + W_VAR * F.col("var_score")
        + W_MOM * F.col("mom_score")
        + W_ERR * F.col("err_score")
        + W_REGIME * F.col("regime_score")
    )
    sls = clip(0.90 * raw + 0.10 * (100.0 - F.coalesce("rrc_score", F.lit(NEUTRAL))), 0, 100)
    annual = F.coalesce(F.col("std") * F.lit(math.sqrt(252)), F.lit(0.15))
    two, four = (2, 4) if display else (None, None)
    return scored.withColumn("_sls", F.round(sls, 9)).select(
        "grp",
        "stock_id",
        rounded(F.col("_sls") + F.lit(1e-9 if display else 0.0), two).alias("stop_loss_score"),  # ties go up
        ladder("_sls", RISK_LEVELS, "Low").alias("risk_level"),
        ladder("_sls", ACTIONS, "Hold").alias("recommended_action"),
        rounded(F.col("high") * (1 - clip(2.5 * annual, 0.05, 0.30)), two).alias("trigger_threshold"),
        rounded("dd", four).alias("raw_drawdown"),
        *[rounded(c, two).alias(c) for c in ("dd_score", "var_score", "mom_score", "err_score", "regime_score")],
    )


def profiles(scores: DataFrame, requested: DataFrame) -> DataFrame:
    """Stop-loss profile of every requested (grp, stock); names without prices get the Unknown default."""
    zero = F.lit(0.0)
    return requested.join(scores, ["grp", "stock_id"], "left").select(
        "grp",
        "stock_id",
        F.coalesce("stop_loss_score", zero).alias("stop_loss_score"),
        F.coalesce("risk_level", F.lit("Unknown")).alias("risk_level"),
        F.coalesce("recommended_action", F.lit("Hold")).alias("recommended_action"),
        F.coalesce("trigger_threshold", zero).alias("trigger_threshold"),
        F.coalesce("raw_drawdown", zero).alias("raw_drawdown"),
        "dd_score",
        "var_score",
        "mom_score",
        "err_score",
        "regime_score",
    )


def own_market_responsiveness(cut: DataFrame) -> DataFrame:
    """Responsiveness of single stocks, each its own market (beta and correlation are 1 throughout).

    cut(grp, stock_id, idx, close, ret, ...): every stock's rows inside its look-back.
    The spike and recovery parts run per stock; nothing is broadcast, because
    there are as many groups as stocks.
    """
    part = Window.partitionBy("grp")
    order = part.orderBy("idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        cut.withColumn("row", F.row_number().over(order) - 1)
        .withColumn("n", F.count(F.lit(1)).over(part))
        .withColumn("r", F.when(F.col("row") == 0, F.lit(0.0)).otherwise(F.coalesce("ret", F.lit(0.0))))
        .withColumn(
            "vol30", F.when(F.col("row") >= 29, F.round(F.stddev_samp("r").over(order.rowsBetween(-29, 0)), 12))
        )
        .withColumn("hi", F.coalesce(F.col("vol30") > F.percentile("vol30", F.lit(0.75)).over(part), F.lit(False)))
        .withColumn("onset", F.col("hi") & ~F.coalesce(F.lag("hi").over(order), F.lit(True)))
        .withColumn("next10", F.collect_list("close").over(order.rowsBetween(0, 9)))
        .withColumn("peak", F.max(F.when(F.col("row") >= F.col("n") - YEAR, F.col("close"))).over(upto))
        .withColumn(
            "dd", F.when(F.col("row") >= F.col("n") - YEAR, (F.col("close") - F.col("peak")) / F.col("peak"))
        )
        .withColumn("worst", F.min("dd").over(part))
        .withColumn("trough", F.min(F.when(F.col("dd") == F.col("worst"), F.col("row"))).over(part))
    )
    deepest = deepest_drawdown("next10")
    spikes = F.map_from_entries(F.collect_list(F.when(F.col("onset"), F.struct("row", deepest.alias("d")))))
    out = rows.groupBy("grp", "stock_id").agg(
        F.max("n").alias("n_rows"),
        spikes.alias("by_row"),
        spike_starts(F.collect_list(F.when(F.col("onset"), F.col("row")))).alias("starts"),
        F.max("worst").alias("worst"),
        F.max("trough").alias("trough"),
        F.min(
            F.when((F.col("row") >= F.col("trough")) & (F.col("dd") >= F.col("worst") / 2), F.col("row"))
        ).alias("back"),
    )
    total = F.aggregate(
        F.transform("starts", lambda s: F.element_at("by_row", s)), F.lit(0.0), lambda a, x: a + x
    )
    spike_dd = F.coalesce(F.try_divide(total, F.size("starts")), F.lit(0.0))
    taken = F.coalesce((F.col("back") - F.col("trough") + 1).cast("double"), F.lit(float(YEAR)))
    rec = F.when(F.col("worst") < -0.05, taken).otherwise(F.lit(0.0))
    score = 100 * (
        0.30 * clip(1 + F.col("spike_dd") / 0.10, 0, 1)
        + 0.25 * 0.5
        + 0.25 * clip(1 - F.col("recovery_days") / 60.0, 0, 1)
        + 0.20 * 0.5
    )
    return (
        out.withColumn("spike_dd", spike_dd)
        .withColumn("recovery_days", rec)
        .select(
            "stock_id",
            F.when(F.col("n_rows") < HALF_YEAR, F.lit(NEUTRAL)).otherwise(clip(score, 0, 100)).alias("rrc_score"),
            "spike_dd",
            "recovery_days",
        )
    )


def own_market_stop_loss(cut: DataFrame, display: bool = True) -> DataFrame:
    """Stop-loss profile of single stocks, each scored alone with the absolute maps.

    cut(grp, stock_id, idx, close, ret): every stock's rows inside its look-back.
    """
    part = Window.partitionBy("grp")
    order = part.orderBy("idx")
    rows = (
        cut.withColumn("row", F.row_number().over(order) - 1)
        .withColumn("n", F.count(F.lit(1)).over(part))
        .withColumn("back", F.col("n") - 1 - F.col("row"))
        .withColumn("r", F.when(F.col("row") > 0, F.col("ret")))
        .withColumn("w6", F.least(F.lit(HALF_YEAR), F.col("n")))
        .withColumn("v20", F.when(F.col("row") >= 20, F.stddev_samp("r").over(order.rowsBetween(-19, 0))))
        .withColumn(
            "v126",
            F.when(
                (F.col("w6") == HALF_YEAR) & (F.col("row") >= HALF_YEAR),
                F.stddev_samp("r").over(order.rowsBetween(-(HALF_YEAR - 1), 0)),
            ),
        )
    )
    recent = F.col("back") < HALF_YEAR
    f = rows.groupBy("grp", "stock_id").agg(
        F.max("n").alias("n"),
        F.max_by("close", "idx").alias("price"),
        F.max(F.when(recent, F.col("close"))).alias("high"),
        F.max_by("r", "idx").alias("ret_now"),
        F.avg(F.when(recent, F.col("r"))).alias("mean"),
        F.stddev_samp(F.when(recent, F.col("r"))).alias("std"),
        F.max(F.when(F.col("back") == F.least(F.lit(HALF_YEAR), F.col("n")) - 1, F.col("close"))).alias("p6"),
        F.max(F.when(F.col("back") == F.least(F.lit(YEAR), F.col("n")) - 1, F.col("close"))).alias("p12"),
        F.max_by("v20", "idx").alias("v20"),
        F.median("v126").alias("v126"),
    )
    z = F.try_divide(F.col("ret_now") - F.col("mean"), F.col("std"))
    dd = (F.col("price") - F.col("high")) / F.col("high")
    f = (
        f.withColumn("dd", dd)
        .withColumn("dd_score", clip(F.abs("dd") / 0.15 * 100, 0, 100))
        .withColumn("var_score", F.coalesce(F.when(z < 0, clip(F.abs(z) / 3.0 * 100, 0, 100)), F.lit(0.0)))
        .withColumn(
            "mom_score",
            F.when((F.col("price") / F.col("p6") < 1) & (F.col("price") / F.col("p12") < 1), F.lit(100.0)).otherwise(
                F.lit(0.0)
            ),
        )
        .withColumn("err_score", F.lit(0.0))
        .withColumn(
            "regime_score",
            F.when((F.col("n") - 1 >= MONTH) & (F.col("v20") > 2.0 * F.col("v126")), F.lit(100.0)).otherwise(F.lit(0.0)),
        )
        .join(own_market_responsiveness(cut).select("stock_id", "rrc_score"), "stock_id", "left")
    )
    raw = (
        W_DD * F.col("dd_score") + W_VAR * F.col("var_score") + W_MOM * F.col("mom_score") + W_REGIME * F.col("regime_score")
    )
    sls = clip(0.90 * raw + 0.10 * (100.0 - F.coalesce("rrc_score", F.lit(NEUTRAL))), 0, 100)
    annual = F.coalesce(F.col("std") * F.lit(math.sqrt(252)), F.lit(0.15))
    two, four = (2, 4) if display else (None, None)
    return f.withColumn("_sls", F.round(sls, 9)).select(
        "stock_id",
        rounded(F.col("_sls") + F.lit(1e-9 if display else 0.0), two).alias("stop_loss_score"),  # ties go up
        ladder("_sls", RISK_LEVELS, "Low").alias("risk_level"),
        ladder("_sls", ACTIONS, "Hold").alias("recommended_action"),
        rounded(F.col("high") * (1 - clip(2.5 * annual, 0.05, 0.30)), two).alias("trigger_threshold"),
        rounded("dd", four).alias("raw_drawdown"),
        *[rounded(c, two).alias(c) for c in ("dd_score", "var_score", "mom_score", "err_score", "regime_score")],
    )
