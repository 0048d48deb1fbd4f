"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252
SQRT_YEAR = math.sqrt(TRADING_DAYS)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def ratio(a: Column | str, b: Column | str, default: float | None = None) -> Column:
    """a / b, or ``default`` where b is zero or null."""
    out = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def no_nan(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def rounded(c: Column | str, digits: int | None = 6) -> Column:
    """Round and drop the sign of zero; ``None`` leaves the value as it is."""
    if digits is None:
        return col(c)
    return F.round(col(c), digits) + F.lit(0.0)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation that is null (not an error) for a constant series."""
    return F.try_divide(F.covar_samp(col(x), col(y)), F.stddev_samp(col(x)) * F.stddev_samp(col(y)))


def linear_score(raw: Column | str, bad: Column | float, good: float = 0.0) -> Column:
    """100 at ``good`` falling to 0 at ``bad``; 50 when the scale is empty."""
    bad_c = bad if isinstance(bad, Column) else F.lit(float(bad))
    frac = F.try_divide(col(raw) - F.lit(good), bad_c - F.lit(good))
    return F.when(bad_c <= F.lit(good), F.lit(50.0)).otherwise(clip(F.lit(100.0) * (F.lit(1.0) - frac), 0, 100))


def minmax(value: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Position of value in [lo, hi]; 0.5 when the range is flat."""
    value, lo, hi = col(value), col(lo), col(hi)
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(F.lit(0.5))


def ladder(value: Column | str, steps: list[tuple[float, str]], default: str) -> Column:
    """First label whose inclusive lower bound the value reaches."""
    value = col(value)
    out: Column | None = None
    for bound, label in steps:
        cond = value >= F.lit(float(bound))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def months_between_30(start: Column | str, end: Column | str) -> Column:
    """12 * years + months + days / 30 (not Spark's 31-day fraction)."""
    s, e = col(start), col(end)
    return (
        F.lit(12.0) * (F.year(e) - F.year(s))
        + (F.month(e) - F.month(s))
        + (F.dayofmonth(e) - F.dayofmonth(s)) / F.lit(30.0)
    )


def month_diff(start: Column | str, end: Column | str) -> Column:
    s, e = col(start), col(end)
    return F.lit(12) * (F.year(e) - F.year(s)) + (F.month(e) - F.month(s))


def listed_symbol(c: Column | str) -> Column:
    """Upper-case, trimmed symbol with the ``.NS`` suffix when it has no exchange suffix."""
    s = F.upper(F.trim(col(c)))
    return F.when(s.endswith(".NS") | s.contains("."), s).otherwise(F.concat(s, F.lit(".NS")))


def flags(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the labels whose condition holds."""
    items = [F.when(cond, label if isinstance(label, Column) else F.lit(label)) for cond, label in pairs]
    return F.array_compact(F.array(*items))


def one_decimal(value: Column) -> Column:
    """Text of a value from 0 on with one decimal, rounded by its exact binary value, ties to even, as C's printf does.

    ``format_string`` rounds the shortest decimal text instead: it makes 0.2 of 0.15, which is a little less than that.
    The fraction is scaled by a power of two, which is exact, and its tenths are taken in whole numbers.
    """
    bits = 58
    whole = F.floor(value)
    tenths = ((value - whole) * F.lit(float(1 << bits))).cast("long") * F.lit(10)
    down, rest, half = F.shiftright(tenths, bits), tenths.bitwiseAND(F.lit((1 << bits) - 1)), F.lit(1 << (bits - 1))
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    total = whole * 10 + down + up.cast("long")
    return F.concat(F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"))
