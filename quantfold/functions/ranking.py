"""Exact ranks inside groups of any size.

A plain ``rank() OVER (PARTITION BY g)`` sends a whole group to one task. Here
each group is first cut into value ranges (a monotone function of the value, so
order is kept), ranks are taken inside the ranges, and the sizes of the lower
ranges are added. A hot group is spread over ``pieces`` tasks; the only data that
is gathered per group is one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 32


def _pieces(df: DataFrame, group: Sequence[str], pieces: int, scale: float | None) -> DataFrame:
    if scale is not None:
        at = F.floor((F.tanh(F.col("_k") / F.lit(scale)) + 1) / 2 * F.lit(pieces))
        return df.withColumn("_piece", F.least(F.lit(pieces - 1), at).cast("int"))
    span = df.groupBy(*group).agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    at = F.floor((F.col("_k") - F.col("_lo")) / width * F.lit(pieces))
    return (
        df.join(span, list(group))
        .withColumn("_piece", F.when(width > 0, F.least(F.lit(pieces - 1), at)).otherwise(F.lit(0)).cast("int"))
        .drop("_lo", "_hi")
    )


def with_rank(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    *,
    out: str,
    kind: str = "dense",
    descending: bool = True,
    pieces: int = PIECES,
    keep_nulls: bool = True,
    scale: float | None = None,
    piece: str | None = None,
) -> DataFrame:
    """Add a rank of ``value`` inside ``group``; rows with a null value get null
    (or are left out with ``keep_nulls=False``). Ranges are equal parts of each
    group's span; with ``scale``, the typical size of a value centred on zero,
    they are parts of a fixed S-curve and the pass for the span is saved. ``piece`` names a
    column for the number of a row's range: aggregates by group and range need no exchange.

    kind: ``dense``, ``min`` (competition) or ``pct`` (average rank of ties over
    the number of non-null values, as in a percent rank with averaged ties).
    """
    keyed = df.withColumn("_k", F.col(value).cast("double") * F.lit(-1.0 if descending else 1.0))
    filled = _pieces(keyed.where(F.col("_k").isNotNull()), group, pieces, scale)
    part = [*group, "_piece"]
    w = Window.partitionBy(*part).orderBy("_k")
    local = filled.withColumn("_dense", F.dense_rank().over(w)).withColumn("_min", F.rank().over(w))
    if kind == "pct":
        local = local.withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy(*part, "_k")))
    sizes = local.groupBy(*part).agg(F.max("_dense").alias("_nd"), F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.withColumn("_od", F.coalesce(F.sum("_nd").over(below), F.lit(0)))
        .withColumn("_om", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
        .drop("_nd", "_n")
    )
    ranked = local.join(offsets, part)
    if kind == "dense":
        ranked = ranked.withColumn(out, (F.col("_dense") + F.col("_od")).cast("int"))
    elif kind == "min":
        ranked = ranked.withColumn(out, (F.col("_min") + F.col("_om")).cast("int"))
    elif kind == "pct":
        avg_rank = F.col("_min") + F.col("_om") + (F.col("_ties") - 1) / F.lit(2.0)
        ranked = ranked.withColumn(out, avg_rank / F.col("_total"))
    else:
        raise ValueError(f"unknown rank kind {kind!r}")
    columns = [*df.columns, out]
    if piece:
        ranked, keyed = ranked.withColumn(piece, F.col("_piece")), keyed.withColumn(piece, F.lit(None).cast("int"))
        columns.append(piece)
    if not keep_nulls:
        return ranked.select(*columns)
    empty = keyed.where(F.col("_k").isNull()).withColumn(out, F.lit(None).cast(ranked.schema[out].dataType))
    return ranked.select(*columns).unionByName(empty.select(*columns))


def pct_ranks(
    df: DataFrame, group: str, key: str, specs: Sequence[tuple[str, str, bool]], *, pieces: int = PIECES
) -> DataFrame:
    """Percent ranks of several columns in one pass.

    specs: (value column, output column, descending). The values are stacked
    into one long table whose rank group is (group, column), so the plan grows
    with the number of columns, not exponentially. Hand in a staged ``df``: it
    is read several times.
    """
    stacked = df.select(
        group,
        key,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(out).alias("_what"), (F.col(v) * F.lit(-1.0 if desc else 1.0)).alias("_v"))
                    for v, out, desc in specs
                ]
            )
        ).alias("_s"),
    ).select(group, key, "_s._what", "_s._v")
    ranked = with_rank(
        stacked.where(F.col("_v").isNotNull()), [group, "_what"], "_v", out="_r", kind="pct", descending=False, pieces=pieces, keep_nulls=False
    )
    wide = ranked.groupBy(group, key).agg(
        *[F.max(F.when(F.col("_what") == out, F.col("_r"))).alias(out) for _, out, _ in specs]
    )
    return df.join(wide, [group, key], "left")


def small_group_pct_rank(df: DataFrame, group: Sequence[str], value: str, *, out: str, descending: bool) -> DataFrame:
    """Percent rank with averaged ties for groups of bounded size (a selected portfolio)."""
    v = F.col(value)
    order = v.desc_nulls_last() if descending else v.asc_nulls_last()
    rank = F.rank().over(Window.partitionBy(*group).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    n = F.count(v).over(Window.partitionBy(*group))
    return df.withColumn(out, F.when(v.isNotNull(), (rank + (ties - 1) / F.lit(2.0)) / n))
