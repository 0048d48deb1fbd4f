"""As-of joins on date lists without a theta join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_dates(left: DataFrame, right: DataFrame, on: str, right_date: str, out: str, direction: str) -> DataFrame:
    """Nearest right date on or before (``backward``) or on or after (``forward``) each left date.

    Both inputs are date lists (one row per day at most), so the single ordered
    window runs over a calendar-sized table.
    """
    l = left.select(F.col(on).alias("_d")).distinct().withColumn("_r", F.lit(None).cast("date"))
    r = right.select(F.col(right_date).alias("_d")).distinct().withColumn("_r", F.col("_d"))
    both = l.unionByName(r).groupBy("_d").agg(F.max("_r").alias("_r"))
    w = Window.partitionBy(F.lit(0)).orderBy("_d")
    if direction == "backward":
        hit = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        hit = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    mapped = both.select(F.col("_d").alias(on), hit.alias(out))
    return left.join(F.broadcast(mapped), on, "left")
