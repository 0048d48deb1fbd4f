"""Mixing sources to target weights by Pareto order sampling.

Sources, in code point order with null last, get the weights 5, 2, 1, repeating,
and share all words by weight; no target exceeds ``most_copies`` times its
source's words, and what a capped source cannot take is shared by weight among
the others. A document is expected ``target / words of its source`` times (times
its relative ``weight``, if that column is named). The whole part of that number
is certain; its fraction p is an inclusion probability, and with a uniform number
u that depends on ``doc_id`` and ``seed`` alone, documents are ranked by

    (u / (1 - u)) / (p / (1 - p))

and taken in that order until the source's words come nearest to its target.

The cut is found by counting: words per range of the rank, then per range inside
the range that holds the cut, then row by row inside that narrow range. No
source is ever sorted as a whole.

Defined cases: null and blank texts have size 0 and take nothing; a source
without words has target 0; rows that repeat an id share their random number and
are taken by size; equal rows are interchangeable; an empty table gives an empty
result; columns other than ``doc_id``, ``text``, ``source`` and the weight are
not read. The table of sources is ordered as a whole (one row per source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfold.llm.common import small, words
from quantfold.tables import Stage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
RANGES = 4096
LEVELS = 2
SEED = "mix-1"


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target; one row per source of ``sizes`` (source, size)."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(named) - 1) % len(weights))
    weighed = per_source.withColumn("w", weight).withColumn("cap", most_copies * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    filled = weighed.withColumn("level", level).withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
    water = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("water", water).select(
        "source", "source_size", F.when(F.col("free"), F.col("water") * F.col("w")).otherwise(F.col("cap").cast("double")).alias("target")
    )


def _cut(ranged: DataFrame, need: DataFrame, step: str, name: str) -> DataFrame:
    """source, cut and what is still needed inside it: the first range at which the words reach ``need``."""
    per_range = ranged.groupBy("source", step).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy(step)
    reached = per_range.withColumn("up_to", F.sum("words").over(running)).join(
        need.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    )
    at = F.min(F.when(F.col("up_to") >= F.col("need"), F.struct(F.col(step).alias("cut"), (F.col("need") - (F.col("up_to") - F.col("words"))).alias("left"))))
    return reached.groupBy("source").agg(at.alias("at")).select("source", F.col("at.cut").alias(name), F.col("at.left").alias("need"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    weight: str | None = None,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken (words, repeats counted).

    ``weight`` names a column of positive relative weights; a document's expected
    copies stop at ``most_copies``, so a source with extreme weights may take less
    than its target.
    """
    stage = Stage(docs.sparkSession, "mix")
    relative = F.col(weight).cast("double") if weight else F.lit(1.0)
    sized = stage.plain(
        "sized",
        docs.select(
            "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
            uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed).alias("u"), relative.alias("rel"),
        ),
    )
    goals = stage.plain("targets", targets(sized, weights, most_copies))
    mean = sized.groupBy("source").agg(F.try_divide(F.sum(F.col("rel") * F.col("size")), F.sum("size")).alias("mean_rel"))
    per_source = goals.join(mean.withColumnRenamed("source", "ms"), F.col("source").eqNullSafe(F.col("ms"))).drop("ms")
    of = per_source.withColumnRenamed("source", "gs")
    expected = F.least(F.lit(float(most_copies)), F.col("target") / F.col("source_size") * F.col("rel") / F.col("mean_rel"))
    odds = lambda x: x / (1 - x)
    ranked = (
        sized.join(small(of), F.col("source").eqNullSafe(F.col("gs")), "left")
        .drop("gs")
        .withColumn("expected", F.when(F.col("size") > 0, expected).otherwise(0.0))
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("key", F.when(F.col("p") > 0, odds(F.col("u")) / odds(F.col("p"))))
        .withColumn("part", F.col("key") / (1 + F.col("key")))
        .select(
            "doc_id", "source", "size", "source_size", "target", "whole", "key",
            *[F.floor(F.col("part") * float(RANGES ** (k + 1))).alias(f"r{k}") for k in range(LEVELS)],
        )
    )
    need = (
        ranked.groupBy("source")
        .agg(F.max("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("certain"))
        .select("source", (F.col("target") - F.col("certain")).alias("need"))
        .filter(F.col("need") > 0)
    )
    cuts = need.select("source", F.lit(True).alias("opened"))
    inside = ranked.filter(F.col("key").isNotNull())
    for k in range(LEVELS):
        found = stage.plain(f"cut{k}", _cut(inside, need, f"r{k}", f"c{k}"))
        at = found.select(F.col("source").alias("fs"), f"c{k}")
        cuts = cuts.join(at, F.col("source").eqNullSafe(F.col("fs")), "left").drop("fs")
        inside = inside.join(small(at), F.col("source").eqNullSafe(F.col("fs")) & (F.col(f"r{k}") == F.col(f"c{k}")), "left_semi")
        need = found.filter(F.col(f"c{k}").isNotNull()).select("source", "need")
    cuts = stage.plain("cuts", cuts)
    running = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("up_to") - F.col("size")
    nearer = (F.col("up_to") <= F.col("need")) | ((before < F.col("need")) & (F.col("up_to") - F.col("need") < F.col("need") - before))
    last = (
        inside.withColumn("up_to", F.sum("size").over(running))
        .join(small(need.withColumnRenamed("source", "ns")), F.col("source").eqNullSafe(F.col("ns")))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + nearer.cast("long")).alias("copies"))
    )
    placed = ranked.join(small(cuts.withColumnRenamed("source", "cs")), F.col("source").eqNullSafe(F.col("cs")), "left")
    in_last = F.coalesce("opened", F.lit(False)) & F.col("key").isNotNull()
    below = F.lit(False)
    for k in range(LEVELS):
        c, r = F.col(f"c{k}"), F.col(f"r{k}")
        # no cut: the words do not reach the need, so every row of the range is taken
        below = below | (in_last & (c.isNull() | (r < c)))
        in_last = in_last & c.isNotNull() & (r == c)
    placed = placed.withColumns({"below": F.coalesce(below, F.lit(False)), "in_last": F.coalesce(in_last, F.lit(False))})
    rest = placed.filter(~F.col("in_last")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("below").cast("long")).alias("copies")
    )
    return rest.unionByName(last).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
