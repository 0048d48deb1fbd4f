"""Connected components of a link table, by repeated contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfold.tables import Stage


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """node, comp (the smallest node it reaches) for all nodes in ``links`` (a, b).

    Each round points every node at its smallest neighbour, follows the pointers
    once and contracts the links; a round at least halves the nodes that still
    have links. Links and pointers stay in tables; ``links`` should be one, since it is
    read more than once.
    """
    rounds: list[DataFrame] = []
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    # every link in both directions
    ends = links.filter(F.col("a") != F.col("b")).select(both.alias("end")).select("end.*")
    while True:
        near = ends.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("to"))
        onward = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
        pointers = stage.cut(near.join(onward, "to").select("node", F.col("next").alias("to")))
        rounds.append(pointers)
        left = pointers.select("node", F.col("to").alias("ta"))
        right = pointers.select(F.col("node").alias("other"), F.col("to").alias("tb"))
        moved = ends.join(left, "node").join(right, "other").select(F.col("ta").alias("node"), F.col("tb").alias("other"))
        ends = stage.cut(moved.filter("node <> other").distinct())
        if ends.isEmpty():
            break
    comp = rounds[0].withColumnRenamed("to", "comp")
    if len(rounds) == 1:
        return comp
    for pointers in rounds[1:]:
        later = pointers.select(F.col("node").alias("comp"), F.col("to").alias("later"))
        comp = comp.join(later, "comp", "left").select("node", F.coalesce("later", "comp").alias("comp"))
    return stage.cut(comp)
