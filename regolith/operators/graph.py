"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.scratch import keep


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From edges (a, b) of any orderable type: (node, root), root the smallest node of the component.

    Every node hooks itself and its neighbours onto the smallest node it sees; then hooks are
    shortened by following them once.  Rounds are written down; the loop ends when nothing moves.
    """
    both = keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        lower = labels.join(near, "node").select("node", "root", F.least("root", "r").alias("next"))
        # the old root learns what its members found
        told = lower.groupBy(F.col("root").alias("node")).agg(F.min("next").alias("up"))
        hooked = lower.join(told, "node", "left").select("node", "root", F.least("next", F.coalesce("up", "next")).alias("next"))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = keep(hooked.join(jump, "next", "left").select("node", F.col("root").alias("before"), F.least("next", F.coalesce("far", "next")).alias("root")))
        moved = after.filter("before <> root").limit(1).count()
        labels = after.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
