"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.store import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "graph", rounds: int = 60) -> DataFrame:
    """From edges (a, b): (node, root) with the smallest node of each component, for all nodes with an edge but the roots.

    The edges are read again and again, so they should be a table that is written
    down.  Large-star and small-star steps in turn until only stars are left; each
    step's edges are written down, and those of the step before deleted.  Minima are
    aggregated before they are shuffled; the join on a node with very many edges
    is split by Spark's skew-join handling.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    k = 0
    while not settled(now):
        if (k := k + 1) > rounds:
            raise RuntimeError("components did not settle")
        # Large star: all larger neighbours of a node move to the smallest of it and its neighbours.
        both = _both(now)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours move to the smallest.
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        moved = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = scratch.keep(moved.filter("u <> v").distinct(), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars around smallest nodes, none repeated: each node has larger neighbours only, or one edge to a smaller one."""
    near = _both(edges).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    return near.filter("m < u and c > 1").agg(F.count("*")).first()[0] == 0


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For some edges, as they fit into memory, the other nodes of their components and the smallest one of each."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    least = np.arange(len(nodes))
    while (least[u] != least[v]).any():
        low = np.minimum(least[u], least[v])
        np.minimum.at(least, least[u], low)
        np.minimum.at(least, least[v], low)
        while (least[least] != least).any():
            least = least[least]
    other = least != np.arange(len(nodes))
    return nodes[other], nodes[least[other]]
