"""Maplets over one another: which read the same ground, and what each says of the other's heights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.vec import add, apply, dot, mat, sub, transposed, vec
from regolith.operators.growth import intersect_fields
from regolith.operators.observe import local

#: Neighbours, by their number, whose grids are searched in one call.
TOGETHER = 16
_FRAME = ["ny", "nx", "spacing", "ox", "oy", "oz", *[f"b{i}{j}" for i in range(3) for j in range(3)]]


def grids(samples: DataFrame) -> DataFrame:
    """Each maplet's heights as one array, row by row, null where invalid: k, grid.  A grid's size is bounded."""
    one = F.struct("r", "c", F.when(F.col("valid"), F.col("h")).alias("h"))
    return samples.groupBy("k").agg(F.sort_array(F.collect_list(one)).alias("g")).select("k", F.col("g.h").alias("grid"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs a < b as (k, other) of either direction."""
    return pairs.select(F.col("a").alias("k"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("k"), F.col("a").alias("other")))


def across(directions: DataFrame, samples: DataFrame, maplets: DataFrame) -> DataFrame:
    """Valid samples (k, r, c) in the frame of the other maplet of each direction (k, other): x, y, z, the base point b0 .. b2 at height 0 and the own normal n0 .. n2."""
    own = maplets.select("k", *_FRAME)
    theirs = maplets.select(F.col("k").alias("other"), *[F.col(c).alias(f"o_{c}") for c in _FRAME if c not in ("ny", "nx", "spacing")])
    j = directions.join(own, "k").join(theirs, "other")
    # A sample's place in the body's frame comes first, as whoever reads it off a maplet has it: far from the origin it is
    # rounded there, and a difference of origins taken before would not be rounded alike.
    turn = transposed(mat("o_b"))
    normal = apply(turn, vec("b02", "b12", "b22"))
    d = samples.filter("valid").select("k", "r", "c", "h").join(j, "k")
    u, v = local(F.col("nx"), F.col("ny"), F.col("spacing"))
    place = add(vec("ox", "oy", "oz"), apply(mat("b"), (u, v, F.lit(0.0))))
    base = apply(turn, sub(place, vec("o_ox", "o_oy", "o_oz")))
    d = d.select("k", "other", "r", "c", "h", *[x.alias(f"b{i}") for i, x in enumerate(base)], *[x.alias(f"n{i}") for i, x in enumerate(normal)])
    return d.select("*", *[(F.col(f"b{i}") + F.col("h") * F.col(f"n{i}")).alias(a) for i, a in enumerate("xyz")])


def heights_below(points: DataFrame, samples: DataFrame, maplets: DataFrame) -> DataFrame:
    """For points (other, x, y, ...) in a maplet's frame its bilinear height there, `below`; null outside and where a corner of weight is invalid."""
    g = grids(samples).join(maplets.select("k", "ny", "nx", "spacing"), "k").select(F.col("k").alias("other"), F.col("ny").alias("ny__"), F.col("nx").alias("nx__"), F.col("spacing").alias("sp__"), "grid")
    j = points.join(g, "other")
    u, v = F.col("x") / F.col("sp__") + (F.col("nx__") - 1) / F.lit(2.0), F.col("y") / F.col("sp__") + (F.col("ny__") - 1) / F.lit(2.0)
    inside = (u >= 0) & (v >= 0) & (u <= F.col("nx__") - 1) & (v <= F.col("ny__") - 1)
    j = j.select("*", F.when(inside, u).alias("u__"), F.when(inside, v).alias("v__"))
    j = j.select("*", F.floor("u__").cast("int").alias("i__"), F.floor("v__").cast("int").alias("j__"))
    dx, dy, at, one = F.col("u__") - F.col("i__"), F.col("v__") - F.col("j__"), F.col("j__") * F.col("nx__") + F.col("i__"), F.lit(1.0)
    total = F.lit(0.0)
    for w, n in (((one - dx) * (one - dy), at), (dx * (one - dy), at + 1), ((one - dx) * dy, at + F.col("nx__")), (dx * dy, at + F.col("nx__") + 1)):
        total = total + F.when(w == 0, 0.0).otherwise(w * F.get("grid", n.cast("int")))
    return j.select(*points.columns, F.when(F.col("u__").isNotNull(), total).alias("below"))


def agreeing(pairs: DataFrame, samples: DataFrame, maplets: DataFrame, share: float = 0.25) -> DataFrame:
    """Of candidate pairs a < b those of which either reads some of the other's samples at their height, to a share of its spacing: a, b, n (such samples)."""
    d = heights_below(across(both_ways(pairs), samples, maplets), samples, maplets).join(maplets.select(F.col("k").alias("other"), F.col("spacing").alias("step__")), "other")
    near = d.filter(F.abs(F.col("below") - F.col("z")) <= F.lit(share) * F.col("step__"))
    return near.groupBy(F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b")).agg(F.count("*").alias("n"))


def ray_anchors(edges: DataFrame, samples: DataFrame, maplets: DataFrame, explicit: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """What neighbours say of a maplet's heights: for each valid sample whose normal line meets a neighbour's surface the height of that place along
    the line: k, r, c, other, weight, height.  Samples with an explicit correspondence (k, r, c, other) are left out.

    A line follows the maplet's own normal, not the neighbour's, so the place is found by search, in a few neighbours' bounded grids at a time.
    """
    rays = across(both_ways(edges), samples, maplets)
    if explicit is not None:
        rays = rays.join(explicit, ["k", "r", "c", "other"], "left_anti")
    rays = rays.select("k", "other", "r", "c", *[f"{n}{i}" for n in "bn" for i in range(3)])
    fields = grids(samples).join(maplets.select("k", "ny", "nx", "spacing"), "k").withColumnRenamed("k", "other")

    def meet(lines: pd.DataFrame, fields: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"k": [], "r": [], "c": [], "other": [], "height": []})]
        for (ny, nx), some in fields.groupby(["ny", "nx"]):
            grid = np.array([[np.nan if x is None else x for x in g] for g in some["grid"]], float).reshape(len(some), int(ny), int(nx))
            own = lines[lines["other"].isin(some["other"])]
            of = pd.Index(some["other"]).get_indexer(own["other"])
            t, ok = intersect_fields(np.nan_to_num(grid), ~np.isnan(grid), some["spacing"].to_numpy(float), of, own[["b0", "b1", "b2"]].to_numpy(float), own[["n0", "n1", "n2"]].to_numpy(float))
            out.append(own[["k", "r", "c", "other"]].assign(height=t)[ok])
        return pd.concat(out).astype({"k": "int64", "r": "int64", "c": "int64", "other": "int64", "height": "float64"})

    some = F.floor(F.col("other") / TOGETHER)
    met = rays.groupBy(some.alias("some")).cogroup(fields.groupBy(some.alias("some"))).applyInPandas(meet, "k long, r long, c long, other long, height double")
    return met.select("k", "r", "c", "other", F.lit(float(weight)).alias("weight"), "height")


def explicit_anchors(pairs: DataFrame, samples: DataFrame, maplets: DataFrame) -> DataFrame:
    """Correspondences (k, r, c, other, orow, ocol, weight) as heights along the own normal: k, r, c, other, weight, height."""
    there = samples.filter("valid").select(F.col("k").alias("other"), F.col("r").alias("orow"), F.col("c").alias("ocol"), F.col("h").alias("oh"))
    frame = lambda p, key: maplets.select(F.col("k").alias(key), *[F.col(c).alias(f"{p}{c}") for c in _FRAME])
    j = pairs.join(there, ["other", "orow", "ocol"]).join(frame("o_", "other"), "other").join(frame("m_", "k"), "k")
    u = (F.col("ocol") - (F.col("o_nx") - 1) / F.lit(2.0)) * F.col("o_spacing")
    v = (F.col("orow") - (F.col("o_ny") - 1) / F.lit(2.0)) * F.col("o_spacing")
    p = add(vec("o_ox", "o_oy", "o_oz"), apply(mat("o_b"), (u, v, F.col("oh"))))
    height = dot(sub(p, vec("m_ox", "m_oy", "m_oz")), vec("m_b02", "m_b12", "m_b22"))
    own = samples.filter("valid").select("k", "r", "c")
    return j.select("k", "r", "c", "other", "weight", height.alias("height")).join(own, ["k", "r", "c"], "left_semi")
