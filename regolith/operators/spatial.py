"""Spatial joins over grid buckets: every join is an equi-join on cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.scratch import keep
from regolith.functions.vec import cross, dot, sub, vec


def _cell(size: float, *axes: str) -> list:
    return [F.floor(F.col(a) / F.lit(float(size))).cast("long") for a in axes]


def _around(df: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Each row in its own cell and all that touch it: columns g0, g1, ..."""
    out = df.select("*", *[c.alias(f"g{i}") for i, c in enumerate(_cell(size, *axes))])
    for i in range(len(axes)):
        out = out.withColumn(f"g{i}", F.explode(F.array(*[F.col(f"g{i}") + d for d in (-1, 0, 1)])))
    return out


def _candidates(queries: DataFrame, refs: DataFrame, size: float) -> DataFrame:
    """Pairs (qid, rid, d2) of points in touching cells."""
    q = _around(queries.select("qid", "x", "y", "z"), size)
    r = refs.select("rid", *[F.col(a).alias(f"r{a}") for a in "xyz"])
    r = r.select("*", *[F.floor(F.col(f"r{a}") / F.lit(float(size))).cast("long").alias(f"g{i}") for i, a in enumerate("xyz")])
    d = sub(vec("x", "y", "z"), vec("rx", "ry", "rz"))
    return q.join(r, ["g0", "g1", "g2"]).select("qid", "rid", dot(d, d).alias("d2"))


def radius_pairs(queries: DataFrame, refs: DataFrame, radius: float) -> DataFrame:
    """All pairs within the radius (inclusive): qid, rid, d2."""
    return _candidates(queries, refs, radius).filter(F.col("d2") <= F.lit(radius * radius))


#: Others that a reference has in its cell, on average, at most; references, and coarse cells, that a query meets all of; bits by
#: which a level's cells are coarser than the next one's; references that the cell size is told by; and what rounding may do to a cell's side.
FILL, FEW, BITS, TELLING, SLACK = 2.0, 256, 2, 50_000, 1e-6
_PLACE = ["x", "y", "z"]
_CELL = ["g0", "g1", "g2"]


@dataclass
class Places:
    """References put in order for searches: places with their smallest id and their cells (g0 .. g2), all of them as one row where they are few,
    what lies in touching cells, the cells' size, the lower corner, and the coarsest level of cells."""

    places: DataFrame
    every: DataFrame | None = None
    around: DataFrame | None = None
    size: float = 1.0
    low: tuple[float, ...] = (0.0, 0.0, 0.0)
    top: int = 0

    def cells_of(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[F.floor((F.col(a) - F.lit(o)) / F.lit(self.size)).cast("long").alias(g) for a, o, g in zip(_PLACE, self.low, _CELL, strict=True)])


def placed(refs: DataFrame, largest: float | None = None, again: bool = True) -> Places:
    """References (rid, x, y, z) in order for one search, or for many (again).  Those of one place count once, with their smallest id.

    Cells are so small that they hold a few references; largest: their size at most.
    """
    write = keep if again else lambda df: df
    places = keep(refs.dropna(subset=_PLACE).groupBy(*_PLACE).agg(F.min("rid").alias("rid")))
    box = places.agg(F.count("*").alias("n"), *[f(a).alias(f"{n}{a}") for a in _PLACE for f, n in ((F.min, "l"), (F.max, "h"))]).first()
    if box["n"] <= FEW:
        return Places(places, every=write(places.agg(F.collect_list(F.struct("rid", *_PLACE)).alias("near"))))
    side, low = max(box[f"h{a}"] - box[f"l{a}"] for a in _PLACE), tuple(box[f"l{a}"] for a in _PLACE)
    size = _cell_size(places, box["n"], side, low)
    if largest is not None:
        size = min(size, max(float(largest), side / 2**24))
    index = Places(places, size=size, low=low)
    r = index.cells_of(places)
    levels = range(int(math.log2(side / size)) // BITS + 2)
    many = r.agg(*[F.approx_count_distinct(F.struct(*[F.shiftright(g, BITS * n) for g in _CELL])).alias(f"n{n}") for n in levels]).first()
    around = r
    for g in _CELL:
        around = around.withColumn(g, F.explode(F.array(*[F.col(g) + d for d in (-1, 0, 1)])))
    around = around.groupBy(*_CELL).agg(F.collect_list(F.struct("rid", *_PLACE)).alias("near"))
    return Places(r, None, write(around), size, low, next(n for n in levels if many[f"n{n}"] <= FEW or n == levels[-1]))


def nearest_within(queries: DataFrame, refs: DataFrame | Places, bound: float) -> DataFrame:
    """The nearest reference closer than the bound (smallest id on a tie): qid, rid, d2; null where there is none."""
    near = F.col("d2") < F.lit(bound * bound)
    found = _nearest(queries, refs if isinstance(refs, Places) else placed(refs, again=False), bound)
    return found.select("qid", F.when(near, F.col("rid")).alias("rid"), F.when(near, F.col("d2")).alias("d2"))


def nearest(queries: DataFrame, refs: DataFrame | Places, size: float | None = None) -> DataFrame:
    """The nearest reference of every query (smallest id on a tie): qid, rid, d2.

    size: the largest cell to look around in at first; the references' density may ask for a smaller one.
    """
    return _nearest(queries, refs if isinstance(refs, Places) else placed(refs, size, again=False))


def _nearest(queries: DataFrame, refs: Places, bound: float | None = None) -> DataFrame:
    """The nearest reference of every query, or of those that have one within the bound: qid, rid, d2; the others have what was met, or null.

    A match closer than a cell's side among the references of touching cells is final, as all nearer ones lie there.  The
    other queries go down from coarse cells to these, and leave out each cell that is farther than a reference met so far.
    """
    q = queries.select("qid", *_PLACE)
    if refs.every is not None:
        return q.crossJoin(F.broadcast(refs.every)).select("qid", _best("near").alias("b")).select("qid", "b.rid", "b.d2")
    met = keep(refs.cells_of(q).join(refs.around, _CELL, "left").select("qid", *_PLACE, _best("near").alias("b")).select("qid", *_PLACE, "b.rid", "b.d2"))
    if bound is not None and bound * (1 + SLACK) <= refs.size:
        return met.select("qid", "rid", "d2")
    final = F.coalesce(F.col("d2") <= F.lit(refs.size * refs.size * (1 - SLACK)), F.lit(False))
    found, left = met.filter(final).select("qid", "rid", "d2"), met.filter(~final)
    return found.unionByName(_descended(left, refs, bound)) if left.limit(1).count() else found


def _best(near: str) -> Column:
    """The nearest of an array of references (rid, x, y, z) as a struct d2, rid."""
    def one(r):
        d = sub(vec(*_PLACE), tuple(r[a] for a in _PLACE))
        return F.struct(dot(d, d).alias("d2"), r["rid"].alias("rid"))

    return F.array_min(F.transform(near, one))


def _cell_size(places: DataFrame, n: int, side: float, low: tuple[float, ...]) -> float:
    """The largest of a row of sizes at which a place shares its cell with FILL others at most, on average.

    It tells how long a search takes, never what it finds; of many places some tell it.
    """
    of = -(-n // TELLING)
    some = places if of == 1 else places.filter(F.pmod(F.xxhash64(*_PLACE), F.lit(of)) == 0)
    sizes = [side / 2 ** (k / 2) for k in range(2, 49)]
    each = some.select(*_PLACE, F.posexplode(F.array(*[F.lit(s) for s in sizes])).alias("k", "size"))
    cells = each.groupBy("k", *[F.floor((F.col(a) - F.lit(o)) / F.col("size")).alias(g) for a, o, g in zip(_PLACE, low, _CELL, strict=True)]).count()
    full = cells.groupBy("k").agg((F.sum(F.col("count") * (F.col("count") - 1)) / F.sum("count") * F.lit(of)).alias("others"))
    return sizes[full.filter(F.col("others") <= FILL).agg(F.coalesce(F.min("k"), F.lit(len(sizes) - 1))).first()[0]]


def _descended(left: DataFrame, index: Places, bound: float | None) -> DataFrame:
    """The nearest reference (within the bound) of queries (qid, x, y, z, and d2 of a reference met), from coarse cells down to those of the references: qid, rid, d2."""
    refs = index.places

    def cells(level: int) -> DataFrame:
        """Cells of a level: their bounds, and a reference in each."""
        keys = [F.shiftright(g, BITS * level).alias(g) for g in _CELL]
        ends = [f(a).alias(f"{n}{a}") for a in _PLACE for f, n in ((F.min, "l"), (F.max, "h"))]
        return refs.groupBy(*keys).agg(*ends, *[F.min_by(a, "rid").alias(f"p{a}") for a in _PLACE])

    def scored(c):
        gap = tuple(F.greatest(c[f"l{a}"] - F.col(a), F.col(a) - c[f"h{a}"], F.lit(0.0)) for a in _PLACE)
        d = sub(vec(*_PLACE), tuple(c[f"p{a}"] for a in _PLACE))
        return F.struct(dot(gap, gap).alias("least"), dot(d, d).alias("met"), *[c[g].alias(g) for g in _CELL])

    inside = F.struct(*_CELL, *[f"{n}{a}" for a in _PLACE for n in "lhp"])
    limit = F.lit(float("inf") if bound is None else bound * bound)
    q = left.select("qid", *_PLACE, F.least(F.coalesce("d2", limit), limit).alias("limit"))
    q = q.crossJoin(F.broadcast(cells(index.top).agg(F.collect_list(inside).alias("kids"))))  # FEW cells at most, or so
    for level in range(index.top, -1, -1):
        q = q.select("qid", *_PLACE, "limit", F.transform("kids", scored).alias("kids"))
        q = q.withColumn("limit", F.least("limit", F.min(F.array_min(F.transform("kids", lambda c: c["met"]))).over(Window.partitionBy("qid"))))
        q = q.select("qid", *_PLACE, "limit", F.explode(F.filter("kids", lambda c: c["least"] <= F.col("limit"))).alias("c")).select("qid", *_PLACE, "limit", *[f"c.{g}" for g in _CELL])
        if level:
            below = cells(level - 1).groupBy(*[F.shiftright(g, BITS).alias(f"up_{g}") for g in _CELL]).agg(F.collect_list(inside).alias("kids"))
            q = q.join(below, [q[g] == below[f"up_{g}"] for g in _CELL]).select("qid", *_PLACE, "limit", "kids")
    own = refs.groupBy(*_CELL).agg(F.collect_list(F.struct("rid", *_PLACE)).alias("near"))
    got = q.join(own, _CELL).select("qid", _best("near").alias("b"))
    none = left.select("qid", F.lit(None).cast(got.schema["b"].dataType).alias("b"))  # a query without one keeps its row
    return got.unionByName(none).groupBy("qid").agg(F.min("b").alias("b")).select("qid", "b.rid", "b.d2")


def heights_on_plane(points: DataFrame, triangles: DataFrame, size: float, depth: float, epsilon: float = 1e-6, on: tuple[str, ...] = ()) -> DataFrame:
    """For points (pid, x, y) the height of the triangle (fid, ax .. cz) over them that lies closest to the plane; of equal ones the smallest fid.

    Triangles go into all cells that their boxes overlap.  on: columns that points and triangles must share, such as their mesh.
    """
    low = {a: F.floor((F.least(*[F.col(f"{n}{a}") for n in "abc"]) - epsilon) / size).cast("long") for a in "xy"}
    high = {a: F.floor((F.greatest(*[F.col(f"{n}{a}") for n in "abc"]) + epsilon) / size).cast("long") for a in "xy"}
    t = triangles.select("*", F.explode(F.sequence(low["x"], high["x"])).alias("g0")).select("*", F.explode(F.sequence(low["y"], high["y"])).alias("g1"))
    p = points.select(*on, "pid", "x", "y", *[c.alias(f"g{i}") for i, c in enumerate(_cell(size, "x", "y"))])
    j = p.join(t, [*on, "g0", "g1"])
    bx, by, cx, cy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    j = j.withColumn("det", bx * cy - by * cx).filter("det <> 0")
    j = j.withColumn("u", (dx * cy - dy * cx) / F.col("det")).withColumn("v", (bx * dy - by * dx) / F.col("det"))
    j = j.withColumn("z", F.col("az") + F.col("u") * (F.col("bz") - F.col("az")) + F.col("v") * (F.col("cz") - F.col("az")))
    hit = j.filter((F.col("u") >= -epsilon) & (F.col("v") >= -epsilon) & (F.col("u") + F.col("v") <= 1 + epsilon) & (F.abs("z") <= depth))
    best = hit.groupBy(*on, "pid").agg(F.min(F.struct(F.abs("z").alias("far"), "fid", "z")).alias("b"))
    return points.select(*on, "pid").join(best, [*on, "pid"], "left").select(*on, "pid", F.col("b.z").alias("z"), F.col("b.fid").alias("fid"))


def crossed_cells(rays: DataFrame, size: float) -> DataFrame:
    """Rays (rid, o*, d*, far) in the cells their segment crosses: the cells of its box, each tested by slabs."""
    out = rays
    for i, a in enumerate("xyz"):
        end = F.col(f"o{a}") + F.col(f"d{a}") * F.col("far")
        lo, hi = F.least(F.col(f"o{a}"), end), F.greatest(F.col(f"o{a}"), end)
        out = out.withColumn(f"g{i}", F.explode(F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))))
    enter, leave = [], []
    for i, a in enumerate("xyz"):
        d, o = F.col(f"d{a}"), F.col(f"o{a}")
        low, high = F.col(f"g{i}") * F.lit(size) - 1e-9, (F.col(f"g{i}") + 1) * F.lit(size) + 1e-9
        flat = F.abs(d) < 1e-12
        t0, t1 = (low - o) / d, (high - o) / d
        enter.append(F.when(flat, F.lit(0.0)).otherwise(F.least(t0, t1)))
        leave.append(F.when(flat, F.col("far")).otherwise(F.greatest(t0, t1)))
    ends = [(F.col(f"o{a}") + F.col(f"d{a}") * F.col("far")).alias(f"e{a}__") for a in "xyz"]
    crossed = out.filter(F.greatest(*enter, F.lit(0.0)) <= F.least(*leave, F.col("far"))).select("*", *ends)
    return crossed.select("*", *[f(f"o{a}", f"e{a}__").alias(f"{n}{a}__") for a in "xyz" for f, n in ((F.least, "rl"), (F.greatest, "rh"))]).drop(*[f"e{a}__" for a in "xyz"])


#: By what share of a cell a triangle's box is wider than it, for a test of boxes that rounding does not sway.
WIDER = 1e-3


def faces_in_cells(triangles: DataFrame, size: float) -> DataFrame:
    """Triangles (ax .. cz) in all cells that their boxes overlap: g0, g1, g2."""
    ends = [(f(*[F.col(f"{c}{a}") for c in "abc"]) + F.lit(sign * WIDER * size)).alias(f"{n}{a}__") for a in "xyz" for f, n, sign in ((F.least, "tl", -1), (F.greatest, "th", 1))]
    t = triangles.select("*", *ends)
    for i, a in enumerate("xyz"):
        corner = [F.col(f"{n}{a}") for n in "abc"]
        t = t.withColumn(f"g{i}", F.explode(F.sequence(F.floor((F.least(*corner) - 1e-9) / size).cast("long"), F.floor((F.greatest(*corner) + 1e-9) / size).cast("long"))))
    return t


def boxes_meet(pairs: DataFrame) -> DataFrame:
    """Of rays of crossed_cells beside triangles of faces_in_cells those whose boxes meet: a few comparisons, before the whole test."""
    for a in "xyz":
        pairs = pairs.filter((F.col(f"rl{a}__") <= F.col(f"th{a}__")) & (F.col(f"rh{a}__") >= F.col(f"tl{a}__")))
    return pairs


def struck(pairs: DataFrame, epsilon, *keep: str) -> DataFrame:
    """Of segments (o*, d*, far) beside triangles (ax .. cz) those that meet farther than epsilon from both ends: the columns to keep."""
    a = vec("ax", "ay", "az")
    e1, e2, d = sub(vec("bx", "by", "bz"), a), sub(vec("cx", "cy", "cz"), a), vec("dx", "dy", "dz")
    p = cross(d, e2)
    det = dot(e1, p)
    s = sub(vec("ox", "oy", "oz"), a)
    q = cross(s, e1)
    eps = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))
    j = pairs.select(*keep, F.col("far").alias("far__"), eps.alias("eps__"), det.alias("det"), dot(s, p).alias("un"), dot(d, q).alias("vn"), dot(e2, q).alias("tn")).filter(F.abs("det") > 1e-12)
    u, v, far = F.col("un") / F.col("det"), F.col("vn") / F.col("det"), F.col("tn") / F.col("det")
    return j.filter((u >= 0) & (v >= 0) & (u + v <= 1) & (far > F.col("eps__")) & (far < F.col("far__") - F.col("eps__"))).select(*keep)


def hits(rays: DataFrame, triangles: DataFrame, size: float, epsilon: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (rid, fid) of segments and triangles that meet farther than epsilon from both ends; on: columns that both must share."""
    j = boxes_meet(crossed_cells(rays, size).join(faces_in_cells(triangles, size), [*on, "g0", "g1", "g2"]))
    return struck(j, epsilon, *on, "rid", "fid").distinct()


def clear_rays(rays: DataFrame, triangles: DataFrame, size: float, epsilon: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Rays that meet no triangle: an anti-join.  Endless rays are to be cut first (occlusion.until_out)."""
    return rays.join(hits(rays, triangles, size, epsilon, on).select(*on, "rid"), [*on, "rid"], "left_anti")
