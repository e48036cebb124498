"""Maplets: local height fields as sample tables (k, r, c, h, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.running import in_ranges, with_previous, with_sums
from regolith.functions.vec import add, apply, mat, named, transposed, vec

STEEP_EPSILON = 1e-6


def body_points(samples: DataFrame, maplets: DataFrame) -> DataFrame:
    """Samples (k, r, c, h, valid) with their points in the body frame; those of invalid samples are null.

    maplets: k, ny, nx, ox, oy, oz, b00 .. b22 (columns e_u, e_v, n), spacing.
    """
    m = F.broadcast(maplets)
    u = (F.col("c") - (F.col("nx") - 1) / F.lit(2.0)) * F.col("spacing")
    v = (F.col("r") - (F.col("ny") - 1) / F.lit(2.0)) * F.col("spacing")
    p = add(vec("ox", "oy", "oz"), apply(mat("b"), (u, v, F.col("h"))))
    return samples.join(m, "k").select(*[samples[c] for c in samples.columns], *[F.when(F.col("valid"), x).alias(f"p{a}") for x, a in zip(p, "xyz", strict=True)])


def extents(maplets: DataFrame) -> DataFrame:
    return maplets.withColumn("extent_u", (F.col("nx") - 1) * F.col("spacing")).withColumn("extent_v", (F.col("ny") - 1) * F.col("spacing"))


def complete_grid(samples: DataFrame, maplets: DataFrame) -> DataFrame:
    """Every cell of every maplet: k, r, c, h (0 where invalid), valid."""
    cells = maplets.select("k", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("r"), F.col("nx")).select("k", "r", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("c"))
    cells = cells.select(*[F.col(x).cast("long").alias(x) for x in ("k", "r", "c")])
    return cells.join(samples.select("k", "r", "c", "h"), ["k", "r", "c"], "left").select("k", "r", "c", F.coalesce("h", F.lit(0.0)).alias("h"), F.col("h").isNotNull().alias("valid"))


def gradient(grid: DataFrame, spacing: float) -> DataFrame:
    """Adds slopes p (along columns) and q (along rows) by central differences, one-sided at borders, and whether the stencil is valid."""
    across, down = Window.partitionBy("k", "r").orderBy("c"), Window.partitionBy("k", "c").orderBy("r")

    def slope(w) -> Column:
        back, ahead = F.lag("h").over(w), F.lead("h").over(w)
        return F.when(back.isNull(), (ahead - F.col("h")) / spacing).when(ahead.isNull(), (F.col("h") - back) / spacing).otherwise((ahead - back) / F.lit(2.0 * spacing))

    near = [F.coalesce(f("valid").over(w), F.col("valid")) for w in (across, down) for f in (F.lag, F.lead)]
    return grid.select("*", slope(across).alias("p"), slope(down).alias("q"), (F.col("valid") & near[0] & near[1] & near[2] & near[3]).alias("usable"))


def normals(slopes: DataFrame) -> DataFrame:
    n = F.sqrt(F.lit(1.0) + F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    return slopes.select("*", (-F.col("p") / n).alias("nx"), (-F.col("q") / n).alias("ny"), (F.lit(1.0) / n).alias("nz"))


def triangles(samples: DataFrame, side: int) -> DataFrame:
    """Faces (mesh, fid, v0, v1, v2) of the lattice cells whose corners are valid samples.

    A cell is cut along its first diagonal if both its ends are valid, else along the other; only triangles of valid
    corners are emitted.  Each sample goes to its four cells, so one shuffle brings the corners together.
    """
    to = F.explode(F.array(*[F.struct((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(2 * dr + dc).alias("corner")) for dr in (0, 1) for dc in (0, 1)]))
    cell = samples.select("k", to.alias("s")).select("k", "s.r", "s.c", "s.corner").filter((F.col("r").between(0, side - 2)) & F.col("c").between(0, side - 2))
    has = [F.max((F.col("corner") == i).cast("int")).alias(n) for i, n in enumerate(("a", "b", "d", "e"))]  # a b / d e
    g = cell.groupBy("k", "r", "c").agg(*has)
    va = F.col("r") * side + F.col("c")
    first_cut = (F.col("a") + F.col("e")) == 2
    one = F.struct(F.lit(0).alias("half"), va.alias("v0"), (va + 1).alias("v1"), F.when(first_cut, va + side + 1).otherwise(va + side).alias("v2"), ((F.col("a") + F.col("b")) == 2).alias("two"), F.when(first_cut, F.col("e")).otherwise(F.col("d")).alias("third"))
    other = F.struct(F.lit(1).alias("half"), F.when(first_cut, va).otherwise(va + 1).alias("v0"), (va + side + 1).alias("v1"), (va + side).alias("v2"), ((F.col("d") + F.col("e")) == 2).alias("two"), F.when(first_cut, F.col("a")).otherwise(F.col("b")).alias("third"))
    faces = g.select(F.col("k").alias("mesh"), "r", "c", F.explode(F.array(one, other)).alias("t")).filter("t.two and t.third = 1")
    return faces.select("mesh", ((F.col("r") * (side - 1) + F.col("c")) * 2 + F.col("t.half")).alias("fid"), "t.v0", "t.v1", "t.v2")


def vertices(samples: DataFrame, side: int) -> DataFrame:
    return samples.select(F.col("k").alias("mesh"), (F.col("r") * side + F.col("c")).alias("vid"), "x", "y", "z")


def camera_centers(cameras: DataFrame) -> DataFrame:
    """Adds the centre -R^T t."""
    c = apply(transposed(mat("r")), vec("t0", "t1", "t2"))
    return cameras.select("*", *[(-x).alias(f"e{i}") for i, x in enumerate(c)])


def project(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Points (x, y, z) in each camera: cx, cy, depth, and pixel u, v where the depth is positive."""
    p = points.crossJoin(F.broadcast(cameras))
    cam = add(apply(mat("r"), vec("x", "y", "z")), vec("t0", "t1", "t2"))
    p = p.select("*", *named(cam, "cx", "cy", "depth"))
    front = F.col("depth") > STEEP_EPSILON
    return p.select("*", *[F.when(front, F.col("f") * F.col(a) / F.col("depth") + F.col("pp")).alias(n) for a, n in (("cx", "u"), ("cy", "v"))])


def bilinear(queries: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Queries (qid, image_id, u, v) with the interpolated value and whether it is usable.

    A query unfolds to its corners of non-zero weight, which meet the pixels by an equi-join and are folded back.
    """
    inside = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") <= width - 1) & (F.col("v") <= height - 1)
    q = queries.select("qid", "image_id", "u", "v", F.floor("u").alias("x0"), F.floor("v").alias("y0")).withColumn("dx", F.col("u") - F.col("x0")).withColumn("dy", F.col("v") - F.col("y0"))
    one = F.lit(1.0)
    corner = F.array(*[F.struct((F.col("y0") + j).alias("row"), (F.col("x0") + i).alias("col"), ((F.col("dx") if i else one - F.col("dx")) * (F.col("dy") if j else one - F.col("dy"))).alias("w")) for j in (0, 1) for i in (0, 1)])
    near = q.filter(inside).select("qid", "image_id", F.explode(corner).alias("s")).select("qid", "image_id", "s.row", "s.col", "s.w").filter("w <> 0")
    read = near.join(pixels.select("image_id", "row", "col", "value", "valid"), ["image_id", "row", "col"], "left")
    folded = read.groupBy("qid").agg(F.sum(F.coalesce("value", F.lit(0.0)) * F.col("w")).alias("value"), F.bool_and(F.coalesce("valid", F.lit(False))).alias("usable"))
    return queries.join(folded, "qid", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


def ground_sample_distance(centers: DataFrame, cameras: DataFrame) -> DataFrame:
    """Of each maplet centre (k, x, y, z, basis e_u and e_v) in each camera the length of a pixel in the worse direction.

    The smaller singular value of the 2 x 2 projection Jacobian J follows from the trace and determinant of J^T J.
    """
    p = project(centers, cameras)
    axes = []
    for n in ("u", "v"):
        along = apply(mat("r"), vec(f"{n}x", f"{n}y", f"{n}z"))
        axes.append([F.col("f") * (along[i] * F.col("depth") - F.col(c) * along[2]) / (F.col("depth") * F.col("depth")) for i, c in enumerate(("cx", "cy"))])
    (a, c), (b, d) = axes
    p = p.select("k", "cam", "depth", (a * a + b * b + c * c + d * d).alias("tr"), (a * d - b * c).alias("det"))
    root = F.sqrt(F.greatest(F.col("tr") * F.col("tr") - F.lit(4.0) * F.col("det") * F.col("det"), F.lit(0.0)))
    least = F.sqrt(F.greatest((F.col("tr") - root) / F.lit(2.0), F.lit(0.0)))
    return p.filter(F.col("depth") > STEEP_EPSILON).select("k", "cam", (F.lit(1.0) / F.greatest(least, F.lit(1e-6))).alias("gsd"))


def plane_fit(samples: DataFrame) -> DataFrame:
    """Least-squares plane h = a x + b y + d of each maplet by its normal equations; null where they are singular."""
    s = samples.groupBy("k").agg(*[F.sum(e).alias(n) for n, e in {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "sh": F.col("h"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y"), "syy": F.col("y") * F.col("y"), "sxh": F.col("x") * F.col("h"), "syh": F.col("y") * F.col("h")}.items()])
    c = {k: F.col(k) for k in s.columns}
    xx, xy, yy = c["sxx"] - c["sx"] * c["sx"] / c["n"], c["sxy"] - c["sx"] * c["sy"] / c["n"], c["syy"] - c["sy"] * c["sy"] / c["n"]
    xh, yh = c["sxh"] - c["sx"] * c["sh"] / c["n"], c["syh"] - c["sy"] * c["sh"] / c["n"]
    det = xx * yy - xy * xy
    fit = s.select("k", "n", "sx", "sy", "sh", xx.alias("xx"), xy.alias("xy"), yy.alias("yy"), xh.alias("xh"), yh.alias("yh"), det.alias("det"))
    a, b = F.when(F.col("det") > 1e-12, (F.col("xh") * F.col("yy") - F.col("yh") * F.col("xy")) / F.col("det")), F.when(F.col("det") > 1e-12, (F.col("yh") * F.col("xx") - F.col("xh") * F.col("xy")) / F.col("det"))
    return fit.select("k", "n", "sx", "sy", "sh", a.alias("a"), b.alias("b")).select("k", "a", "b", ((F.col("sh") - F.col("a") * F.col("sx") - F.col("b") * F.col("sy")) / F.col("n")).alias("d"))


def packed_offsets(maplets: DataFrame) -> DataFrame:
    """Start of each maplet's samples in the packed order of ids, and runs of consecutive ids of equal shape."""
    m = in_ranges(maplets.select("k", "ny", "nx"), "k")
    shape = F.struct("ny", "nx")
    m = with_previous(m, shape, "former", "k")
    turn = F.coalesce((F.col("former") != shape).cast("long"), F.lit(0))
    m = with_sums(m, {"upto": (F.col("ny") * F.col("nx")).cast("long"), "run": turn}, "k")
    return m.select("k", "ny", "nx", (F.col("upto") - F.col("ny") * F.col("nx")).alias("start"), "run")


def nearest_to_center(samples: DataFrame, middle_r: float, middle_c: float) -> DataFrame:
    """The valid sample of each maplet that lies nearest to the centre; row-major on ties."""
    d = (F.col("r") - middle_r) * (F.col("r") - middle_r) + (F.col("c") - middle_c) * (F.col("c") - middle_c)
    return samples.groupBy("k").agg(F.min(F.struct(d.alias("d"), "r", "c")).alias("m")).select("k", F.col("m.r").alias("r"), F.col("m.c").alias("c"), F.col("m.d").alias("d"))


def active_samples(samples: DataFrame, maplets: DataFrame) -> DataFrame:
    """Valid samples of maplets that are active (k, active)."""
    return samples.filter("valid").join(maplets.filter("active").select("k"), "k", "left_semi")
