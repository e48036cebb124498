"""Rendering of meshes by relational rasterisation.

Faces are culled and projected, unfolded to the pixels of their boxes, tested,
and the nearest face of a pixel wins a grouped minimum.  Pixel centres lie at
px + 0.5.  Light is given by the direction it travels in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.vec import add, apply, clamp, cross, dot, mat, named, transposed, vec

AREA_EPSILON = 1e-12
DEPTH_LEVELS = 16777215.0
SPAN_LEAST = 1e-9


def with_cameras(geometry: DataFrame, cameras: DataFrame) -> DataFrame:
    """Faces in each camera, with its centre e0, e1, e2."""
    center = apply(transposed(mat("r")), vec("t0", "t1", "t2"))
    return geometry.crossJoin(F.broadcast(cameras)).select("*", *[(-x).alias(f"e{i}") for i, x in enumerate(center)])


def cull_backfaces(faces: DataFrame) -> DataFrame:
    """Faces whose normal looks at the camera: n . eye > n . centroid."""
    n = vec("nx", "ny", "nz")
    return faces.filter(dot(n, vec("e0", "e1", "e2")) > dot(n, vec("mx", "my", "mz")))


def frustum_blocks(blocks: DataFrame, cameras: DataFrame, tolerance: float = 16 * 2.0**-23) -> DataFrame:
    """Blocks (bounds lo_x .. hi_z) with whether a camera may see them: no side plane of its frustum, nor the camera plane, has the box outside."""
    b = blocks.crossJoin(F.broadcast(cameras))
    c = [(F.col(f"lo_{a}") + F.col(f"hi_{a}")) / F.lit(2.0) for a in "xyz"]
    e = [(F.col(f"hi_{a}") - F.col(f"lo_{a}")) / F.lit(2.0) for a in "xyz"]
    f, pp, side, zero, one = F.col("f"), F.col("pp"), F.col("side").cast("double"), F.lit(0.0), F.lit(1.0)
    planes = [(f, zero, pp), (-f, zero, side - pp), (zero, f, pp), (zero, -f, side - pp), (zero, zero, one)]
    r = mat("r")
    seen = F.lit(True)
    for p in planes:
        world = apply(transposed(r), p)
        offset = dot(p, vec("t0", "t1", "t2"))
        radius = dot(tuple(e), tuple(F.abs(x) for x in world))
        slack = F.lit(tolerance) * (dot(tuple(F.abs(x) for x in c), tuple(F.abs(x) for x in world)) + F.abs(offset) + radius + 1.0)
        seen = seen & (dot(tuple(c), world) + offset + radius >= -slack)
    return b.select(*blocks.columns, "cam", seen.alias("visible"))


def project_faces(faces: DataFrame, near: float, width: int, height: int) -> DataFrame:
    """Faces in front of the near plane with their corners' pixels, boxes of pixels, and signed area; off-screen and empty ones are dropped."""
    out = faces
    for n in "abc":
        p = add(apply(mat("r"), vec(f"{n}x", f"{n}y", f"{n}z")), vec("t0", "t1", "t2"))
        out = out.select("*", *named(p, f"{n}0", f"{n}1", f"{n}2"))
    out = out.filter((F.col("a2") > near) & (F.col("b2") > near) & (F.col("c2") > near))
    pix = [(F.col("f") * F.col(f"{n}{i}") / F.col(f"{n}2") + F.col("pp")).alias(f"p{'uv'[i]}{k}") for k, n in enumerate("abc") for i in (0, 1)]
    out = out.select("*", *pix)
    low = {a: F.least(*[F.col(f"p{a}{k}") for k in range(3)]) for a in "uv"}
    high = {a: F.greatest(*[F.col(f"p{a}{k}") for k in range(3)]) for a in "uv"}
    size = {"u": width, "v": height}
    box = []
    for a, n in (("u", "x"), ("v", "y")):
        box.append(F.least(F.greatest(F.ceil(low[a] - F.lit(0.5)), F.lit(0)), F.lit(size[a] - 1)).cast("int").alias(f"{n}0"))
        box.append(F.least(F.greatest(F.floor(high[a] - F.lit(0.5)), F.lit(0)), F.lit(size[a] - 1)).cast("int").alias(f"{n}1"))
    area = (F.col("pu1") - F.col("pu0")) * (F.col("pv2") - F.col("pv0")) - (F.col("pu2") - F.col("pu0")) * (F.col("pv1") - F.col("pv0"))
    on = (high["u"] >= 0) & (low["u"] < width) & (high["v"] >= 0) & (low["v"] < height)
    return out.select("*", *box, area.alias("twice")).filter((F.abs("twice") > AREA_EPSILON) & on & (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0")))


def rasterize(projected: DataFrame, keys: tuple[str, ...] = ("mesh", "cam")) -> DataFrame:
    """Pixels that lie inside faces (edges included): keys, fid, px, py, depth; perspective-correct."""
    p = projected.select(*keys, "fid", *[f"p{a}{k}" for a in "uv" for k in range(3)], "a2", "b2", "c2", "twice", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("py"))
    p = p.select("*", F.explode(F.sequence("x0", "x1")).alias("px")).withColumn("fx", F.col("px") + F.lit(0.5)).withColumn("fy", F.col("py") + F.lit(0.5))
    w = [(F.col(f"pu{i}") - F.col("fx")) * (F.col(f"pv{j}") - F.col("fy")) - (F.col(f"pu{j}") - F.col("fx")) * (F.col(f"pv{i}") - F.col("fy")) for i, j in ((1, 2), (2, 0), (0, 1))]
    p = p.select("*", *[x.alias(f"w{i}") for i, x in enumerate(w)])
    s = F.signum("twice")
    p = p.filter((F.col("w0") * s >= 0) & (F.col("w1") * s >= 0) & (F.col("w2") * s >= 0))
    iz = F.col("w0") / F.col("twice") * (F.lit(1.0) / F.col("a2")) + F.col("w1") / F.col("twice") * (F.lit(1.0) / F.col("b2")) + F.col("w2") / F.col("twice") * (F.lit(1.0) / F.col("c2"))
    return p.withColumn("iz", iz).filter("iz > 0").select(*keys, "fid", "px", "py", (F.lit(1.0) / F.col("iz")).alias("depth"))


def z_buffer(projected: DataFrame, keys: tuple[str, ...] = ("mesh", "cam")) -> DataFrame:
    """Per pixel the nearest face: keys, px, py, zq (24-bit depth within the frame's range), fid (the smallest of equal depths)."""
    z = F.array("a2", "b2", "c2")
    span = projected.groupBy(*keys).agg(F.min(F.array_min(z)).alias("zmin"), F.max(F.array_max(z)).alias("zmax"))
    hit = rasterize(projected, keys).join(span, list(keys))
    depth = clamp((F.col("depth") - F.col("zmin")) / F.greatest(F.col("zmax") - F.col("zmin"), F.lit(SPAN_LEAST)), 0.0, 1.0)
    zq = F.floor(depth * F.lit(DEPTH_LEVELS)).cast("long")
    best = hit.groupBy(*keys, "px", "py").agg(F.min(F.struct(zq.alias("zq"), "fid")).alias("b"))
    return best.select(*keys, "px", "py", F.col("b.zq").alias("zq"), F.col("b.fid").alias("fid"))


def shade(buffer: DataFrame, geometry: DataFrame, light: tuple[float, float, float], ambient: float = 0.15) -> DataFrame:
    """Adds the gray value of each pixel: ambient and Lambert light, times 255, cut to an integer.  light travels along the given direction."""
    n = geometry.select("mesh", "fid", "nx", "ny", "nz")
    size = sum(x * x for x in light) ** 0.5
    to = tuple(F.lit(-x / size) for x in light)
    lambert = clamp(dot(vec("nx", "ny", "nz"), to), 0.0, 1.0)
    gray = F.floor((F.lit(ambient) + F.lit(1 - ambient) * lambert) * F.lit(255.0)).cast("int")
    return buffer.join(n, ["mesh", "fid"]).select(*buffer.columns, gray.alias("gray"))


def frame(shaded: DataFrame, frames: DataFrame, width: int, height: int, background: int = 0) -> DataFrame:
    """Every pixel of every frame (its key columns), the background where no face is."""
    keys = frames.columns
    cells = frames.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("py")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("px"))
    return cells.join(shaded, [*keys, "py", "px"], "left").select(*keys, "py", "px", F.coalesce("gray", F.lit(background)).alias("gray"))


def render(geometry: DataFrame, cameras: DataFrame, light: tuple[float, float, float], near: float = 1e-6, width: int = 64, height: int = 64, ambient: float = 0.15, cull: bool = True) -> DataFrame:
    """Shaded visible pixels of every mesh in every camera: mesh, cam, px, py, zq, fid, gray."""
    seen = with_cameras(geometry, cameras)
    seen = cull_backfaces(seen) if cull else seen
    return shade(z_buffer(project_faces(seen, near, width, height)), geometry, light, ambient)


def filling_distance(points: DataFrame, key: str, degrees: float, fill: float = 0.85, least: float = 1.0) -> DataFrame:
    """How far from the origin a camera with this field of view must stand for each body's points (x, y, z) to fill a share of it: key, distance."""
    r = F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    return points.groupBy(key).agg(F.greatest(r / F.sin(F.radians(F.lit(degrees / 2))) / F.lit(fill), F.lit(float(least))).alias("distance"))


def orbits(bodies: DataFrame, views: int, light_degrees: float, axis=(0.0, 0.0, 1.0), e1=(1.0, 0.0, 0.0), e2=(0.0, 1.0, 0.0)) -> DataFrame:
    """Requests of cameras on a circle about each body (with its distance) that look at the origin: adds request, eye, R, t, and the light's direction."""
    import math

    from regolith.functions.vec import unit

    d = bodies.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(views - 1).cast("long"))).alias("request"))
    angle = F.radians(F.col("request") * F.lit(360.0 / views))
    c, s = F.cos(angle), F.sin(angle)
    d = d.select("*", *named(tuple(F.col("distance") * (c * F.lit(a) + s * F.lit(b)) for a, b in zip(e1, e2, strict=True)), "ex", "ey", "ez"))
    e = vec("ex", "ey", "ez")
    forward = unit(tuple(-x for x in e), 1e-12)
    right = unit(cross(forward, tuple(F.lit(a) for a in axis)), 1e-12)
    rows = [right, cross(forward, right), forward]
    d = d.select("*", *[x.alias(f"r{i}{j}") for i, row in enumerate(rows) for j, x in enumerate(row)])
    t = apply(mat("r"), e)
    ca, sa = math.cos(math.radians(light_degrees)), math.sin(math.radians(light_degrees))
    light = [F.lit(ca) * F.col(f"r2{j}") + F.lit(sa) * F.col(f"r0{j}") for j in range(3)]
    return d.select("*", *[(-x).alias(f"t{i}") for i, x in enumerate(t)], *[x.alias(f"l{i}") for i, x in enumerate(light)])


def orbit(distance: float, views: int, light_degrees: float, axis=(0.0, 0.0, 1.0), e1=(1.0, 0.0, 0.0), e2=(0.0, 1.0, 0.0), spark=None) -> DataFrame:
    """The requests of one orbit."""
    return orbits(spark.range(1).select(F.lit(float(distance)).alias("distance")), views, light_degrees, axis, e1, e2).drop("distance")


def camera_faults(cameras: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Why a camera cannot be rendered, else null: cam, error."""
    rows = [vec(f"r{i}0", f"r{i}1", f"r{i}2") for i in range(3)]
    off = [F.abs(dot(rows[i], rows[j]) - F.lit(1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)]
    skew = F.greatest(*off)
    error = F.when(F.col("f").isNull() | F.isnan("f") | (F.col("f") <= 0), "the focal length is not positive")
    error = error.when(F.col("side").isNull() | (F.col("side") <= 0) | (F.col("side").cast("long") * F.col("side").cast("long") >= 2**31), "the frame has no usable size")
    error = error.when(skew.isNull() | F.isnan(skew) | (skew > tolerance), "the rotation is not orthonormal").when(dot(cross(rows[0], rows[1]), rows[2]) <= 0, "the rotation mirrors")
    return cameras.select("cam", error.alias("error"))
