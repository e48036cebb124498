"""Triangle meshes as tables: vertices (mesh, vid, x, y, z) and faces (mesh, fid, v0, v1, v2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.vec import cross, named, norm, sub, unit, vec
from regolith.operators.graph import components


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the points of their corners: ax .. cz.

    One shuffle: the corners of a face are unfolded, meet the vertices, and are folded back by face.
    """
    v = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"v{i}").alias("vid")) for i in range(3)]))
    unfolded = faces.select("mesh", "fid", "v0", "v1", "v2", v.alias("v")).select("mesh", "fid", "v0", "v1", "v2", "v.at", "v.vid")
    points = unfolded.join(vertices.select("mesh", "vid", "x", "y", "z"), ["mesh", "vid"])
    folded = [F.max(F.when(F.col("at") == i, F.col(axis))).alias(f"{name}{axis}") for i, name in enumerate("abc") for axis in "xyz"]
    return points.groupBy("mesh", "fid").agg(*[F.first(c).alias(c) for c in ("v0", "v1", "v2")], *folded)


def face_geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Adds centroid (mx, my, mz), unit normal (0 for a degenerate face) and area."""
    t = corners(vertices, faces)
    a, b, c = (vec(f"{n}x", f"{n}y", f"{n}z") for n in "abc")
    g = cross(sub(b, a), sub(c, a))
    t = t.select("*", *named(g, "gx", "gy", "gz")).withColumn("two", norm(vec("gx", "gy", "gz")))
    third = F.lit(3.0)
    middle = [(a[i] / third + b[i] / third + c[i] / third).alias(f"m{axis}") for i, axis in enumerate("xyz")]
    # Where the product of two tiny edges vanishes, edges are scaled by their largest component first.
    e, d = sub(b, a), sub(c, a)
    most = F.greatest(*[F.abs(x) for x in (*e, *d)])
    small = (F.col("two") < 1e-100) & (most > 0)
    up = lambda v: tuple(x / F.when(most > 0, most) for x in v)
    t = t.select("*", *[F.when(small, x).alias(f"u{axis}") for x, axis in zip(unit(cross(up(e), up(d)), 1e-30), "xyz", strict=True)])
    normal = [F.coalesce(F.col(f"u{axis}"), F.when(F.col("two") > 0, F.col(f"g{axis}") / F.col("two")).otherwise(0.0)).alias(f"n{axis}") for axis in "xyz"]
    return t.select("mesh", "fid", "v0", "v1", "v2", *[f"{n}{x}" for n in "abc" for x in "xyz"], *middle, *normal, (F.col("two") * F.lit(0.5)).alias("area"))


def proper_faces(geometry: DataFrame) -> DataFrame:
    """Faces with a finite area above zero."""
    return geometry.filter((F.col("area") > 0) & ~F.isnan("area") & (F.col("area") < float("inf")))


def usable_faces(geometry: DataFrame) -> DataFrame:
    """The proper faces; an error names the meshes that have none left."""
    proper = proper_faces(geometry)
    empty = geometry.select("mesh").distinct().join(proper.select("mesh").distinct(), "mesh", "left_anti").limit(5).collect()
    if empty:
        raise ValueError(f"no face with an area is left in {', '.join(str(r['mesh']) for r in empty)}")
    return proper


def violations(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Per mesh: non-finite vertices, faces with an index that no vertex has, faces with a repeated corner."""
    finite = ~(F.isnan("x") | F.isnan("y") | F.isnan("z")) & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & (F.abs("z") < float("inf"))
    bad = vertices.groupBy("mesh").agg(F.count_if(~F.coalesce(finite, F.lit(False))).alias("bad_vertices"))
    used = faces.select("mesh", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    lost = used.join(vertices, ["mesh", "vid"], "left_anti").groupBy("mesh").agg(F.count_distinct("fid").alias("lost_faces"))
    twice = faces.filter("v0 = v1 or v1 = v2 or v0 = v2").groupBy("mesh").agg(F.count("*").alias("twice_faces"))
    return bad.join(lost, "mesh", "left").join(twice, "mesh", "left").fillna(0, ["lost_faces", "twice_faces"])


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges of each mesh: lo, hi, n (faces), turn (sum of the directions; 0 if wound consistently)."""
    pair = lambda i, j: F.struct(F.col(f"v{i}").alias("p"), F.col(f"v{j}").alias("q"))
    e = faces.select("mesh", F.explode(F.array(pair(0, 1), pair(1, 2), pair(2, 0))).alias("e")).select("mesh", "e.p", "e.q")
    return e.groupBy("mesh", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("p") < F.col("q"), 1).otherwise(-1)).alias("turn"))


def edge_topology(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Per mesh: boundary, non-manifold and inconsistently wound edges, unreferenced vertices, repeated faces."""
    by_edge = edges(faces).groupBy("mesh").agg(F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") > 2).alias("nonmanifold"), F.count_if(F.col("turn") != 0).alias("unbalanced"), F.count("*").alias("n_edges"))
    used = faces.select("mesh", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    loose = vertices.join(used, ["mesh", "vid"], "left_anti").groupBy("mesh").agg(F.count("*").alias("unreferenced"))
    sorted_ = faces.select("mesh", F.sort_array(F.array("v0", "v1", "v2")).alias("v"))
    again = sorted_.groupBy("mesh", "v").count().groupBy("mesh").agg(F.sum(F.col("count") - 1).alias("repeated"))
    return by_edge.join(loose, "mesh", "left").join(again, "mesh", "left").fillna(0, ["unreferenced", "repeated"])


def vertex_fans(faces: DataFrame) -> DataFrame:
    """Per vertex the number of fans of faces around it; more than one makes the vertex non-manifold.

    A fan is a component of the corners at a vertex, two corners being linked when their faces share an edge there.
    """
    at = F.explode(F.array(*[F.struct(F.col(f"v{i}").alias("vid"), F.array(F.col(f"v{(i + 1) % 3}"), F.col(f"v{(i + 2) % 3}")).alias("others")) for i in range(3)]))
    corner = faces.select("mesh", "fid", at.alias("s")).select("mesh", "fid", "s.vid", F.explode("s.others").alias("other"))
    number = F.concat_ws("/", "mesh", "fid", "vid")
    hub = corner.groupBy("mesh", "vid", "other").agg(F.min("fid").alias("first"))
    link = corner.join(hub, ["mesh", "vid", "other"]).select(number.alias("a"), F.concat_ws("/", "mesh", "first", "vid").alias("b"))
    roots = components(link.filter("a <> b"))
    every = corner.select("mesh", "vid", number.alias("node")).distinct().join(roots, "node", "left")
    return every.groupBy("mesh", "vid").agg(F.count_distinct(F.coalesce("root", "node")).alias("fans"))


def is_closed(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Per mesh whether it is closed, consistently wound and manifold in edges and vertices."""
    t = edge_topology(vertices, faces)
    fans = vertex_fans(faces).groupBy("mesh").agg(F.count_if(F.col("fans") > 1).alias("split_vertices"))
    fine = (F.col("boundary") == 0) & (F.col("nonmanifold") == 0) & (F.col("unbalanced") == 0) & (F.col("unreferenced") == 0) & (F.col("repeated") == 0) & (F.col("split_vertices") == 0)
    return t.join(fans, "mesh").withColumn("closed", fine)


def weld(vertices: DataFrame) -> DataFrame:
    """Each vertex with the smallest vid at exactly its place."""
    place = Window.partitionBy("mesh", "x", "y", "z")
    return vertices.withColumn("welded", F.min("vid").over(place))


def mesh_components(faces: DataFrame) -> DataFrame:
    """Faces with the smallest vertex of their component (faces that share a vertex are connected)."""
    star = faces.select("mesh", F.explode(F.array(F.struct(F.col("v0").alias("p"), F.col("v1").alias("q")), F.struct(F.col("v0").alias("p"), F.col("v2").alias("q")))).alias("e"))
    name = lambda c: F.struct("mesh", F.col(c).alias("vid"))
    roots = components(star.select("mesh", "e.p", "e.q").select(name("p").alias("a"), name("q").alias("b")))
    return faces.join(roots.withColumnRenamed("node", "n"), name("v0") == F.col("n")).drop("n")


def largest_component(faces: DataFrame) -> DataFrame:
    """The faces of each mesh's component with most faces (of equal ones that with the smallest root)."""
    c = mesh_components(faces)
    size = c.groupBy("mesh", "root").count()
    best = size.groupBy("mesh").agg(F.max_by("root", F.struct("count", F.lit(0))).alias("any"), F.max("count").alias("count"))
    chosen = size.join(best.select("mesh", "count"), ["mesh", "count"]).groupBy("mesh").agg(F.min("root").alias("root"))
    return c.join(chosen, ["mesh", "root"], "left_semi").drop("root")


def seed_patch(geometry: DataFrame, seed: int, origin, basis, half: float, depth: float, cosine: float = 0.25) -> DataFrame:
    """Faces that reach into a box around a seed face, face alike, and hang together with it by shared vertices: fid.

    origin and the basis (rows e_u, e_v, n) are numbers.  The box cuts the mesh down before components are sought.
    """
    o = [F.lit(float(x)) for x in origin]
    near = geometry
    for axis, most in zip(basis, (half, half, depth), strict=True):
        along = [sum((((F.col(f"{n}{a}") - o[i]) * F.lit(float(axis[i]))) for i, a in enumerate("xyz")), F.lit(0.0)) for n in "abc"]
        near = near.filter((F.least(*along) <= most) & (F.greatest(*along) >= -most))
    turn = sum((F.col(f"n{a}") * F.lit(float(basis[2][i])) for i, a in enumerate("xyz")), F.lit(0.0))
    part = mesh_components(near.filter(turn >= cosine).select("mesh", "fid", "v0", "v1", "v2"))
    own = part.filter(F.col("fid") == seed).select("mesh", "root").distinct()
    return part.join(F.broadcast(own), ["mesh", "root"], "left_semi").select("mesh", "fid")


def bounds(rows: DataFrame, *keys: str, axes=("x", "y", "z")) -> DataFrame:
    """Axis-aligned bounds of the points of each group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[f(a).alias(f"{name}_{a}") for a in axes for f, name in ((F.min, "lo"), (F.max, "hi"))])


def median_split(points: DataFrame, levels: int | None = None, most: int = 1024, group: str = "mesh", id_col: str = "id") -> DataFrame:
    """Adds the path of a median-split tree: a group of more than `most` points splits its longest axis (first on a tie) at the middle.

    All groups of a level split in one window pass; points of a tie are ordered by id.  The path has one letter a level.
    Without `levels` the split goes on until no group has more than `most` points: the largest group, n points, needs
    as many levels as bring ceil(n / 2^levels) down to `most`.
    """
    if levels is None:
        if most < 1:
            raise ValueError("a group holds one point at least")
        largest = points.groupBy(group).count().agg(F.max("count")).first()[0] or 0
        levels = (-(-largest // most) - 1).bit_length() if largest > most else 0
    now = points.withColumn("path", F.lit(""))
    for _ in range(levels):
        own = Window.partitionBy(group, "path")
        spans = [F.max(a).over(own) - F.min(a).over(own) for a in ("x", "y", "z")]
        now = now.select("*", F.count("*").over(own).alias("n__"), *[s.alias(f"s{a}__") for s, a in zip(spans, "xyz", strict=True)])
        longest = F.when((F.col("sx__") >= F.col("sy__")) & (F.col("sx__") >= F.col("sz__")), F.col("x")).when(F.col("sy__") >= F.col("sz__"), F.col("y")).otherwise(F.col("z"))
        now = now.withColumn("along__", longest)
        rank = F.row_number().over(Window.partitionBy(group, "path").orderBy("along__", id_col))
        half = F.floor(F.col("n__") / 2)
        now = now.withColumn("rank__", rank).withColumn("path", F.concat("path", F.when(F.col("n__") <= most, "").when(F.col("rank__") <= half, "l").otherwise("r")))
        now = now.drop("n__", "sx__", "sy__", "sz__", "along__", "rank__")
    return now


def max_radius(geometry: DataFrame) -> DataFrame:
    """Per mesh the largest distance of a face's corner from its centroid."""
    far = [norm(sub(vec(f"{n}x", f"{n}y", f"{n}z"), vec("mx", "my", "mz"))) for n in "abc"]
    return geometry.groupBy("mesh").agg(F.max(F.greatest(*far)).alias("radius"))


def block_faces(geometry: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """The faces of one block, from members (block, mesh, fid)."""
    return geometry.join(members.filter(F.col("block") == block).select("mesh", "fid"), ["mesh", "fid"])


def leaf_integrity(faces: DataFrame, members: DataFrame) -> DataFrame:
    """Per mesh the faces in no leaf, in several leaves, and the members that are no face: mesh, missing, repeated, unknown."""
    held = members.groupBy("mesh", "fid").agg(F.count("*").alias("n"))
    j = faces.select("mesh", "fid", F.lit(True).alias("face")).join(held, ["mesh", "fid"], "full")
    return j.groupBy("mesh").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("face") & (F.col("n") > 1)).alias("repeated"), F.count_if(F.col("face").isNull()).alias("unknown"))
