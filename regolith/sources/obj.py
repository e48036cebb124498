"""Wavefront OBJ text as tables, read and written without a driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERTICES = "mesh string, vid int, x float, y float, z float"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of OBJ files: mesh (the file), no, line.  Files are read whole, so that line numbers are those of the file."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("mesh"), "value")
    return text.select("mesh", F.posexplode(F.split("value", "\\r\\n|\\n|\\r")).alias("no", "line"))


def _statements(lines: DataFrame, word: str) -> DataFrame:
    """Statements with exactly this keyword, without comments: mesh, no, args."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("line", "#.*$", ""), "\\s+", " "))
    parts = F.split(clean, " ")
    return lines.select("mesh", "no", parts.alias("p")).filter(F.col("p")[0] == word).select("mesh", "no", F.slice("p", F.lit(2), F.size("p")).alias("args"))


def vertices_of(lines: DataFrame) -> DataFrame:
    """Vertices in the order of their lines: mesh, vid (from 0), x, y, z and the line; further values of a line are not read."""
    v = _statements(lines, "v").filter(F.size("args") >= 3)
    number = F.row_number().over(Window.partitionBy("mesh").orderBy("no")) - 1
    return v.select("mesh", number.cast("int").alias("vid"), *[F.col("args")[i].cast("float").alias(a) for i, a in enumerate("xyz")], "no")


def faces_of(lines: DataFrame) -> DataFrame:
    """Triangles: mesh, fid, v0, v1, v2.  References `a`, `a/b`, `a//c`, `a/b/c` keep a; a polygon becomes a fan.

    A negative reference counts back from the vertices that stand before its line.
    """
    f = _statements(lines, "f").filter(F.size("args") >= 3)
    both = f.select("mesh", "no", "args").unionByName(_statements(lines, "v").filter(F.size("args") >= 3).select("mesh", "no", F.lit(None).cast("array<string>").alias("args")))
    before = F.count_if(F.col("args").isNull()).over(Window.partitionBy("mesh").orderBy("no"))
    f = both.withColumn("before", before).filter(F.col("args").isNotNull())
    refs = F.transform("args", lambda a: F.element_at(F.split(a, "/"), 1).cast("long"))
    f = f.withColumn("refs", F.transform(refs, lambda r: F.when(r < 0, F.col("before") + r).otherwise(r - 1)))
    fan = f.select("mesh", "no", "refs", F.explode(F.sequence(F.lit(1), F.size("refs") - 2)).alias("i"))
    tri = fan.select("mesh", "no", "i", F.col("refs")[0].alias("v0"), F.col("refs")[F.col("i")].alias("v1"), F.col("refs")[F.col("i") + 1].alias("v2"))
    number = F.row_number().over(Window.partitionBy("mesh").orderBy("no", "i")) - 1
    return tri.select("mesh", number.cast("long").alias("fid"), "v0", "v1", "v2")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = read_lines(spark, path)
    return vertices_of(lines).drop("no"), faces_of(lines)


def malformed(lines: DataFrame) -> DataFrame:
    """Vertex and face statements with too few values, or values that are no numbers: mesh, no, line."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("line", "#.*$", ""), "\\s+", " "))
    p = F.split(clean, " ")
    few = F.size(p) < 4
    words = F.slice(p, 2, 3)
    wrong = F.exists(words, lambda a: F.when(p[0] == "v", F.expr("true") & a.try_cast("double").isNull()).otherwise(F.element_at(F.split(a, "/"), 1).try_cast("long").isNull()))
    return lines.filter(p[0].isin("v", "f") & (few | wrong))


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """OBJ lines of each mesh: used vertices renumbered densely from 1 in the order of vid, then faces: mesh, part, no, line."""
    used = faces.select("mesh", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    dense = vertices.join(used, ["mesh", "vid"], "left_semi").withColumn("no", F.row_number().over(Window.partitionBy("mesh").orderBy("vid")))
    v = dense.select("mesh", F.lit(0).alias("part"), F.col("no").cast("long").alias("no"), F.format_string("v %s %s %s", *[F.col(a).cast("string") for a in "xyz"]).alias("line"))
    number = dense.select("mesh", F.col("vid").alias("key"), F.col("no").alias("n"))
    f = faces
    for k in range(3):
        f = f.join(number.select("mesh", F.col("key").alias(f"v{k}"), F.col("n").alias(f"n{k}")), ["mesh", f"v{k}"])
    return v.unionByName(f.select("mesh", F.lit(1).alias("part"), F.col("fid").cast("long").alias("no"), F.format_string("f %d %d %d", "n0", "n1", "n2").alias("line")))


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One folder a mesh with a single sorted text file; Spark's committer replaces the target only when all is written."""
    lines = obj_lines(vertices, faces).repartition("mesh").sortWithinPartitions("mesh", "part", "no")
    lines.select("mesh", "line").write.mode("overwrite").partitionBy("mesh").text(path)


def nine_digits(x: Column) -> Column:
    """A number with nine significant digits, without trailing zeros; with an exponent below 1e-4 and from 1e9 on.  (Subnormal numbers come with as many digits as tell them.)"""
    whole = F.format_string("%.8e", x.cast("double"))
    power = F.split(whole, "e")[1].cast("int")
    plain = F.call_function("format_string", F.concat(F.lit("%."), F.greatest(F.lit(8) - power, F.lit(0)).cast("string"), F.lit("f")), x.cast("double"))
    short = lambda t: F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, "0+$", ""), "\\.$", "")).otherwise(t)
    exponent = F.concat(short(F.split(whole, "e")[0]), F.lit("e"), F.split(whole, "e")[1])
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).otherwise(F.when((power >= -4) & (power < 9), short(plain)).otherwise(exponent))


def _marked(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/mark")))


def publish(vertices: DataFrame, faces: DataFrame, path: str) -> int:
    """The meshes' lines as a new version under path; it counts once its mark is written, so a failure leaves the version before in force."""
    spark = vertices.sparkSession
    number = max(_marked(spark, path), default=-1) + 1
    text = vertices.select("mesh", "vid", *[nine_digits(F.col(a)).alias(a) for a in "xyz"])
    lines = obj_lines(text, faces).repartition("mesh").sortWithinPartitions("mesh", "part", "no")
    lines.select("mesh", "line").write.mode("overwrite").partitionBy("mesh").text(f"{path}/version={number}/text")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/version={number}/mark")
    return number


def published(spark: SparkSession, path: str) -> str:
    """The folder of the newest version that was written to its end."""
    marks = _marked(spark, path)
    if not marks:
        raise FileNotFoundError(path)
    return f"{path}/version={marks[-1]}/text"


SOURCES = ("auto", "mesh", "maplets", "patches", "fused")


def export(path: str, source: str = "auto", mesh: tuple[DataFrame, DataFrame] | None = None, maplets: tuple[DataFrame, DataFrame] | None = None, keep_largest: bool = False) -> int:
    """Publishes a model's surface: its mesh (vertices, faces), or the faces of its active maplets (samples, maplets), joined in one body or as patches of their own.

    auto takes the mesh where there is one, else the maplets.  `fused`, a closed surface through all points, needs a solver
    that is not at hand, and raises.  keep_largest keeps the component with the most faces of each body.
    """
    from regolith.operators import mesh as meshes
    from regolith.operators.occlusion import surface

    if source not in SOURCES:
        raise ValueError(f"{source} is none of {', '.join(SOURCES)}")
    if source == "fused":
        raise NotImplementedError("a closed surface needs a Poisson solver; export the maplets, or views.fused for the cloud")
    if source == "mesh" or source == "auto" and mesh is not None:
        if mesh is None:
            raise ValueError("there is no mesh")
        vertices, faces = mesh
    else:
        if maplets is None:
            raise ValueError("there are no maplets")
        samples, frames = maplets
        if "active" in frames.columns:
            frames = frames.filter("active")
        s = samples.join(frames.select("k"), "k", "left_semi")
        f = surface(s, frames)
        # Corners of one maplet at one place are one vertex.
        corner = F.posexplode(F.array(*[F.struct(*[F.col(f"{n}{a}").alias(a) for a in "xyz"]) for n in "abc"])).alias("at", "p")
        points = f.select("k", "fid", corner).select("k", "fid", "at", "p.x", "p.y", "p.z")
        body = F.col("k").cast("string") if source == "patches" else F.lit("body")
        key = F.struct("k", "x", "y", "z")
        named = points.select("k", "fid", "at", "x", "y", "z", F.xxhash64(key).alias("vid"))
        vertices = named.select(body.alias("mesh"), "vid", "x", "y", "z").distinct()
        faces = named.groupBy("k", "fid").agg(*[F.max(F.when(F.col("at") == n, F.col("vid"))).alias(f"v{n}") for n in range(3)])
        faces = faces.select(body.alias("mesh"), (F.col("k") * (1 << 32) + F.col("fid")).alias("fid"), "v0", "v1", "v2")
    if keep_largest:
        faces = meshes.largest_component(faces)
    return publish(vertices, faces, path)
