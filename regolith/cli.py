"""spark-submit entry points: read a mesh, render an orbit, compare two meshes.

    spark-submit regolith/cli.py mesh --obj in.obj --out tables/
    spark-submit regolith/cli.py orbit --obj in.obj --out frames/ --views 360
    spark-submit regolith/cli.py similarity --rec a.obj --ref b.obj --points 100000
"""

from __future__ import annotations

import argparse
import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from regolith.functions.vec import micro
from regolith.operators import mesh, raster, register, sampling
from regolith.sources import obj, reports


def _geometry(spark, path):
    v, f = obj.read_obj(spark, path)
    return v, f, mesh.face_geometry(v.select("mesh", "vid", *[F.col(a).cast("double").alias(a) for a in "xyz"]), f)


def read_mesh(spark, path: str, out: str, levels: int | None = None, most: int = 1024):
    """Vertices, faces with geometry, and blocks of a median split, as tables; returns counts.

    Blocks hold `most` faces at most, unless `levels` stops the split before.
    """
    v, f, g = _geometry(spark, path)
    v.write.mode("overwrite").parquet(f"{out}/vertices")
    g.write.mode("overwrite").parquet(f"{out}/faces")
    centres = spark.read.parquet(f"{out}/faces").select("mesh", F.col("fid").alias("id"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
    blocks = mesh.median_split(centres, levels, most)
    blocks.select("mesh", F.col("id").alias("fid"), "path").write.mode("overwrite").parquet(f"{out}/blocks")
    return spark.read.parquet(f"{out}/blocks").groupBy("mesh").agg(F.count("*").alias("faces"), F.count_distinct("path").alias("blocks"))


def orbit(spark, path: str, out: str, views: int, size: int = 256, fill: float = 0.85, light: float = 45.0):
    """Frames of an orbit around the longest axis's plane, as PGM text; the light stands at an angle to the view."""
    _, _, g = _geometry(spark, path)
    m = register.moments(g.select(F.lit(0).alias("one"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z")), "one").first()
    axes = register.principal_axes(m)
    axis = axes[:, -1] * (1 if axes[abs(axes[:, -1]).argmax(), -1] > 0 else -1)
    e1, e2 = axes[:, 0], [axis[1] * axes[2, 0] - axis[2] * axes[1, 0], axis[2] * axes[0, 0] - axis[0] * axes[2, 0], axis[0] * axes[1, 0] - axis[1] * axes[0, 0]]
    radius = g.agg(F.max(F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2))).first()[0]
    focal = float(size)
    distance = radius / math.sin(math.atan(0.5) * fill)
    cams = raster.orbit(distance, views, light, tuple(axis), tuple(e1), tuple(e2), spark=spark).select(F.col("request").alias("cam"), F.lit(focal).alias("f"), F.lit(size / 2.0).alias("pp"), F.lit(size).alias("side"), *[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2", "l0", "l1", "l2")
    seen = raster.cull_backfaces(raster.with_cameras(g, cams))
    buffer = raster.z_buffer(raster.project_faces(seen, 1e-6, size, size))
    lit = buffer.join(F.broadcast(cams.select("cam", "l0", "l1", "l2")), "cam").join(g.select("mesh", "fid", "nx", "ny", "nz"), ["mesh", "fid"])
    lambert = F.least(F.greatest(-(F.col("nx") * F.col("l0") + F.col("ny") * F.col("l1") + F.col("nz") * F.col("l2")), F.lit(0.0)), F.lit(1.0))
    shaded = lit.select("mesh", "cam", "px", "py", F.floor((F.lit(0.15) + F.lit(0.85) * lambert) * 255).cast("int").alias("gray"))
    frames = raster.frame(shaded, g.select("mesh").distinct().crossJoin(cams.select("cam")), size, size)
    reports.write_frames(reports.pgm(frames, size, size, "mesh", "cam"), out, "mesh", "cam")


def similarity(spark, rec: str, ref: str, points: int, threshold: float = 0.01, aligned: bool = True):
    """F-score of two surfaces from samples by area."""
    clouds = []
    for k, path in enumerate((rec, ref)):
        g = _geometry(spark, path)[2]
        faces = g.select(F.lit(k).cast("long").alias("mesh"), F.col("fid").cast("long").alias("fid"), *[f"{n}{x}" for n in "abc" for x in "xyz"], F.greatest(micro(F.col("area")), F.lit(1)).alias("weight"))
        clouds.append(sampling.random_samples(faces, points, 1 + k).select(F.col("sample").alias("id"), *[F.col(f"p{a}").alias(a) for a in "xyz"]))
    return register.cloud_similarity(*clouds, threshold, aligned)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("mesh")
    a.add_argument("--obj", required=True)
    a.add_argument("--out", required=True)
    b = sub.add_parser("orbit")
    b.add_argument("--obj", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--views", type=int, default=360)
    c = sub.add_parser("similarity")
    c.add_argument("--rec", required=True)
    c.add_argument("--ref", required=True)
    c.add_argument("--points", type=int, default=100_000)
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.what == "mesh":
        read_mesh(spark, args.obj, args.out).show()
    elif args.what == "orbit":
        orbit(spark, args.obj, args.out, args.views)
    else:
        similarity(spark, args.rec, args.ref, args.points).show()


if __name__ == "__main__":
    main()
