"""Publishing surfaces as OBJ text."""

import math

import pytest
from pyspark.sql import functions as F

from regolith.operators import mesh
from regolith.sources import obj


@pytest.fixture(scope="module")
def maplets(spark):
    frame = ", ".join(f"b{i}{j} double" for i in range(3) for j in range(3))
    one = [float(i == j) for i in range(3) for j in range(3)]
    m = spark.createDataFrame([(k, 3, 3, 5.0 * k, 0.0, 0.0, *one, 1.0, k < 2) for k in range(3)], f"k long, ny int, nx int, ox double, oy double, oz double, {frame}, spacing double, active boolean")
    s = spark.createDataFrame([(k, r, c, 0.125 * r, not (k == 1 and r == 0)) for k in range(3) for r in range(3) for c in range(3)], "k long, r long, c long, h double, valid boolean")
    return s, m


def read(spark, path, body):
    lines = spark.read.text(f"{path}/mesh={body}").select(F.lit("m").alias("mesh"), F.monotonically_increasing_id().alias("no"), F.col("value").alias("line"))
    return obj.vertices_of(lines).collect(), obj.faces_of(lines).collect()


def test_modes_and_versions(spark, maplets, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        obj.published(spark, path)
    assert obj.export(path, "patches", maplets=maplets) == 0
    v, f = read(spark, obj.published(spark, path), "0")
    assert len(v) == 9 and len(f) == 8 and {x for r in f for x in (r["v0"], r["v1"], r["v2"])} == set(range(9))
    v, f = read(spark, obj.published(spark, path), "1")
    assert len(v) == 6 and len(f) == 4  # its first row is invalid
    assert obj.export(path, "auto", maplets=maplets) == 1
    v, f = read(spark, obj.published(spark, path), "body")
    assert len(v) == 15 and len(f) == 12  # the third maplet is not active
    assert obj.export(path, "maplets", maplets=maplets, keep_largest=True) == 2
    v, f = read(spark, obj.published(spark, path), "body")
    assert len(v) == 9 and len(f) == 8
    for bad, error in (("fused", NotImplementedError), ("other", ValueError), ("mesh", ValueError)):
        with pytest.raises(error):
            obj.export(path, bad, maplets=maplets)
    broken = maplets[0].withColumn("h", F.when(F.col("k") == 0, F.raise_error(F.lit("stop"))).otherwise(F.col("h")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        obj.export(path, "maplets", maplets=(broken, maplets[1]))
    assert obj.published(spark, path).endswith("version=2/text")  # what was there stays


def test_nine_digits(spark):
    values = [0.0, 1.0, -1.5, 0.1, 1 / 3, 123456789.125, 1234567890.0, 1e-4, 9.99999999e-5, 1e300, -2.5e-12, 999999999.6, None, math.nan]
    got = [r["t"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", obj.nine_digits(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == ["%.9g" % v if v is not None and v == v else None for v in values]


def test_tiny_faces_have_normals(spark):
    e = 1e-170
    v = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, e, 0.0, 0.0), ("m", 2, 0.0, e, 0.0), ("m", 3, 0.0, 0.0, 0.0)], "mesh string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 0, 1, 3)], "mesh string, fid long, v0 long, v1 long, v2 long")
    got = {r["fid"]: (r["nx"], r["ny"], r["nz"]) for r in mesh.face_geometry(v, f).collect()}
    assert got == {0: (0.0, 0.0, 1.0), 1: (0.0, 0.0, 0.0)}
    with pytest.raises(ValueError, match="no face"):
        mesh.usable_faces(mesh.face_geometry(v, f))
