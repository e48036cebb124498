"""Meshes, maplets and rendering on small known shapes."""

import math

import pytest
from pyspark.sql import functions as F

from regolith.operators import maplet, mesh, raster, sampling
from regolith.operators.graph import components
from regolith.sources import obj
from regolith.sources.images import ImageStore

CUBE_V = [(0, i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
CUBE_F = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def _cube(spark, faces=CUBE_F):
    v = spark.createDataFrame(CUBE_V, "mesh long, vid long, x double, y double, z double")
    return v, spark.createDataFrame([(0, i, *f) for i, f in enumerate(faces)], "mesh long, fid long, v0 long, v1 long, v2 long")


def test_closed_cube_and_its_damages(spark):
    assert mesh.is_closed(*_cube(spark)).first()["closed"]
    hole = mesh.edge_topology(*_cube(spark, CUBE_F[1:])).first()
    assert (hole["boundary"], hole["nonmanifold"]) == (3, 0)
    assert not mesh.is_closed(*_cube(spark, CUBE_F[1:])).first()["closed"]
    flipped = [CUBE_F[0][::-1], *CUBE_F[1:]]
    assert mesh.edge_topology(*_cube(spark, flipped)).first()["unbalanced"] == 3
    again = mesh.edge_topology(*_cube(spark, [*CUBE_F, CUBE_F[0]])).first()
    assert again["repeated"] == 1 and again["nonmanifold"] == 3


def test_bow_tie_vertex_has_two_fans(spark):
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 3, 4)], "mesh long, fid long, v0 long, v1 long, v2 long")
    assert {r["vid"]: r["fans"] for r in mesh.vertex_fans(f).collect()} == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1}


def test_face_geometry(spark):
    g = mesh.face_geometry(*_cube(spark))
    assert g.agg(F.sum("area")).first()[0] == pytest.approx(6)
    assert g.agg(*[F.sum(F.col(f"n{a}") * F.col("area")) for a in "xyz"]).first() == pytest.approx((0, 0, 0))
    assert mesh.mesh_components(_cube(spark)[1]).select("root").distinct().count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 3)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[102] == 100


def test_largest_component(spark):
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 5, 6, 7), (0, 2, 6, 7, 8)], "mesh long, fid long, v0 long, v1 long, v2 long")
    assert sorted(r["fid"] for r in mesh.largest_component(f).collect()) == [1, 2]


def test_lattice_with_hole(spark):
    samples = [(0, r, c) for r in range(3) for c in range(3) if (r, c) != (0, 0)]
    t = maplet.triangles(spark.createDataFrame(samples, "k long, r long, c long"), 3)
    assert t.count() == 7
    assert t.filter("fid < 2").select("v0", "v1", "v2").first() == (1, 4, 3)


def test_render_is_nearest_and_cached_buffer_relights(spark):
    v = spark.createDataFrame([(0, 0, -1.0, -1.0, 0.0), (0, 1, 1.0, -1.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, -1.0, -1.0, 1.0), (0, 4, 1.0, -1.0, 1.0), (0, 5, 0.0, 1.0, 1.0)], "mesh long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 3, 4, 5), (0, 2, 3, 5, 4)], "mesh long, fid long, v0 long, v1 long, v2 long")
    cam = spark.createDataFrame([(0, 32.0, 15.5, 32, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 3.0)], "cam long, f double, pp double, side int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", t0 double, t1 double, t2 double")
    g = mesh.face_geometry(v, f)
    seen = raster.render(g, cam, (0.0, 0.0, -1.0), width=32, height=32)
    assert {r["fid"] for r in seen.select("fid").distinct().collect()} == {1}
    assert seen.select("gray").distinct().first()[0] == 255
    grazing = raster.render(g, cam, (1.0, 0.0, 0.0), width=32, height=32)
    assert grazing.select("gray").distinct().first()[0] == math.floor(0.15 * 255)
    assert grazing.count() == seen.count()


def test_orbit_looks_at_origin(spark):
    for r in raster.orbit(5.0, 8, 45.0, spark=spark).collect():
        assert [r["t0"], r["t1"], r["t2"]] == pytest.approx([0, 0, 5], abs=1e-9)


def test_samples_follow_area(spark):
    faces = spark.createDataFrame([(0, 0, 10, *[0.0] * 3, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0, 1, 30, *[0.0] * 3, 0.0, 0.0, 1.0, 0.0, 3.0, 0.0), (0, 2, 0, *[0.0] * 9)], "mesh long, fid long, weight long, " + ", ".join(f"{n}{x} double" for n in "abc" for x in "xyz"))
    s = {r["fid"]: r["count"] for r in sampling.stratified(faces, 400).groupBy("fid").count().collect()}
    assert s == {0: 100, 1: 300}
    drawn = {r["fid"]: r["count"] for r in sampling.random_samples(faces, 400, 1).groupBy("fid").count().collect()}
    assert sum(drawn.values()) == 400 and 2 not in drawn and 60 < drawn[0] < 140


def test_obj_round_trip(spark, tmp_path):
    (tmp_path / "in.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 9 9 9\nv 0 1 0\nf 1 2 3 -1\n")
    v, f = obj.read_obj(spark, str(tmp_path / "in.obj"))
    assert [tuple(r)[2:] for r in f.orderBy("fid").collect()] == [(0, 1, 2), (0, 2, 4)]
    obj.write_obj(v, f, str(tmp_path / "out"))
    v2, f2 = obj.read_obj(spark, str(tmp_path / "out/*/*.txt"))
    assert (v2.count(), f2.count()) == (4, 2)
    bad = obj.malformed(spark.createDataFrame([("m", 0, "v 1 2"), ("m", 1, "f 1 2 x"), ("m", 2, "v 1 2 3"), ("m", 3, "# v")], "mesh string, no int, line string"))
    assert sorted(r["no"] for r in bad.collect()) == [0, 1]


def test_image_store_versions(spark, tmp_path):
    store = ImageStore(spark, str(tmp_path / "store"))
    px = spark.createDataFrame([(0, 0, 0, 1.0, True), (1, 0, 0, 2.0, True)], "image_id long, row int, col int, value float, valid boolean")
    store.create(spark.createDataFrame([(0,), (1,)], "image_id long"), px)
    store.replace(1, spark.createDataFrame([(0, 0, 5.0, True)], "row int, col int, value float, valid boolean"))
    new = store.append(spark.createDataFrame([(7, "late")], "image_id long, note string"), px.filter("image_id = 0").withColumn("image_id", F.lit(7).cast("long")))
    assert new.first() == (7, 2)
    assert {r["image_id"]: r["value"] for r in store.pixels().collect()} == {0: 1.0, 1: 5.0, 2: 1.0}
    assert store.view(1).first()["value"] == 5.0
    assert {r["image_id"]: r["note"] for r in store.images().collect()}[0] is None
