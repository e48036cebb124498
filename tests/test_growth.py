"""Splitting, tiling, patches, information, reports and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith import cli
from regolith.operators import growth, information, mesh, planner
from regolith.sources import reports


def test_rays_meet_a_tilted_plane():
    y, x = np.mgrid[:9, :9]
    field = 0.2 * (x - 4) * 0.5 - 0.1 * (y - 4) * 0.5
    starts = np.array([[0.3, 0.2, 0.0], [10.0, 0, 0]])
    t, ok = growth.intersect_field(field, np.ones_like(field, bool), 0.5, starts, np.array([0, 0, 1.0]))
    assert ok.tolist() == [True, False] and t[0] == pytest.approx(0.2 * 0.3 - 0.1 * 0.2, abs=1e-4)
    assert not growth.intersect_field(field, np.zeros_like(field, bool), 0.5, starts, np.array([0, 0, 1.0]))[1].any()


def test_children_of_a_plane_are_flat(spark):
    rows = [(3, r, c, 0.3 * (c - 8) * 0.1, True) for r in range(17) for c in range(17)]
    got = growth.split_maplets(spark.createDataFrame(rows, "k long, r long, c long, h double, valid boolean"), 0.1, 10).toPandas()
    assert sorted(got["k"].unique()) == [22, 23, 24, 25] and (got["parent"] == 3).all()
    for _, own in got.groupby("k"):
        axes = own.iloc[0][[f"b{i}{j}" for i in range(3) for j in range(3)]].to_numpy(float).reshape(3, 3)
        assert own["valid"].mean() > 0.8 and own.loc[own["valid"], "h"].abs().max() < 1e-3
        assert 0.05 <= own["spacing"].iloc[0] < 0.06 and np.allclose(axes.T @ axes, np.eye(3))


def test_seeding_covers_a_sheet(spark):
    rows = [(i * 20 + j, i * 0.1, j * 0.1, 0.0, 0.0, 0.0, 1.0, 1.0 + (i == 10 and j == 10)) for i in range(20) for j in range(20)]
    c = growth.seed_maplets(spark.createDataFrame(rows, "id long, x double, y double, z double, nx double, ny double, nz double, weight double"), 0.4, depth=0.1).orderBy("k").collect()
    assert c[0]["id"] == 210 and 9 <= len(c) <= 40
    p = np.array([r[1:3] for r in rows])
    assert all(min(max(abs(x - r["ox"]), abs(y - r["oy"])) for r in c) <= 0.3 + 1e-9 for x, y in p)


def test_patch_stays_on_its_layer(spark):
    tri = lambda z, k: [(0, k, 10 * k, 10 * k + 1, 10 * k + 2, 0.0, 0.0, z, 1.0, 0.0, z, 0.0, 1.0, z, 0.0, 0.0, 1.0)]
    g = spark.createDataFrame(tri(0.0, 0) + tri(0.1, 1), "mesh long, fid long, v0 long, v1 long, v2 long, " + ", ".join(f"{n}{a} double" for n in ("a", "b", "c", "n") for a in "xyz"))
    assert [r["fid"] for r in mesh.seed_patch(g, 1, (0, 0, 0), np.eye(3), 2.0, 1.0).collect()] == [1]


def test_acceptance_needs_all_observations(spark):
    before = spark.createDataFrame([(0, 1.0, 5), (1, 1.0, 5)], "k long, cost double, n long")
    trials = spark.createDataFrame([(0, 0, 0.1, 4), (0, 1, 0.5, 5), (0, 2, 0.4, 5), (1, 0, 1.0, 5)], "k long, step long, cost double, n long")
    got = {r["k"]: (r["step"], r["after"]) for r in growth.accept_heights(before, trials).collect()}
    assert got == {0: (1, 0.5), 1: (None, 1.0)}


def test_information_of_a_line_fit(spark):
    rows = [(0, o, i, v, 0.5) for o in range(6) for i, v in ((0, 1.0), (1, float(o)))]
    entries = information.information(spark.createDataFrame(rows, "k long, obs long, i long, value double, sigma double"), "k")
    j = np.array([[1.0, o] for o in range(6)])
    f = j.T @ j / 0.25
    assert {(r["i"], r["j"]): r["f"] for r in entries.collect()} == {(a, b): pytest.approx(f[a, b]) for a in range(2) for b in range(2)}
    sigma = information.height_covariance(entries, 1, 0.0).first()["sigma"]
    assert sigma == pytest.approx(np.linalg.inv(f)[0, 0] ** 0.5)
    eff = information.effective_information(spark.createDataFrame([(0, 1.0, float(o), 0.25) for o in range(6)], "k long, b double, h double, variance double"), "k").first()
    assert eff["information"] == pytest.approx(1 / np.linalg.inv(f)[0, 0])
    gains = information.view_gain(np.eye(2), [np.eye(2), np.zeros((2, 2))], np.array([1.0]))
    assert gains == pytest.approx([0.5, 0.0])
    assert information.best_view(spark.createDataFrame([("s", 2, 0.5), ("s", 1, 0.5)], "scene string, view long, gain double")).first()["view"] == 1
    far = information.farthest_points(spark.createDataFrame([(0, i, float(x), 0.0, 0.0) for i, x in enumerate([0, 1, 5])], "group long, id long, x double, y double, z double"), 2)
    assert [r["id"] for r in far.orderBy("place").collect()] == [0, 2]


def test_weights_round_trip(spark, tmp_path):
    w = planner.weights(5)
    information.save_weights(spark, w, str(tmp_path / "w"))
    got = information.load_weights(spark, str(tmp_path / "w"))
    assert all((got[k] == w[k]).all() for k in w)
    with pytest.raises(ValueError):
        information.load_weights(spark, str(tmp_path / "w"), version=4)


def test_reports(spark, tmp_path):
    s = reports.timing_summary(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "run string, seconds double"), "run").first()
    assert (s["frames"], s["mean"], s["total"], s["per_second"]) == (2, 2.0, 4.0, 0.5)
    px = spark.createDataFrame([(0, r, c, 10 * r + c) for r in range(2) for c in range(3)], "cam long, py int, px int, gray int")
    assert reports.pgm(px, 3, 2, "cam").first()["pgm"] == "P2\n3 2\n255\n0 1 2\n10 11 12\n"
    assert reports.seeded_subset(px.withColumn("id", F.col("gray")), 3, 1).count() == 3


def test_command_line(spark, tmp_path):
    lines = [f"v {i & 1} {i >> 1 & 1} {i >> 2 & 1}" for i in range(8)]
    quads = ["f 1 3 4 2", "f 5 6 8 7", "f 1 2 6 5", "f 3 7 8 4", "f 1 5 7 3", "f 2 4 8 6"]
    (tmp_path / "cube.obj").write_text("\n".join(lines + quads) + "\n")
    path = str(tmp_path / "cube.obj")
    assert cli.read_mesh(spark, path, str(tmp_path / "t"), most=4).first()["blocks"] == 4
    assert cli.similarity(spark, path, path, 60, threshold=0.5, aligned=False).first()["f"] == 1.0
    cli.orbit(spark, path, str(tmp_path / "frames"), 2, size=16)
    frames = list((tmp_path / "frames").rglob("*.txt"))
    assert len(frames) == 2 and all(f.read_text().startswith("P2\n16 16\n") for f in frames)


def test_rays_meet_many_fields_in_one_call_as_in_one_each():
    draw = np.random.default_rng(2)
    m, n = 7, 300
    grids, valid = draw.normal(0, 0.05, (m, 6, 8)), draw.random((m, 6, 8)) > 0.1
    valid[3] = False
    spacings, of = draw.uniform(0.1, 0.3, m), draw.integers(0, m, n)
    starts = np.c_[draw.uniform(-1, 1, (n, 2)), draw.normal(0, 0.1, n)]
    directions = np.c_[draw.normal(0, 0.3, (n, 2)), draw.choice([1.0, -1.0, 0.0], n, p=[0.7, 0.2, 0.1])]
    t, ok = growth.intersect_fields(grids, valid, spacings, of, starts, directions)
    for i in range(n):
        at, met = _first_meeting(grids[of[i]], valid[of[i]], spacings[of[i]], starts[i], directions[i])
        assert ok[i] == met and t[i] == at
    assert 40 < ok.sum() < 200


def _first_meeting(grid, valid, spacing, start, direction, steps=48):
    if not valid.any() or direction[2] == 0:
        return 0.0, False

    def gap(t):
        p = start + t * direction
        u, v = p[0] / spacing + (grid.shape[1] - 1) / 2, p[1] / spacing + (grid.shape[0] - 1) / 2
        h, fine = growth.bilinear_array(grid, valid, np.array([u]), np.array([v]))
        return p[2] - h[0], fine[0]

    a, b = (grid[valid].min() - spacing - start[2]) / direction[2], (grid[valid].max() + spacing - start[2]) / direction[2]
    first, last = min(a, b), max(a, b)
    at = [first] + [first + (last - first) * k / steps for k in range(1, steps + 1)]
    for low, high in zip(at, at[1:]):
        (g0, f0), (g1, f1) = gap(low), gap(high)
        if f0 and f1 and np.sign(g0) != np.sign(g1):
            for _ in range(40):
                middle = (low + high) / 2
                low, high = (middle, high) if np.sign(gap(middle)[0]) == np.sign(g0) else (low, middle)
            t = (low + high) / 2
            g, fine = gap(t)
            good = fine and abs(g) <= 1e-4 * spacing and gap(t + 1e-4 * spacing)[0] > g
            return (t, True) if good else (0.0, False)
    return 0.0, False
