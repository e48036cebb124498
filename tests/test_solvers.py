"""Registration, spatial joins, photometry and planning against brute force and known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import photometry, planner, register, spatial, views


def _points(spark, a, name):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], f"{name} long, x double, y double, z double")


def test_nearest_and_bounded_match_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(60, 3)), rng.normal(size=(80, 3)) * 3
    d = ((a[:, None] - b[None]) ** 2).sum(-1)
    got = {r["qid"]: r["rid"] for r in spatial.nearest(_points(spark, a, "qid"), _points(spark, b, "rid"), 0.2).collect()}
    assert got == {i: int(k) for i, k in enumerate(d.argmin(1))}
    near = {r["qid"]: r["rid"] for r in spatial.nearest_within(_points(spark, a, "qid"), _points(spark, b, "rid"), 0.7).collect()}
    assert near == {i: int(k) if d[i, k] < 0.49 else None for i, k in enumerate(d.argmin(1))}
    pairs = {(r["qid"], r["rid"]) for r in spatial.radius_pairs(_points(spark, a, "qid"), _points(spark, b, "rid"), 0.9).collect()}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(d <= 0.81), strict=True)}


def test_registration_recovers_a_transform(spark):
    rng = np.random.default_rng(1)
    src = rng.normal(size=(300, 3)) * [3, 2, 1]
    angle = 0.7
    r = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    fit = register.align(_points(spark, src, "id"), _points(spark, 1.7 * src @ r.T + [1, -2, 3], "id")).first()
    got = np.array([[fit[f"r{i}{j}"] for j in range(3)] for i in range(3)])
    assert fit["s"] == pytest.approx(1.7, rel=1e-3) and np.allclose(got, r, atol=1e-3) and np.allclose([fit["t0"], fit["t1"], fit["t2"]], [1, -2, 3], atol=1e-2)


def test_sums_give_the_same_transform(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 3))
    r = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    b = 2 * a @ r.T + [1, 2, 3]
    rows = [(*map(float, x), *map(float, y)) for x, y in zip(a, b, strict=True)]
    row = register.pair_sums(spark.createDataFrame(rows, "sx double, sy double, sz double, dx double, dy double, dz double")).first()
    s, got, t = register.similarity_from_sums(row)
    assert s == pytest.approx(2) and np.allclose(got, r) and np.allclose(t, [1, 2, 3])


def test_cube_rotations_are_24_rotations():
    g = np.array(register.cube_rotations())
    assert len(g) == 24 and np.allclose(np.linalg.det(g), 1) and len({m.tobytes() for m in g}) == 24


def test_f_score_of_itself_is_one(spark):
    p = _points(spark, np.random.default_rng(3).normal(size=(30, 3)), "id")
    assert register.f_score(p, p, 0.1).first()["f"] == 1.0


def test_rays_and_anti_join(spark):
    tri = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0)], "fid long, " + ", ".join(f"{n}{x} double" for n in "abc" for x in "xyz"))
    rays = spark.createDataFrame([(0, 0.2, 0.2, 0.0, 0.0, 0.0, 1.0, 5.0), (1, 0.9, 0.9, 0.0, 0.0, 0.0, 1.0, 5.0), (2, 0.2, 0.2, 0.0, 0.0, 0.0, 1.0, 0.5)], "rid long, ox double, oy double, oz double, dx double, dy double, dz double, far double")
    assert sorted(r["rid"] for r in spatial.clear_rays(rays, tri, 0.4, 1e-6).collect()) == [1, 2]


def test_integration_restores_a_surface():
    y, x = np.mgrid[:17, :17] * 0.1
    h = np.sin(x) * np.cos(2 * y)
    q, p = np.gradient(h, 0.1)
    zero = np.zeros_like(h)
    got = photometry.integrate_arrays(zero, p, q, np.ones_like(h), 0.1, np.full_like(h, 1e-6), zero, rounds=2000, tolerance=1e-9)
    assert np.abs((got - got.mean()) - (h - h.mean())).max() < 0.02


def test_slopes_are_recovered(spark):
    rng = np.random.default_rng(4)
    rows = []
    truth = {}
    for k in range(50):
        p, q, rho = rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3), rng.uniform(0.4, 0.8)
        truth[k] = (p, q, rho)
        for cam in range(6):
            sun, view = rng.normal(size=3) * 0.4 + [0, 0, 1], rng.normal(size=3) * 0.3 + [0, 0, 1]
            sun, view = sun / np.linalg.norm(sun), view / np.linalg.norm(view)
            n = np.array([-p, -q, 1]) / math.sqrt(1 + p * p + q * q)
            ci, ce = n @ sun, n @ view
            rows.append((k, 0, 0, cam, float(rho * (0.5 * ci + ci / (ci + ce))), True, *map(float, sun), *map(float, view), 0.0, 0.0, 0.6))
    o = spark.createDataFrame(rows, "k long, r long, c long, cam long, observed double, usable boolean, sx double, sy double, sz double, wx double, wy double, wz double, p double, q double, rho double")
    got = [r for r in photometry.fit_slopes(o, 12).collect() if r["n"] >= 3 and r["ratio"] > 1e-3 and r["rms"] < 1e-3]
    assert len(got) > 40 and all(abs(r["p"] - truth[r["k"]][0]) < 0.05 and abs(r["rho"] - truth[r["k"]][2]) < 0.05 for r in got)


def test_view_selection_drops_duplicates(spark):
    rows = [(0, 3, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (0, 2, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (0, 1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    got = views.select_views(spark.createDataFrame(rows, "k long, cam long, v0 double, v1 double, v2 double, s0 double, s1 double, s2 double"))
    assert [r["cam"] for r in got.orderBy("place").collect()] == [3, 1]


def _brute_score(w, faces, cands, camera, selected, travel):
    """Logits of all candidates and of stopping, by matrices."""
    relu = lambda x: np.maximum(x, 0)
    f, v = (relu(relu(x @ w[f"{n}1"]) @ w[f"{n}2"]) for x, n in ((faces, "face"), (cands, "view")))
    chosen = v[selected].mean(0) if selected.any() else v[0] * 0
    context = relu(np.concatenate([f.max(0), f.mean(0), v.max(0), v.mean(0), chosen, camera]) @ w["context"])
    both = np.concatenate([v, np.tile(context, (len(v), 1))], 1)
    return (both @ w["score"]).ravel() - travel, float((context @ w["stop"])[0])


def test_scores_equal_matrices_and_masks_hold(spark):
    rng = np.random.default_rng(5)
    w = planner.weights(1)
    faces, cands, travel = rng.normal(size=(9, 10)), rng.normal(size=(7, 17)), rng.uniform(size=7)
    selected, allowed = np.arange(7) == 2, np.arange(7) % 3 > 0
    g = spark.createDataFrame([("s", *map(float, x)) for x in faces], "scene string, " + ", ".join(f"g{k} double" for k in range(10)))
    rows = [("s", i, *map(float, x), bool(selected[i]), float(travel[i]), bool(allowed[i])) for i, x in enumerate(cands)]
    c = spark.createDataFrame(rows, "scene string, cand long, " + ", ".join(f"f{k} double" for k in range(17)) + ", selected boolean, travel double, allowed boolean")
    got = planner.probabilities(planner.score_candidates(c, planner.face_pool(g, w), w, 3)).orderBy("cand").collect()
    logits, stop = _brute_score(w, faces, cands, np.array([1, 1, 0.5, 0.5, 1 / 7, 3 / 7, 1, -1]), selected, travel)
    assert [r["logit"] is not None for r in got] == allowed.tolist() and got[0]["stop"] == pytest.approx(stop)
    assert [r["logit"] for r in got if r["allowed"]] == pytest.approx(logits[allowed].tolist())
    assert sum(r["probability"] for r in got) + got[0]["stop_probability"] == pytest.approx(1)


def test_body_frame_at_full_turn_equals_phase_zero(spark):
    rows = [(0, 1.0, 0.0, 2.0, 0.0, 1.0, 0.0, 1.0), (1, 1.0, 0.0, 2.0, 2 * math.pi, 1.0, 0.0, 1.0)]
    d = spark.createDataFrame(rows, "cand long, px double, py double, pz double, phase double, sx double, sy double, sz double")
    a, b = planner.body_frame(d, (2.0, -3.0, 1.0), (2.3, -3.2, 1.1)).orderBy("cand").collect()
    assert a[1:] == b[1:]
    # the camera's centre maps to 0
    m = np.array([[a[f"i{i}{j}"] for j in range(3)] for i in range(3)])
    assert np.allclose(m @ [a["px"], a["py"], a["pz"]] + [a["it0"], a["it1"], a["it2"]], 0) and np.allclose(m @ m.T, np.eye(3))


def test_invalid_candidates_are_counted(spark):
    rows = [("s", 0, 1.0, 0.0, 0.0, 7.0, 1.0, 0.0, 0.0), ("s", 1, float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), ("s", 2, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0)]
    d = spark.createDataFrame(rows, "scene string, cand long, px double, py double, pz double, phase double, sx double, sy double, sz double")
    assert planner.violations(d).first()[1:] == (1, 1, 1, 1)


def test_plan_stops_within_budget(spark):
    c = spark.createDataFrame([("s", i, float(i), 0.0, 2.0, float(i), True) for i in range(5)], "scene string, cand long, px double, py double, pz double, time double, valid boolean")
    f = c.select("scene", "cand", *[(F.col("px") * (k + 1) / 20).alias(f"f{k}") for k in range(17)])
    g = spark.createDataFrame([("s", *[0.1 * k for k in range(10)])], "scene string, " + ", ".join(f"g{k} double" for k in range(10)))
    for seed in range(2):
        rows = planner.greedy_plan(f, g, c, planner.weights(seed), 3, 2.0, 0.0).orderBy("step").collect()
        taken = [r["cand"] for r in rows if r["cand"] is not None]
        assert len(taken) <= 3 and len(set(taken)) == len(taken) and taken == sorted(taken) and rows[-1]["reason"] in ("budget", "stop", "exhausted")
