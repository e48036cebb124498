"""Heights read across tilted maplets, against plain loops."""

import numpy as np
import pytest

from regolith.operators import overlap

SIDE, STEP = 7, 0.2


def frame(normal, origin):
    n = np.array(normal, float) / np.linalg.norm(normal)
    u = np.cross([0.0, 1.0, 0.0], n)
    u /= np.linalg.norm(u)
    return np.stack([u, np.cross(n, u), n], 1), np.array(origin, float)


FRAMES = {0: frame([0, 0, 1], [0, 0, 0]), 1: frame([0.2, 0.1, 1], [0.31, 0.17, 0.05]), 2: frame([-0.1, 0.05, 1], [0.6, -0.2, 0.4])}


@pytest.fixture(scope="module")
def tables(spark):
    draw = np.random.default_rng(8)
    rows = [(k, r, c, float(draw.normal(0, 0.01)), bool(draw.random() > 0.1)) for k in FRAMES for r in range(SIDE) for c in range(SIDE)]
    m = [(k, SIDE, SIDE, *map(float, o), *map(float, b.ravel()), STEP) for k, (b, o) in FRAMES.items()]
    names = "k long, ny int, nx int, ox double, oy double, oz double, " + ", ".join(f"b{i}{j} double" for i in range(3) for j in range(3)) + ", spacing double"
    return rows, spark.createDataFrame(rows, "k long, r long, c long, h double, valid boolean"), spark.createDataFrame(m, names)


def read(rows, k, x, y):
    """The bilinear height of maplet k at (x, y), or None."""
    h = {(r, c): v for i, r, c, v, ok in rows if i == k and ok}
    u, v = x / STEP + (SIDE - 1) / 2, y / STEP + (SIDE - 1) / 2
    if not (0 <= u <= SIDE - 1 and 0 <= v <= SIDE - 1):
        return None
    i, j = int(np.floor(u)), int(np.floor(v))
    corners = [((j, i), (1 - u + i) * (1 - v + j)), ((j, i + 1), (u - i) * (1 - v + j)), ((j + 1, i), (1 - u + i) * (v - j)), ((j + 1, i + 1), (u - i) * (v - j))]
    return sum(w * h[at] for at, w in corners if w) if all(at in h for at, w in corners if w) else None


def point(k, r, c, h):
    b, o = FRAMES[k]
    return o + b @ np.array([(c - (SIDE - 1) / 2) * STEP, (r - (SIDE - 1) / 2) * STEP, h])


def test_agreement(spark, tables):
    rows, s, m = tables
    want = {}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        n = 0
        for k, other in ((a, b), (b, a)):
            basis, o = FRAMES[other]
            for i, r, c, h, ok in rows:
                if i == k and ok:
                    x, y, z = basis.T @ (point(k, r, c, h) - o)
                    below = read(rows, other, x, y)
                    n += below is not None and abs(below - z) <= 0.25 * STEP
        if n:
            want[a, b] = n
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    assert {(r["a"], r["b"]): r["n"] for r in overlap.agreeing(pairs, s, m).collect()} == want and want


def test_anchors_lie_on_the_neighbour(spark, tables):
    rows, s, m = tables
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    got = overlap.ray_anchors(pairs, s, m).collect()
    assert len(got) > 30 and {(r["k"], r["other"]) for r in got} == {(0, 1), (1, 0)}
    for r in got:
        basis, o = FRAMES[r["other"]]
        x, y, z = basis.T @ (point(r["k"], r["r"], r["c"], r["height"]) - o)
        assert read(rows, r["other"], x, y) == pytest.approx(z, abs=1e-6)
    explicit = spark.createDataFrame([(0, r["r"], r["c"], 1) for r in got if r["k"] == 0], "k long, r long, c long, other long")
    assert {r["k"] for r in overlap.ray_anchors(pairs, s, m, explicit).collect()} == {1}  # a correspondence does not count twice


def test_explicit_correspondences(spark, tables):
    rows, s, m = tables
    h = {(k, r, c): v for k, r, c, v, ok in rows if ok}
    pairs = [(0, 3, 3, 1, 2, 2, 0.5), (1, 4, 4, 2, 1, 1, 1.0)]
    got = {(r["k"], r["r"], r["c"]): r["height"] for r in overlap.explicit_anchors(spark.createDataFrame(pairs, "k long, r long, c long, other long, orow long, ocol long, weight double"), s, m).collect()}
    want = {(k, r, c): float((point(o, p, q, h[o, p, q]) - FRAMES[k][1]) @ FRAMES[k][0][:, 2]) for k, r, c, o, p, q, _ in pairs if (k, r, c) in h and (o, p, q) in h}
    assert got == pytest.approx(want) and want


def test_far_from_the_origin_samples_are_rounded_as_places_in_the_body(spark):
    names = "k long, ny int, nx int, ox double, oy double, oz double, " + ", ".join(f"b{i}{j} double" for i in range(3) for j in range(3)) + ", spacing double"
    one = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    o = {k: ((10**12 + k) * 0.4371713, (10**12 + k) * 0.0329177) for k in (0, 1)}
    m = spark.createDataFrame([(k, 9, 9, *o[k], 0.0, *one, 0.1) for k in o], names)
    s = spark.createDataFrame([(k, r, c, 0.01 * r, True) for k in o for r in range(9) for c in range(9)], "k long, r long, c long, h double, valid boolean")
    got = {(x["k"], x["r"], x["c"]): (x["x"], x["y"]) for x in overlap.across(spark.createDataFrame([(0, 1), (1, 0)], "k long, other long"), s, m).collect()}
    want = {(k, r, c): (o[k][0] + (c - 4) * 0.1 - o[1 - k][0], o[k][1] + (r - 4) * 0.1 - o[1 - k][1]) for k in o for r in range(9) for c in range(9)}
    assert got == want
