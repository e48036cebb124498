"""Pairs of overlapping maplets against a plain loop."""

import numpy as np

from regolith.operators import views


def test_overlapping_pairs_come_once_and_are_not_kept_to_be_told_apart(spark):
    draw = np.random.default_rng(3)
    p, radius, up = draw.normal(0, 0.4, (90, 3)), draw.uniform(0.1, 0.5, 90), draw.integers(0, 2, 90)
    owned = [sorted({int(f) for f in draw.integers(0, 25, draw.integers(0, 8))}) for _ in p]
    normal = np.where(up[:, None] == 1, [0.0, 0, 1], [0.8, 0, 0.6])
    m = spark.createDataFrame([(k, *map(float, x), float(r), *map(float, n)) for k, (x, r, n) in enumerate(zip(p, radius, normal, strict=True))], "k long, x double, y double, z double, radius double, nx double, ny double, nz double")
    f = spark.createDataFrame([(k, x) for k, own in enumerate(owned) for x in own * 2], "k long, fid long")  # a face may be told twice
    got = views.overlaps(m, f, 0.3, 0.9)
    want = [(a, b) for a in range(90) for b in range(a + 1, 90) if ((p[a] - p[b]) ** 2).sum() <= (radius[a] + radius[b]) ** 2 and normal[a] @ normal[b] >= 0.9 and set(owned[a]) & set(owned[b])]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert "Aggregate [a#" not in got._jdf.queryExecution().optimizedPlan().toString()
