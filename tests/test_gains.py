"""Gains of sequences against dense matrices, and quotas of samples."""

import numpy as np
import pytest

from regolith.operators import information, sampling


@pytest.fixture(scope="module")
def world(spark):
    draw = np.random.default_rng(6)
    cov, rows = {}, {}
    for s in range(3):
        a = draw.normal(size=(5, 5))
        cov[s] = a @ a.T + 0.2 * np.eye(5)
        for view in range(6):
            rows[s, view] = [(draw.normal(size=5) * (draw.random(5) < 0.7), 0.1 + draw.random()) for _ in range(draw.integers(1, 4))]
    c = spark.createDataFrame([(s, i, j, float(v[i, j])) for s, v in cov.items() for i in range(5) for j in range(5)], "scene long, i int, j int, v double")
    r = spark.createDataFrame([(s, view, t, i, float(b[i]), float(n)) for (s, view), x in rows.items() for t, (b, n) in enumerate(x) for i in range(5)], "scene long, seq long, turn int, i int, b double, variance double")
    w = spark.createDataFrame([(s, i, (i + 1) / 6) for s in cov for i in range(3)], "scene long, i int, weight double")  # further entries are nuisances
    return cov, rows, c, r, w


def gain(cov, rows):
    b, n = np.array([x for x, _ in rows]), np.diag([x for _, x in rows])
    after = cov - cov @ b.T @ np.linalg.inv(n + b @ cov @ b.T) @ b @ cov
    return float((np.array([1, 2, 3]) / 6) @ np.diag(cov - after)[:3])


def test_gain_of_a_sequence(world):
    cov, rows, c, r, w = world
    got = {(x["scene"], x["seq"]): x["gain"] for x in information.sequence_gains(c, r, w).collect()}
    assert got == pytest.approx({k: gain(cov[k[0]], x) for k, x in rows.items()})


def test_greedy_choice_counts_what_is_shared_once(world):
    cov, rows, c, r, w = world
    got = {(x["scene"], x["place"]): (x["view"], x["gain"]) for x in information.greedy_sequence(c, r, w, 3).collect()}
    for s in cov:
        taken, before = [], 0.0
        for place in range(3):
            all_of = {v: gain(cov[s], [y for u in [*taken, v] for y in rows[s, u]]) for v in range(6) if v not in taken}
            best = max(all_of, key=all_of.get)
            assert got[s, place][0] == best and got[s, place][1] == pytest.approx(all_of[best] - before)
            taken.append(best)
            before = all_of[best]


def test_no_measurement_no_gain(world):
    _, _, c, r, w = world
    assert information.sequence_gains(c, r.limit(0), w).count() == 0


def test_quotas_masks_and_padding(spark):
    rows = [(0, s, 10 * s + i, a, None if i == 1 else 0.5) for s, (n, a) in enumerate([(6, 1.0), (2, 5.0), (1, 0.01)]) for i in range(n)]
    got = sampling.quota_samples(spark.createDataFrame(rows, "mesh long, stratum long, id long, area double, sigma double"), 8).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(8)) and sum(r["weight"] for r in got) == pytest.approx(1.0)
    assert [sum(r["stratum"] == s for r in got) for s in (0, 1, 2)] == [3, 2, 0]  # shares 2.997, 4.995 and 0.005; two points are all of the second
    assert all(r["masked"] == (r["id"] is None or r["id"] % 10 == 1) for r in got) and sum(r["id"] is None for r in got) == 3
