"""Hard negatives against a plain loop, over small blocks, awkward rows and ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from regolith.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, a string, block string, score string"


def plain(rows, anchor, positives=5, negatives=5, lower=80, upper=100):
    fine = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in fine:
        if not anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, w, d in fine if len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == c and x[1] != i)[:positives]:
            fit = sorted(x for x in scored if x[2] != c and lower * -s <= -x[0] * 100 <= upper * -s)[:negatives]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).drop("positive_rank").collect())


@pytest.mark.parametrize("components", [1 << 23, 40])
def test_against_a_loop(spark, monkeypatch, components):
    monkeypatch.setattr(hn, "COMPONENTS", components)  # blocks of very few rows
    draw = random.Random(components)
    rows = [(i, [draw.choice([0.0, 0.25, 0.5, -0.3]) for _ in range(6)], draw.randrange(3)) for i in range(300)]
    rows += [(None, [0.5] * 6, 1), (901, None, 1), (902, [0.5] * 6, None), (903, [0.5, None, 0.0, 0.0, 0.0, 0.0], 1), (904, [math.nan] * 6, 0), (905, [math.inf] + [0.0] * 5, 0)]
    rows += [(910, [0.5, 0.5], 0), (911, [0.5, 0.5], 0), (912, [0.5, 0.25], 1), (920, [], 0), (921, [], 0), (922, [], 1), rows[7], rows[7], rows[20]]
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and run(spark, rows) == want


def test_limits_are_parameters(spark):
    draw = random.Random(5)
    rows = [(i, [draw.random() for _ in range(4)], draw.randrange(2)) for i in range(120)]
    assert run(spark, rows, positives=2, negatives=3, lower=50, upper=95) == plain(rows, lambda i: i % 10 == 0, 2, 3, 50, 95)


def test_large_scores_stay_exact(spark):
    rows = [(0, [3e6, 1.0, 2.0], 0), (1, [3e6, 1.0, 2.0], 0), (2, [3e6, 1.0, 1.0], 1), (3, [3e6, 0.0, 3.0], 1), (4, [-3e6, 0.0, 0.0], 0), (5, [3e38, 3e38, -3e38], 0), (6, [3e38, 0.0, 0.0], 1)]
    got = run(spark, rows)
    assert [r for r in got if r[1] != 5 and r[3] != 6] == [r for r in plain(rows[:5], lambda i: i % 10 == 0)]
    assert all(abs(r[4]) < 1 << 62 for r in got)


def test_no_rows_and_no_anchors(spark):
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
