"""Searches for nearest places in dense, clustered and repeated clouds, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from regolith.operators import spatial


def _frame(spark, p, name):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], f"{name} long, x double, y double, z double")


def _clouds():
    draw = np.random.default_rng(4)
    dense = draw.normal(0, 0.01, (400, 3))
    refs = np.concatenate([draw.normal(0, 1, (300, 3)), dense, dense[:50], draw.normal(0, 1e-5, (200, 3)) + 2])  # of copies the first counts
    queries = np.concatenate([draw.normal(0, 1, (80, 3)), draw.normal(0, 0.01, (80, 3)), refs[650:690], [[40.0, -3, 2], [2, 2, 2], [-1e6, 0, 0]]])
    return queries, refs


def test_every_query_finds_its_nearest_reference(spark):
    q, r = _clouds()
    x, y, z = (q[:, None] - r[None]).transpose(2, 0, 1)
    d = x * x + y * y + z * z
    want = {i: (int(k), d[i, k]) for i, k in enumerate(d.argmin(1))}
    for size in (0.5, 1e-3, None):
        assert {n["qid"]: (n["rid"], n["d2"]) for n in spatial.nearest(_frame(spark, q, "qid"), _frame(spark, r, "rid"), size).collect()} == want
    index = spatial.placed(_frame(spark, r, "rid"))
    for bound in (1e-4, 0.05, 3.0):
        got = {n["qid"]: n["rid"] for n in spatial.nearest_within(_frame(spark, q, "qid"), index, bound).collect()}
        assert got == {i: k if far < bound * bound else None for i, (k, far) in want.items()}


def test_no_query_meets_a_whole_dense_cloud(spark):
    """All of a cloud lies in touching cells of the size given; a query still meets few of it."""
    p = np.random.default_rng(6).normal(0, 0.1, (4000, 3))
    index = spatial.placed(_frame(spark, np.concatenate([p, p]), "rid"), 0.5)
    assert index.places.count() == 4000
    assert index.around.agg(F.max(F.size("near"))).first()[0] < 700
