"""Rays and faces told apart by their boxes before the whole test, against all pairs."""

import numpy as np

from regolith.operators import spatial


def test_boxes_leave_out_most_pairs_and_lose_no_hit(spark):
    draw = np.random.default_rng(9)
    o, d = draw.uniform(-1, 1, (60, 3)), draw.normal(0, 1, (60, 3))
    d[:10, :2] = 0.0
    d /= np.linalg.norm(d, axis=1)[:, None]
    at = draw.uniform(-1, 1, (80, 1, 3)) + draw.normal(0, 0.2, (80, 3, 3))
    at[:20, :, 2] = 0.25  # flat ones on a side of a cell
    rays = spark.createDataFrame([(i, *map(float, a), *map(float, b), 1.5) for i, (a, b) in enumerate(zip(o, d, strict=True))], "rid long, " + ", ".join(f"{n}{a} double" for n in "od" for a in "xyz") + ", far double")
    faces = spark.createDataFrame([(i, *map(float, t.ravel())) for i, t in enumerate(at)], "fid long, " + ", ".join(f"{n}{a} double" for n in "abc" for a in "xyz"))
    want = {(r["rid"], r["fid"]) for r in spatial.struck(rays.crossJoin(faces), 1e-5, "rid", "fid").collect()}
    assert {(r["rid"], r["fid"]) for r in spatial.hits(rays, faces, 0.25, 1e-5).collect()} == want and len(want) > 10
    pairs = spatial.crossed_cells(rays, 0.25).join(spatial.faces_in_cells(faces, 0.25), ["g0", "g1", "g2"])
    assert spatial.boxes_meet(pairs).count() < 0.9 * pairs.count()
