"""Answers to render requests against a plain loop."""

import math

from regolith.streaming import render_queue

LIGHTS = [(-0.3, -0.2, -1.0), (0.5, 0.0, -1.0), (0.0, 0.0, 0.0)]


def test_a_light_is_summed_up_once_for_all_its_requests(spark):
    faces = [(5, 0.0, 0.0, 1.0), (6, 0.6, 0.0, 0.8), (7, 0.0, -0.8, 0.6)]
    seen = [(1, 0, x, 0, fid) for x, fid in enumerate([5, 5, 5, 6, 6, 7])] + [(2, 0, 0, 0, 7)]
    rows = [(str(i), None if i == 4 else 1 + i % 3, *LIGHTS[i % 7 % 3]) for i in range(60)]  # camera 3 shows nothing
    r = spark.createDataFrame([(*x, None) for x in rows], render_queue.REQUEST)
    shown = render_queue.shown(spark.createDataFrame(seen, "cam long, mesh long, px long, py long, fid long"), spark.createDataFrame([(0, *f) for f in faces], "mesh long, fid long, nx double, ny double, nz double"))
    got = {x["request_id"]: (x["pixels"], x["gray"], x["error"]) for x in render_queue.answer_shown(r, shown).collect()}
    normal = {f[0]: f[1:] for f in faces}
    want = {}
    for i, cam, *v in rows:
        size = math.sqrt(sum(x * x for x in v))
        error = "no camera" if cam is None else None if size else "the light has no direction"
        own = [] if error else [normal[fid] for c, _, _, _, fid in seen if c == cam]
        gray = [math.floor((0.15 + 0.85 * min(max(sum(-x / size * n for x, n in zip(v, f, strict=True)), 0.0), 1.0)) * 255.0) for f in own]
        want[i] = (len(own), sum(gray), error)
    assert got == want
    assert {s[0] for s in want.values()} == {0, 1, 6}
