"""Running sums over ranges against a plain loop."""

import random

from pyspark.sql import functions as F

from regolith.functions.running import in_ranges, with_previous, with_sums


def test_sums_and_previous_rows(spark):
    draw = random.Random(3)
    rows = [(i, draw.randrange(50)) for i in draw.sample(range(10_000), 500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = in_ranges(spark.createDataFrame(rows, "k long, v long"), "k")
        assert r.select("part__").distinct().count() > 1
        got = [(x["k"], x["upto"], x["former"]) for x in with_sums(with_previous(r, F.col("v"), "former", "k"), {"upto": F.col("v")}, "k").orderBy("k").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, former, want = 0, None, []
    for k, v in sorted(rows):
        total += v
        want.append((k, total, former))
        former = v
    assert got == want
    assert with_sums(in_ranges(spark.createDataFrame([], "k long, v long"), "k"), {"upto": F.col("v")}, "k").count() == 0
