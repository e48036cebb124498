"""Sampling of surfaces by area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_weight(faces: DataFrame, weight: str = "weight", key: str = "mesh") -> DataFrame:
    """Adds `upto`, the sum of weights up to and with each face in the order of fid, `before` and the mesh's `total`."""
    w = Window.partitionBy(key).orderBy("fid")
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return faces.select("*", upto.alias("upto"), (upto - F.col(weight)).alias("before"), F.sum(weight).over(Window.partitionBy(key)).alias("total"))


def cdf_lookup(targets: DataFrame, cdf: DataFrame, key: str = "mesh") -> DataFrame:
    """For targets (mesh, tid, t) the first face whose `upto` is not below t, else the last face: an as-of join by one sorted window."""
    a = targets.select(key, F.col("t").cast("double").alias("at"), F.lit(0).alias("side"), "tid", F.lit(None).cast("long").alias("fid"))
    b = cdf.select(key, F.col("upto").cast("double").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("tid"), F.col("fid").cast("long").alias("fid"))
    ahead = Window.partitionBy(key).orderBy("at", "side", "fid").rowsBetween(0, Window.unboundedFollowing)
    found = F.coalesce(F.first("fid", ignorenulls=True).over(ahead), F.max("fid").over(Window.partitionBy(key)))
    return a.unionByName(b).withColumn("fid", found).filter("tid is not null").select(key, "tid", "fid")


def stratified(faces: DataFrame, count: int, key: str = "mesh") -> DataFrame:
    """`count` points of each mesh by area, without chance: sample i stands at (i + 1/2) / count of the running weight.

    A face knows from its own span which samples are its; no join is needed.  Weights are whole numbers.  Places
    within faces follow two low-discrepancy sequences.  Adds sample, px, py, pz.
    """
    c = running_weight(faces.filter("weight > 0"), key=key)
    # (2 i + 1) * total <= 2 * count * upto, and likewise for `before` without equality
    last = F.expr(f"({2 * count} * upto - total) div (2 * total)")
    none = F.lit(2 * count) * F.col("upto") < F.col("total")
    before_last = F.when(F.lit(2 * count) * F.col("before") < F.col("total"), F.lit(-1)).otherwise(F.expr(f"({2 * count} * before - total) div (2 * total)"))
    s = c.withColumn("i0", before_last + 1).withColumn("i1", F.when(none, F.lit(-1)).otherwise(last)).filter("i1 >= i0")
    s = s.withColumn("sample", F.explode(F.sequence("i0", "i1")))
    at = F.col("sample") + F.lit(0.5)
    root, second = F.sqrt(at * F.lit(0.61803398875) % F.lit(1.0)), at * F.lit(0.41421356237) % F.lit(1.0)
    s = s.withColumn("b0", F.lit(1.0) - root).withColumn("b1", root * (F.lit(1.0) - second)).withColumn("b2", root * second)
    return s.select(key, "sample", "fid", *[(F.col(f"a{x}") * F.col("b0") + F.col(f"b{x}") * F.col("b1") + F.col(f"c{x}") * F.col("b2")).alias(f"p{x}") for x in "xyz"])


def quota_samples(points: DataFrame, count: int, key: str = "mesh") -> DataFrame:
    """`count` places of each body for its points (key, stratum, id, area, sigma), shared out over strata by area: key, slot, stratum, id, weight, masked.

    A stratum gets the whole part of its share, and those with the largest remainders one more (of equal ones the
    smallest stratum), as far as it has points; within it points come in the order of their ids' digests.  Weights are areas that the points stand for, with
    sum 1 in a body.  A point without a finite sigma is masked; places that are left over are masked and have no id.
    """
    strata = points.groupBy(key, "stratum").agg(F.sum("area").alias("area"), F.count("*").alias("has"))
    own = Window.partitionBy(key)
    s = strata.withColumn("share", F.lit(float(count)) * F.col("area") / F.sum("area").over(own)).withColumn("whole", F.floor("share"))
    rest = F.round(F.col("share") - F.col("whole"), 9)
    s = s.withColumn("turn", F.row_number().over(own.orderBy(rest.desc(), "stratum"))).withColumn("spare", F.lit(count) - F.sum("whole").over(own))
    s = s.select(key, "stratum", "has", (F.col("area") / F.sum("area").over(own)).alias("part"), (F.col("whole") + (F.col("turn") <= F.col("spare")).cast("long")).alias("quota"))
    s = s.withColumn("taken", F.least("quota", "has"))
    s = s.withColumn("start", F.sum("taken").over(own.orderBy("stratum").rowsBetween(Window.unboundedPreceding, 0)) - F.col("taken"))
    place = F.row_number().over(Window.partitionBy(key, "stratum").orderBy(F.md5(F.col("id").cast("string")), "id"))
    chosen = points.select(key, "stratum", "id", "sigma").withColumn("place", place).join(s, [key, "stratum"]).filter(F.col("place") <= F.col("taken"))
    kept = F.sum("part").over(own)  # strata without a place leave theirs to the others
    shown = s.filter("taken > 0").select(key, "stratum", (F.col("part") / kept / F.col("taken")).alias("weight"))
    fine = F.col("sigma").isNotNull() & ~F.isnan("sigma") & (F.col("sigma") < float("inf"))
    got = chosen.join(shown, [key, "stratum"]).select(key, (F.col("start") + F.col("place") - 1).alias("slot"), "stratum", "id", "weight", (~F.coalesce(fine, F.lit(False))).alias("masked"))
    slots = points.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("slot"))
    return slots.join(got, [key, "slot"], "left").select(key, "slot", "stratum", "id", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("masked", F.lit(True)).alias("masked"))


def draw(seed: int, number: int, *keys: str) -> Column:
    """A number in [0, 1) that only the seed, its own number and the keys' values decide."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.lit(str(number)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def random_samples(faces: DataFrame, count: int, seed: int, key: str = "mesh") -> DataFrame:
    """`count` points of each mesh by area, by chance: uniform places on the running weight and uniform points of triangles."""
    targets = faces.groupBy(key).agg(F.sum("weight").alias("total")).select(key, "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("tid"))
    drawn = targets.select(key, "tid", (draw(seed, 0, key, "tid") * F.col("total").cast("double")).alias("t"), draw(seed, 1, key, "tid").alias("u"), draw(seed, 2, key, "tid").alias("v"))
    found = cdf_lookup(drawn, running_weight(faces.filter("weight > 0"), key=key), key).join(drawn.select(key, "tid", "u", "v"), [key, "tid"])
    over = F.col("u") + F.col("v") > 1
    u, v = F.when(over, 1 - F.col("u")).otherwise(F.col("u")), F.when(over, 1 - F.col("v")).otherwise(F.col("v"))
    j = found.join(faces.select(key, "fid", *[f"{n}{x}" for n in "abc" for x in "xyz"]), [key, "fid"])
    return j.select(key, F.col("tid").alias("sample"), "fid", *[(F.col(f"a{x}") + u * (F.col(f"b{x}") - F.col(f"a{x}")) + v * (F.col(f"c{x}") - F.col(f"a{x}"))).alias(f"p{x}") for x in "xyz"])
