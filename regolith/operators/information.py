"""Information of observations about heights (an extension: covariances of the joint model, expected gains of new views)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.scratch import keep


def information(rows: DataFrame, *keys: str) -> DataFrame:
    """J^T S^-1 J of each group as entries (i, j, f) from sparse Jacobian rows (obs, i, value, sigma)."""
    left = rows.select(*keys, "obs", "i", "value", "sigma")
    right = rows.select(*keys, "obs", F.col("i").alias("j"), F.col("value").alias("other"))
    return left.join(right, [*keys, "obs"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("value") * F.col("other") / (F.col("sigma") * F.col("sigma"))).alias("f"))


def effective_information(rows: DataFrame, *keys: str, prior: float = 0.0) -> DataFrame:
    """Information about a height when one nuisance of the new image is eliminated: sum bb/n - (sum bh/n)^2 / (sum hh/n + prior)."""
    n = F.col("variance")
    s = rows.groupBy(*keys).agg(F.sum(F.col("b") * F.col("b") / n).alias("bb"), F.sum(F.col("b") * F.col("h") / n).alias("bh"), F.sum(F.col("h") * F.col("h") / n).alias("hh"))
    d = F.col("hh") + F.lit(float(prior))
    return s.withColumn("information", F.col("bb") - F.when(d > 0, F.col("bh") * F.col("bh") / d).otherwise(0.0))


def height_covariance(entries: DataFrame, heights: int, prior: float) -> DataFrame:
    """Standard deviation of each height of a maplet: rows (k, i, j, f); numbers below `heights` are heights, the others are eliminated (Schur complement)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size = int(max(rows["i"].max(), rows["j"].max(), heights - 1)) + 1
        f = np.zeros((size, size))
        f[rows["i"], rows["j"]] = rows["f"]
        f += prior * np.eye(size)
        keep = f[:heights, :heights]
        if size > heights:
            keep = keep - f[:heights, heights:] @ np.linalg.solve(f[heights:, heights:], f[heights:, :heights])
        return pd.DataFrame({"k": rows["k"].iloc[0], "i": range(heights), "sigma": np.sqrt(np.diag(np.linalg.inv(keep)))})

    return entries.groupBy("k").applyInPandas(run, "k long, i long, sigma double")


def view_gain(state: np.ndarray, views: list[np.ndarray], weights: np.ndarray) -> list[float]:
    """Weighted drop of the heights' variances for each view's information, given the state's; gains of a set come from the sum of its informations."""
    before = np.diag(np.linalg.inv(state))[: len(weights)]
    return [float(weights @ (before - np.diag(np.linalg.inv(state + v))[: len(weights)])) for v in views]


def factors(covariance: DataFrame, rows: DataFrame, given: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The low-rank updates that measurements make to many covariances: scene, seq, turn, i, w; the new covariance is the old less the sum of all w w^T.

    covariance: entries (scene, i, j, v) of each scene, both halves; rows: the measurements of a sequence in the order of turn
    (scene, seq, turn, i, b, variance), entries that are 0 may be absent; given: factors (scene, i, q, w) that hold already.
    Each turn takes what the turns before left of its direction, so no matrix is inverted and all scenes and sequences go together.
    """
    b = keep(rows.filter(F.col("b") != 0))
    keys = ["scene", "seq", "turn"]
    u = b.withColumnRenamed("i", "j").join(covariance, ["scene", "j"]).groupBy(*keys, "i").agg(F.sum(F.col("v") * F.col("b")).alias("u"))
    if given is not None:
        along = b.join(given, ["scene", "i"]).groupBy(*keys, "q").agg(F.sum(F.col("w") * F.col("b")).alias("s"))
        less = along.join(given, ["scene", "q"]).groupBy(*keys, "i").agg(F.sum(-F.col("s") * F.col("w")).alias("u"))
        u = u.unionByName(less).groupBy(*keys, "i").agg(F.sum("u").alias("u"))
    u = keep(u)
    last = most if most is not None else (b.agg(F.max("turn")).first()[0] if b.limit(1).count() else -1) + 1
    done = []
    for turn in range(last):
        own, now = b.filter(F.col("turn") == turn), u.filter(F.col("turn") == turn)
        size = own.join(now, [*keys, "i"]).groupBy("scene", "seq").agg((F.first("variance") + F.sum(F.col("b") * F.col("u"))).alias("size"))
        w = keep(now.join(size, ["scene", "seq"]).select("scene", "seq", F.lit(turn).alias("turn"), "i", (F.col("u") / F.sqrt("size")).alias("w")))
        done.append(w)
        if turn + 1 < last:
            f = w.select("scene", "seq", "i", "w")
            along = b.filter(F.col("turn") > turn).join(f, ["scene", "seq", "i"]).groupBy(*keys).agg(F.sum(F.col("w") * F.col("b")).alias("s"))
            less = along.join(f, ["scene", "seq"]).select(*keys, "i", (-F.col("s") * F.col("w")).alias("u"))
            u = keep(u.filter(F.col("turn") > turn).unionByName(less).groupBy(*keys, "i").agg(F.sum("u").alias("u")))
    return reduce(DataFrame.unionByName, done) if done else u.select("scene", "seq", "turn", "i", F.col("u").alias("w")).limit(0)


def sequence_gains(covariance: DataFrame, rows: DataFrame, weights: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Weighted drop (weights: scene, i, weight) of the heights' variances by each whole sequence: scene, seq, gain.  What measurements of a sequence have in common counts once."""
    f = factors(covariance, rows, given).join(weights, ["scene", "i"])
    return f.groupBy("scene", "seq").agg(F.sum(F.col("weight") * F.col("w") * F.col("w")).alias("gain"))


def greedy_sequence(covariance: DataFrame, rows: DataFrame, weights: DataFrame, length: int) -> DataFrame:
    """Of each scene the views (seq) that one by one add most to what those before them tell: scene, place, view, gain."""
    left, given, chosen = rows, None, []
    for place in range(length):
        f = keep(factors(covariance, left, given))
        gain = f.join(weights, ["scene", "i"]).groupBy("scene", "seq").agg(F.sum(F.col("weight") * F.col("w") * F.col("w")).alias("gain"))
        best = keep(best_view(gain.withColumnRenamed("seq", "view")))
        chosen.append(best.select("scene", F.lit(place).alias("place"), "view", "gain"))
        pick = best.select("scene", F.col("view").alias("seq"))
        new = f.join(pick, ["scene", "seq"]).select("scene", "i", (F.col("turn") + F.lit(1000 * place)).alias("q"), "w")
        given = keep(new if given is None else given.unionByName(new))
        left = left.join(pick, ["scene", "seq"], "left_anti")
    return reduce(DataFrame.unionByName, chosen)


def best_view(gains: DataFrame) -> DataFrame:
    """Of each scene the view with the largest gain (smallest id on a tie)."""
    return gains.groupBy("scene").agg(F.max_by(F.struct("view", "gain"), F.struct("gain", -F.col("view"))).alias("b")).select("scene", "b.view", "b.gain")


def first_accepted(proposals: DataFrame) -> DataFrame:
    """Of each scene the first proposal (by slot) that verification accepts."""
    return proposals.filter("accepted").groupBy("scene").agg(F.min("slot").alias("slot"))


def farthest_points(points: DataFrame, count: int) -> DataFrame:
    """Of each group farthest-point samples, the smallest id first: group, place, id.  A group is a bounded sample in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        p = rows[["x", "y", "z"]].to_numpy(float)
        chosen, far = [0], ((p - p[0]) ** 2).sum(1)
        while len(chosen) < min(count, len(p)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((p - p[chosen[-1]]) ** 2).sum(1))
        return pd.DataFrame({"group": rows["group"].iloc[0], "place": range(len(chosen)), "id": rows["id"].to_numpy()[chosen]})

    return points.groupBy("group").applyInPandas(run, "group long, place long, id long")


def save_weights(spark, weights: dict[str, np.ndarray], path: str) -> None:
    """Weights of a scorer as a table with a version."""
    rows = [(name, list(map(int, w.shape)), [float(x) for x in w.ravel()]) for name, w in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, value array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark, path: str, version: int = 3) -> dict[str, np.ndarray]:
    got = {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
    if int(got["version"].ravel()[0]) != version:
        raise ValueError(f"weights of version {got['version'].ravel()[0]:g}, {version} is needed")
    return got
