"""Run reports, frames as images, and seeded subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timing_summary(times: DataFrame, *keys: str) -> DataFrame:
    """Mean, 95th percentile, sum and rate of seconds."""
    s = times.groupBy(*keys).agg(F.count("*").alias("frames"), F.avg("seconds").alias("mean"), F.percentile("seconds", 0.95).alias("p95"), F.sum("seconds").alias("total"))
    return s.withColumn("per_second", F.when(F.col("total") > 0, F.col("frames") / F.col("total")))


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def pgm(pixels: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """Frames (keys, py, px, gray; every pixel present) as plain PGM text, one row a frame, whose size is fixed by the camera."""
    line = pixels.groupBy(*keys, "py").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("px", "gray"))), lambda s: s["gray"].cast("string")), " ").alias("line"))
    body = line.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("py", "line"))), lambda s: s["line"]), "\n").alias("body"))
    return body.select(*keys, F.concat(F.lit(f"P2\n{width} {height}\n255\n"), "body", F.lit("\n")).alias("pgm"))


def write_frames(frames: DataFrame, path: str, *keys: str) -> None:
    """A folder of text files, one a frame, with the frame's keys as partition names."""
    frames.write.mode("overwrite").partitionBy(*keys).text(path)


def seeded_subset(rows: DataFrame, count: int, seed: int, id_col: str = "id") -> DataFrame:
    """`count` rows without replacement, the same for the same seed, by a hash of the id."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(count)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in the order."""
    return rows.withColumn("turn__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("turn__ = 1").drop("turn__")
