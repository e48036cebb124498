"""A queue of render requests as a structured stream.

Requests arrive as files, each request has exactly one result, and a faulty
request becomes a result with an error, not a failed batch.  maxFilesPerTrigger
bounds what is in flight; availableNow drains what is there and ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.scratch import keep

REQUEST = "request_id string, cam long, lx double, ly double, lz double, ts timestamp"


def requests(spark: SparkSession, path: str, in_flight: int = 8) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", in_flight).json(path)


def checked(rows: DataFrame) -> DataFrame:
    """Adds error: why a request cannot be rendered, else null."""
    size = F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly") + F.col("lz") * F.col("lz"))
    bad = F.when(F.col("request_id").isNull(), "no id").when(F.col("cam").isNull(), "no camera").when(size.isNull() | F.isnan(size) | (size < 1e-12), "the light has no direction")
    return rows.withColumn("error", bad)


def shown(buffer: DataFrame, geometry: DataFrame) -> DataFrame:
    """How many pixels each camera sees of each face: cam, nx, ny, nz, n."""
    return buffer.join(geometry.select("mesh", "fid", "nx", "ny", "nz"), ["mesh", "fid"]).groupBy("cam", "mesh", "fid", "nx", "ny", "nz").agg(F.count("*").alias("n")).drop("mesh", "fid")


def answer(rows: DataFrame, buffer: DataFrame, geometry: DataFrame, ambient: float = 0.15) -> DataFrame:
    """One result a request: pixels seen, sum of gray values, error.

    buffer: the visible faces of each camera (cam, mesh, px, py, fid).  It depends on the camera alone, so it is
    computed once and serves every light.
    """
    return answer_shown(rows, shown(buffer, geometry), ambient)


def answer_shown(rows: DataFrame, faces: DataFrame, ambient: float = 0.15) -> DataFrame:
    """As answer(), from the faces that cameras show; each light of a camera is summed up once, however many requests it has."""
    size = F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly") + F.col("lz") * F.col("lz"))
    towards = [F.when(F.col("error").isNull(), -F.col(f"l{a}") / size).alias(f"t{a}") for a in "xyz"]
    light = ["cam", "tx", "ty", "tz"]
    good = checked(rows).select("request_id", "cam", "error", *towards)
    lights = good.filter(F.col("error").isNull()).select(*light).distinct()
    lambert = F.least(F.greatest(F.col("nx") * F.col("tx") + F.col("ny") * F.col("ty") + F.col("nz") * F.col("tz"), F.lit(0.0)), F.lit(1.0))
    gray = F.floor((F.lit(ambient) + F.lit(1 - ambient) * lambert) * F.lit(255.0))
    sums = lights.join(faces, "cam").groupBy(*light).agg(F.sum("n").alias("pixels"), F.sum(F.col("n") * gray).alias("gray"))
    return good.join(sums, light, "left").select("request_id", F.coalesce("pixels", F.lit(0)).alias("pixels"), F.coalesce("gray", F.lit(0)).cast("long").alias("gray"), "error")


def serve(stream: DataFrame, buffer: DataFrame, geometry: DataFrame, out: str, checkpoint: str, drain: bool = True):
    """Starts the queue: each micro-batch is answered and written under its number, so that a repeated batch replaces itself."""
    faces = keep(shown(buffer, geometry))  # not counted anew for each batch

    def each(batch: DataFrame, number: int) -> None:
        answer_shown(batch, faces).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def latest_per_key(stream: DataFrame, key: str, time: str, out: str, checkpoint: str, changed: Callable[[DataFrame], DataFrame] | None = None):
    """Keeps, for each key, the latest time seen, and hands on only rows that do not go back before it."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{out}/state"
        try:
            state = spark.read.parquet(f"{path}/v={number - 1}") if number else None
        except Exception as missing:  # the first batches may have been empty
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            state = None
        seen = state if state is not None else batch.select(key, F.col(time).alias("latest")).limit(0)
        rows = batch.join(seen, key, "left").filter(F.col("latest").isNull() | (F.col(time) >= F.col("latest"))).drop("latest")
        rows = changed(rows) if changed else rows
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        merged = seen.unionByName(rows.select(key, F.col(time).alias("latest"))).groupBy(key).agg(F.max("latest").alias("latest"))
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
