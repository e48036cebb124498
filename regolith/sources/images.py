"""An image store as versioned Parquet tables.

Pixels are appended under a new version and never changed; readers see the
largest version of an image, and a reader that holds an older table keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIXELS = "image_id long, version long, row int, col int, value float, valid boolean"


class ImageStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")

    def create(self, images: DataFrame, pixels: DataFrame) -> None:
        """A new store; a job that fails leaves no committed table."""
        images.withColumn("version", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{self.path}/images")
        pixels.withColumn("version", F.lit(0).cast("long")).write.mode("overwrite").partitionBy("image_id").parquet(f"{self.path}/pixels")

    def append(self, images: DataFrame, pixels: DataFrame) -> DataFrame:
        """Adds images under the next free numbers, in the order of their own; columns that are new are null in older rows.  Returns own id and image_id."""
        top = self._read("images").agg(F.coalesce(F.max("image_id"), F.lit(-1)).alias("top")).first()["top"]
        number = images.select(F.col("image_id").alias("own"), (F.row_number().over(Window.orderBy("image_id")) + F.lit(top)).cast("long").alias("new"))
        new_images = images.join(number, images["image_id"] == number["own"]).drop("image_id", "own").withColumnRenamed("new", "image_id").withColumn("version", F.lit(0).cast("long"))
        new_pixels = pixels.join(number, pixels["image_id"] == number["own"]).drop("image_id", "own").withColumnRenamed("new", "image_id").withColumn("version", F.lit(0).cast("long"))
        new_pixels.write.mode("append").partitionBy("image_id").parquet(f"{self.path}/pixels")
        new_images.write.mode("append").parquet(f"{self.path}/images")
        return number.select("own", F.col("new").alias("image_id"))

    def replace(self, image_id: int, pixels: DataFrame) -> None:
        """A new version of one image's pixels."""
        version = self._read("pixels").filter(F.col("image_id") == image_id).agg(F.coalesce(F.max("version"), F.lit(-1)).alias("v")).first()["v"] + 1
        pixels.withColumn("image_id", F.lit(image_id).cast("long")).withColumn("version", F.lit(version).cast("long")).write.mode("append").partitionBy("image_id").parquet(f"{self.path}/pixels")

    def images(self) -> DataFrame:
        return self._read("images")

    def pixels(self, *image_ids: int) -> DataFrame:
        """The current pixels, of some images or of all; only their partitions are read."""
        p = self._read("pixels")
        p = p.filter(F.col("image_id").isin(*image_ids)) if image_ids else p
        last = p.groupBy("image_id").agg(F.max("version").alias("version"))
        return p.join(F.broadcast(last), ["image_id", "version"], "left_semi")

    def view(self, image_id: int, field: str = "value") -> DataFrame:
        return self.pixels(image_id).select("row", "col", field)
