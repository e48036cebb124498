"""Tables written down to cut lineage, in the folder that all machines share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="regolith-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def keep(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
