"""Helpers for the session."""

from __future__ import annotations

import functools
import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import the package from where the driver has it; a cluster that ships it otherwise is not disturbed."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)


def reaching(query):
    """The query, run with its workers able to import the package."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        reachable(spark)
        return query(spark, sf_dir)

    return run
