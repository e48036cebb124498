"""What became of the maplets that new images may see (the stream itself is in regolith.streaming.model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.operators import photometry


def report(links: DataFrame, observed: DataFrame) -> DataFrame:
    """Status of each maplet that an image may see: updated, or why not."""
    seen = observed.groupBy("k").agg(F.count_if("usable").alias("usable"), F.count_distinct(F.when(F.col("usable"), F.col("cam"))).alias("images"))
    linked = links.groupBy("k").agg(F.count("*").alias("links"))
    status = F.when(F.col("links").isNull(), "no_visible_initial_surface").when(F.col("images") < photometry.LEAST_IMAGES, "insufficient_observations").otherwise("updated")
    return seen.join(linked, "k", "left").select("k", "usable", "images", F.coalesce("links", F.lit(0)).alias("links"), status.alias("status"))
