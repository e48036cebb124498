"""Sums that run over a whole ordered table, without one task that sees all of it.

The table is dealt into ranges of its order.  Each range sums up its own rows;
what the ranges before it add is a table of one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.scratch import keep

PART = "part__"


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """The table, written down in ranges of its order; PART numbers them.  Equal rows of the order share a range."""
    return keep(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def with_previous(ranged: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """Adds the value of the row before; null in the very first row."""
    v = ranged.withColumn("own__", value)
    last = v.groupBy(PART).agg(F.max_by("own__", F.struct(*order)).alias("last__"))
    before = last.select(PART, F.lag("last__").over(Window.orderBy(PART)).alias("last__"))  # a row a range
    near = F.lag(F.struct("own__")).over(Window.partitionBy(PART).orderBy(*order))
    return v.join(F.broadcast(before), PART).withColumn(name, F.when(near.isNotNull(), near["own__"]).otherwise(F.col("last__"))).drop("own__", "last__")


def with_sums(ranged: DataFrame, values: dict[str, Column], *order: str) -> DataFrame:
    """Adds for each name the sum of its values up to and with each row."""
    v = ranged.withColumns({f"{n}__": x for n, x in values.items()})
    sums = v.groupBy(PART).agg(*[F.sum(f"{n}__").alias(f"{n}_all__") for n in values])
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(PART, *[F.coalesce(F.sum(f"{n}_all__").over(earlier), F.lit(0)).alias(f"{n}_before__") for n in values])  # a row a range
    within = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = v.join(F.broadcast(before), PART).withColumns({n: F.sum(f"{n}__").over(within) + F.col(f"{n}_before__") for n in values})
    return out.drop(*[f"{n}{x}" for n in values for x in ("__", "_before__")])
