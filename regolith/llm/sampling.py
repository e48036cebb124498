"""Bounded samples of labelled rows, and fitting on them in one task of the cluster."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.llm.text import streamed

_PARTS = 1 << 20


def remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def bounded_sample(rows: DataFrame, per_class: str, key: str, most: int) -> DataFrame:
    """About `most` rows of each class, by a hash of `key`: the same rows in each run, ordered by hash__.

    Rows alike in class and key come once, whatever their number; there are never over twice `most` rows a class.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(per_class).count().collect()}  # one row a class
    part = F.lit(None).cast("long")
    for value, n in sorted(counts.items(), key=str):
        part = F.when(F.col(per_class) == F.lit(value), F.lit(min(_PARTS, -(-most * _PARTS // max(n, 1))))).otherwise(part)
    hashed = rows.withColumn("hash__", F.xxhash64(key)).filter(F.pmod("hash__", F.lit(_PARTS)) < part)
    once = hashed.groupBy(per_class, "hash__").agg(F.min(F.struct(*[c for c in rows.columns if c != per_class])).alias("row__")).select(per_class, "hash__", "row__.*")
    return once.orderBy("hash__", per_class).limit(2 * most * max(1, len(counts)))


def fit_in_a_task(sample: DataFrame, fit: Callable):
    """fit(table of the bounded sample, in order of hash__), run in one task of an executor; only the fitted model reaches the driver."""

    def run(batches):
        kept = list(streamed(batches))
        table = pa.Table.from_batches(kept) if kept else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], ["model"])

    one = sample.coalesce(1).sortWithinPartitions("hash__", *[c for c in sample.columns if c != "hash__"])
    found = one.mapInArrow(run, "model binary").collect()  # one row
    return pickle.loads(found[0][0]) if found else fit(None)
