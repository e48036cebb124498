"""Mixing sources to target weights by systematic sampling.

A source's target is its share, by weight, of `share` times all words; targets
stop at `most` times the source's size, and the excess goes to the others by
weight until none is above.  With that level `t`, a source's target is
min(most * size, t * weight): the sources that stop are those with the
smallest size for their weight, so one sorted pass over the sources finds t.

Within a source every document is expected rate = target / size times.  The
documents stand in order of their size (equal sizes: by a hash of the id, then of
the whole row), the
expected copies are summed up along that order from a random offset of the
source, and a document is emitted once per integer that its span of the sum
crosses.  So each document comes floor(rate) or ceil(rate) times, and each
stretch of sizes gives its share: taken words differ from the target by about
the largest document.

The position of a document in its source is found without putting a source
into one task: rows are range-partitioned by (source, size, hash), counted per
partition, and the counts are summed up over partitions.

A null or empty text has size 0 and counts as any other document; a source of
empty documents has target 0 and none is taken.  Null is a source of its own,
after all others.  Repeated rows are separate documents; a large group of them
fills several partitions.  Sources are few: their targets are found in one task.  An empty table gives
an empty result; further columns are not read by mix_plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.store import Scratch, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Copies of one row that a task makes at most.
PIECE = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(text: Column) -> Column:
    """A number in [0, 1) from a string, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _row_digest(docs: DataFrame) -> Column:
    """128 bits of all columns, so that rows that share it are interchangeable (two hashes of different seeds)."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in columns])
    return F.concat_ws("-", F.hex(F.xxhash64(*columns, nulls)), F.hex(F.xxhash64(F.lit("second"), nulls, *columns)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, source_size): adds target.  One row per source, so a single sorted pass."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    s = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    # The level if all sources before this one stop at their cap and no other does.
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("level", level)
    # The first source whose cap is above its level ends the filling; if there is none, all stop.
    t = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(every)["level"]
    return s.select("source", "source_size", "cap", "weight", t.alias("t")).select("source", "source_size", F.when(F.col("t").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("t") * F.col("weight"))).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies, digest (of the whole row), taken."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _row_digest(docs).alias("digest"), F.monotonically_increasing_id().alias("row_no"))
    # Written down, as the range partitioning below reads its input twice.
    rows = scratch.keep(rows.withColumn("h", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))), "sizes")
    keys = ["source", "size", "h", "digest", "row_no"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys)
    here = Window.partitionBy("part", "source").orderBy("size", "h", "digest", "row_no")
    placed = scratch.keep(ranged.withColumn("part", F.spark_partition_id()), "placed")
    counts = scratch.keep(placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum(F.col("size").cast("double")).alias("words")), "counts")
    targets = source_targets(counts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("source").alias("s"), F.col("part").alias("p"), before.alias("before"))
    facts = targets.withColumnRenamed("source", "t_source").join(offsets, F.col("t_source").eqNullSafe(F.col("s"))).drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = uniform(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit("")), F.when(F.col("source").isNull(), F.lit("/")).otherwise(F.lit(""))))
    i = (F.col("before") + F.col("here") - 1).cast("double")
    copies = (F.floor(start + rate * (i + 1.0)) - F.floor(start + rate * i)).cast("long")
    out = placed.withColumn("here", F.row_number().over(here)).join(facts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return out.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", "digest", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows, all columns as they were: a row is repeated as often as the plan copies it.

    Copies are looked up by a digest of the whole row.  Rows alike in all columns are interchangeable: one of them is
    repeated as often as the plan copies all of them, in pieces of PIECE rows that are dealt over the tasks.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, **options)
    counts = plan.groupBy(F.col("digest").alias("mix_digest__")).agg(F.sum("copies").alias("mix_copies__"), F.count("*").alias("mix_rows__")).filter("mix_copies__ > 0")
    own = docs.withColumn("mix_own__", _row_digest(docs))
    joined = own.join(counts, F.col("mix_own__") == F.col("mix_digest__"))
    alone = joined.filter(f"mix_rows__ = 1 and mix_copies__ <= {PIECE}").withColumn("mix_n__", F.col("mix_copies__").cast("int"))
    several = joined.filter(f"mix_rows__ > 1 or mix_copies__ > {PIECE}").dropDuplicates(["mix_own__"])
    pieces = several.withColumn("mix_piece__", F.explode(F.sequence(F.lit(0), F.floor((F.col("mix_copies__") - 1) / PIECE).cast("int"))))
    dealt = pieces.repartition("mix_own__", "mix_piece__").withColumn("mix_n__", F.least(F.lit(PIECE), F.col("mix_copies__") - F.col("mix_piece__") * PIECE).cast("int")).drop("mix_piece__")
    return alone.unionByName(dealt).withColumn("mix_k__", F.explode(F.sequence(F.lit(1), F.col("mix_n__")))).select(*docs.columns)


def op7_mix_sources(spark, sf_dir):
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mix_sources": op7_mix_sources}
SQL = {
    "op7_mix_sources": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('mix' || coalesce(doc_id::varchar, '-')) as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, encode(source)) as n from d group by source),
w as (select *, [3.0::double, 1.0::double, 2.0::double][((n - 1) % 3 + 1)::int] as weight, 2.0::double * source_size as cap from s),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0::double))
             / sum(weight) over (order by cap / weight, n rows between current row and unbounded following) as level from w),
t as (select arg_min(level, row(cap / weight, level)) filter (where level * weight <= cap) as t from l),
f as (select source, source_size, case when t is null then cap else least(cap, t * weight) end as target,
             ('0x' || substr(md5('mix/' || coalesce(source, '') || case when source is null then '/' else '' end), 1, 8))::bigint / 4294967296.0::double as start from l, t),
p as (select d.doc_id, d.size, f.source_size, f.target, f.start, case when f.source_size > 0 then f.target / f.source_size else 0 end as rate,
             (row_number() over (partition by d.source order by d.size, d.h, d.doc_id) - 1)::double as i
      from d join f on d.source is not distinct from f.source)
select doc_id, size, source_size, target, ((floor(start + rate * (i + 1.0::double)) - floor(start + rate * i))::bigint * size) as taken from p"""
}
