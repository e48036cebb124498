"""Exact dedup with a split of heavy hitters.

Texts are equal when they are identical after every run of space characters
became one space.  One pass digests them.  A Misra-Gries summary of the
digests (Spark's frequent-items sketch) proposes digests that hold a large
share of the rows; their exact counts and winners, at most `tracked` rows, are
broadcast, and their rows are decided where they lie.  All other digests meet
by an ordinary shuffle of digests and ids, in which no group is large.

Null and empty texts are equal to each other.  A null doc_id is larger than
any other.  Of repeated rows (same id, same text) exactly one is kept.  An
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.store import Scratch, table

#: Digests that the summary tracks at most, and thus the bound of the broadcast.
TRACKED = 4096
#: A digest is treated as heavy from this many rows on.
HEAVY = 64


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"), F.monotonically_increasing_id().alias("row_no")),
        "digests",
    )
    # The order of winners: smallest id, null last, then the row's number.
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_no")
    summary = rows.agg(F.expr(f"approx_top_k(hex(digest), {tracked // 2}, {tracked})").alias("top"))
    likely = summary.select(F.explode("top").alias("top")).select("top.item", "top.count").filter(F.col("count") >= heavy).select(F.unhex("item").alias("digest"))
    winners = scratch.keep(
        rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("group_size")).filter(F.col("group_size") >= heavy),
        "winners",
    )
    bounded = F.broadcast(winners)  # at most `tracked` rows of 60 bytes
    hot = rows.join(bounded, "digest").select("doc_id", "digest", "row_no", "first", "group_size")
    by = Window.partitionBy("digest")
    cold = rows.join(bounded, "digest", "left_anti").select("doc_id", "digest", "row_no", F.min(first).over(by).alias("first"), F.count("*").over(by).alias("group_size"))
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
SQL = {
    "op1_exact_dedup": r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
from d"""
}
