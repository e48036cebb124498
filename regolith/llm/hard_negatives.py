"""Hard negatives by a full sort of each anchor's scores.

Vectors are scaled to integers once, by DataFrame functions, and scores are
their inner products: exact integers, so that ties are ties on every machine.

The rows are dealt into blocks of at most COMPONENTS numbers by a hash of the
row's number; no label, id or vector can make a block large.  Each anchor visits
every block (anchors are a stated share of the rows), so a task holds one block
as a matrix and streams anchors past it:

1. Positives: the block's rows of the anchor's label are scored and sorted by
   score and id; the first of each block are merged by a window with a limit.
2. Negatives: all rows of the block are scored and sorted by score and id.  In
   that order, restricted to other labels, the upper limit of each positive is
   found by binary search, and from there on entries are read until there are
   enough or the lower limit is passed.  Again the blocks' first are merged.

A block gives `positives` rows an anchor, or `negatives` rows a positive, at
most, and these hold all that the whole table's order can pick from the block.

Rows with a null id, label or vector, or with a component that is null or not
finite, take no part.  Vectors of different lengths have no score with each
other.  Components are held to such a size that scores fit into 62 bits.  Rows
that repeat are rows of their own; an anchor's other rows are those with another
id.  An empty table, or one without anchors, gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.store import Scratch, table
from regolith.llm.text import streamed

#: Numbers of a block, as one task holds it.
COMPONENTS = 1 << 23
#: Scores that are held at once.
SCORES = 1 << 22


class Block:
    """The rows of one block with vectors of one length, in the order of their ids."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.by_label: dict[int, np.ndarray] = {}
        self._as: dict[type, np.ndarray] = {}

    def scores(self, anchors: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Inner products with all rows or some, in the smallest type that holds every partial sum exactly."""
        most = self.largest * int(np.abs(anchors).max(initial=0)) * anchors.shape[1]
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        if kind not in self._as:
            self._as = {kind: self.vectors.astype(kind)}
        held = self._as[kind] if rows is None else self._as[kind][rows]
        return anchors.astype(kind) @ held.T

    def of_label(self, label: int) -> np.ndarray:
        if label not in self.by_label:
            self.by_label[label] = np.flatnonzero(self.labels == label)
        return self.by_label[label]

    def positives(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of anchors: (its number, ids, scores) of the block's first k other rows of its label."""
        for label in np.unique(labels).tolist():
            rows, own = self.of_label(label), np.flatnonzero(labels == label)
            step = max(1, SCORES // max(len(rows), 1))
            for some in (own[i : i + step] for i in range(0, len(own), step)):
                for a, score in zip(some.tolist(), self.scores(vectors[some], rows), strict=True):
                    order = np.argsort(-score, kind="stable")  # rows are in the order of ids
                    first = order[: k + int((self.ids[rows] == ids[a]).sum())]
                    first = first[self.ids[rows[first]] != ids[a]][:k]
                    yield a, self.ids[rows[first]], score[first].astype(np.int64)

    def negatives(self, labels: np.ndarray, vectors: np.ndarray, limits: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of anchors: (its number, its limit's number, ids, scores) of the block's first k rows of another label within (lower, upper)."""
        step = max(1, SCORES // max(len(self.ids), 1))
        for i in range(0, len(labels), step):
            for a, score in enumerate(self.scores(vectors[i : i + step]), i):
                order = np.argsort(-score, kind="stable")
                order = order[self.labels[order] != labels[a]]
                falling = -score[order].astype(np.int64)
                for p, (lower, upper) in enumerate(limits[a]):
                    at = int(np.searchsorted(falling, -upper))
                    read = order[at : at + k]
                    read = read[score[read].astype(np.int64) >= lower]
                    if len(read):
                        yield a, p, self.ids[read], score[read].astype(np.int64)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _blocks(batches) -> Iterator[tuple[dict[int, Block], pa.RecordBatch, np.ndarray]]:
    """From rows sorted by block and side (0: held, 1: anchors): (blocks by length, batch, places of anchors of one length)."""
    now, held, blocks = None, [], {}
    for batch in streamed(batches):
        block, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
        key = block.astype(np.int64) * 2 + side
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if block[i] != now:
                now, held, blocks = block[i], [], {}
            some = batch.slice(i, j - i)
            if side[i] == 0:
                held.append((some.column("vec_id").to_numpy(), some.column("label").to_numpy(), _vectors(some.column("v"))))
                continue
            if held:
                blocks, held = _matrices(held), []
            sizes = np.array(some.column("v").value_lengths().to_pylist())
            for d in np.unique(sizes).tolist():
                if d in blocks:
                    yield blocks, some, np.flatnonzero(sizes == d)


def _matrices(held: list) -> dict[int, Block]:
    ids, labels = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    vectors = [v for x in held for v in x[2]]
    sizes = np.array([len(v) for v in vectors])
    made = {}
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        made[d] = Block(ids[own], labels[own], np.stack([vectors[k] for k in own.tolist()]))
    return made


def _table(kinds: dict, parts: list) -> pa.RecordBatch:
    columns = [np.concatenate(c) if c else np.empty(0, k) for c, k in zip(zip(*parts, strict=True) if parts else [[]] * len(kinds), kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.from_numpy_dtype(k)) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _find_positives(k: int):
    kinds = {"a": np.int64, "id": np.int64, "score": np.int64}

    def run(batches):
        for blocks, some, at in _blocks(batches):
            a, ids, labels = (some.column(c).to_numpy()[at] for c in ("a", "vec_id", "label"))
            vectors = _vectors(some.column("v"))
            vectors = np.stack([vectors[i] for i in at.tolist()])
            yield _table(kinds, [(np.full(len(x), a[n]), x, s) for n, x, s in blocks[vectors.shape[1]].positives(ids, labels, vectors, k)])

    return run


def _find_negatives(k: int, lower: int, upper: int):
    kinds = {"a": np.int64, "p": np.int32, "id": np.int64, "score": np.int64}

    def run(batches):
        for blocks, some, at in _blocks(batches):
            a, labels = (some.column(c).to_numpy()[at] for c in ("a", "label"))
            vectors, scores = _vectors(some.column("v")), some.column("scores").to_pylist()
            vectors = np.stack([vectors[i] for i in at.tolist()])
            limits = [[(-(-lower * s // 100), upper * s // 100) for s in scores[i]] for i in at.tolist()]
            yield _table(kinds, [(np.full(len(x), a[n]), np.full(len(x), p, np.int32), x, s) for n, p, x, s in blocks[vectors.shape[1]].negatives(labels, vectors, limits, k)])

    return run


def _integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, held to where the inner product of two such vectors has 62 bits at most."""
    limit = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(vector), F.lit(1)))) - 1
    return F.transform(vector, lambda x: F.greatest(-limit, F.least(limit, F.floor(F.lit(float(scale)) * x.cast("double")))).cast("int"))


def _first(rows: DataFrame, group: list[str], k: int, rank: str) -> DataFrame:
    """The first k rows of each group by falling score, then id, numbered from 1; the limit also holds within tasks, before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100) -> DataFrame:
    """Of each row where `anchor` holds, and of each of its first `positives` other rows of its label, the first
    `negatives` rows of other labels with lower * positive's score <= 100 * score <= upper * positive's score.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    vector, label = F.col(vector_col), F.col("label") if label is None else label
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    packed = scratch.keep(
        rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & vector.isNotNull() & fine)
        .select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), _integers(vector, scale).alias("v"), F.size(vector).alias("d"))
        .withColumn("a", F.monotonically_increasing_id()),
        "packed",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, -(-(packed.agg(F.sum(F.col("d") + 2)).first()[0] or 0) // COMPONENTS))
    held = packed.select(F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "a", "vec_id", "label", "v")
    anchors = packed.filter("anchor").select("a", "vec_id", "label", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def visited(visitors: DataFrame) -> DataFrame:
        both = held.unionByName(visitors.select("*", every, F.lit(1).alias("side")), allowMissingColumns=True)
        return both.repartition(blocks, "block").sortWithinPartitions("block", "side")

    near = _first(visited(anchors).mapInArrow(_find_positives(positives), "a long, id long, score long"), ["a"], positives, "place")
    near = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near"))  # `positives` entries at most
    found = scratch.keep(anchors.join(near, "a"), "anchors")
    far = visited(found.select("a", "vec_id", "label", "v", F.col("near.score").alias("scores"))).mapInArrow(_find_negatives(negatives, lower, upper), "a long, p int, id long, score long")
    far = _first(far, ["a", "p"], negatives, "rank")
    own = found.select("a", F.col("vec_id").alias("anchor_id"), "near")
    positive = F.get("near", F.col("p"))
    return far.join(own, "a").select(
        "anchor_id",
        positive["id"].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
        (F.col("p") + 1).alias("positive_rank"),
    )


def op11_hard_negatives(spark, sf_dir):
    """Anchors are rows whose id is divisible by 100; every seventh label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label).drop("positive_rank")


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
SQL = {
    "op11_hard_negatives": """
with hn_r as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
hn_s as materialized (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from hn_r a join hn_r b on a.vec_id % 100 = 0 and len(a.v) = len(b.v)),
hn_p as (
  select anchor_id, id, score from hn_s where same and id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, (row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id))::int as rank,
       n.id as negative_id, p.score as positive_score, n.score as negative_score
from hn_p p join hn_s n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify rank <= 5"""
}
