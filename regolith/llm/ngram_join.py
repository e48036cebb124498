"""Exact Jaccard self-join of documents on sets of word 5-grams, by prefix filters under several token orders.

A document's set holds the hashes of its distinct 5-grams.  Two sets that reach
the threshold t share one of the first n - ceil(t * n) + 1 tokens of either,
under any order of all tokens; of the smaller set even the first
n - ceil(2t / (1 + t) * n) + 1 tokens suffice.  The orders used here put common
tokens last: first comes the power of two of the count of a token's rarest
word, then a hash that differs from order to order.  So the tokens of common
passages hardly ever stand in a prefix.

1. One pass gives each document its set's size and digest, and each task the
   word counts of its texts, in a table of SLOTS counters.  The tables are
   summed up; their logarithms are broadcast (SLOTS bytes).  Each distinct set
   (by a 128-bit digest) is one node, however many documents have it.
2. A second pass gives each node's prefix under the first order.  A token's
   nodes are a group; groups of frequent tokens (by Spark's frequent-items
   sketch, one for each so many rows) are split by a hash of the node.  Members that no
   other member can match by size are dropped.  In what is left each node points
   to the smallest one of its part, and those of the parts to the group's; a
   node's most frequent target is its first candidate.
3. Candidates are compared in blocks, which hold each node's set once.  A pair
   of a block must share prefix tokens under all three orders; only then the
   whole sets are intersected.
4. The links give components.  Groups that still hold several components are
   put into blocks by their smallest component: its members on one side, all
   others, in portions of bounded size, on the other.

Every pair of a link shares a prefix token, and such a pair is either compared
in a block or already known to be connected, so no link between components is
lost.  Links are pairs of components, and each task hands on stars of them.  No pair is ever a row: a block gives links until its members are
connected, so at most one a member, and large blocks are dealt over several
tasks.  Tokens are 59-bit hashes, and each carries another 16 bits of its
words' hashes (32 in a set's digest), which have to agree as well before a
token counts as common.
Joins on a component's or a hub's key are left to Spark's skew-join handling.

A null or empty text has an empty set and no links.  A null doc_id takes part
as any other, and component_id is the smallest id that is not null (null if
there is none).  Rows that share an id are texts of their own.  Repeated rows
are equal sets.  An empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.graph import components, stars
from regolith.llm.store import Scratch, table
from regolith.llm.text import NOT_SPACE, Words, mix, ragged, streamed, text_slices

SHINGLE = 5
#: The threshold in hundredths: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
#: Counters of the table of word counts, and how many of them are one row of it.
SLOTS, CHUNK = 1 << 22, 1 << 12
#: Tokens that the sketch of frequent tokens tracks, and members of a part of a frequent token's group.
TRACKED, PART = 4096, 512
#: Rows that a token's group has at most, about, without being split.
WHOLE = 1 << 16
#: Bits of the filter that keeps sets at home, at most; where it would be too full, there is none.
FILTER_BITS = 1 << 26
#: Tokens of the portion of a block that is held in memory.
PORTION = 1 << 20
#: Members of a block that one task compares with a portion.
SLICE = 2048
_U = np.uint64
_LOW = _U((1 << 59) - 1)
_ORDERS = tuple(_U(x) for x in (0x13198A2E03707344, 0xA4093822299F31D0))
_STEP = [_U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(SHINGLE)]


def prefix_size(n: int) -> int:
    """Tokens of a set of n of which one at least is shared, under any order, by any set that reaches the threshold."""
    return n - -(-n * THRESHOLD // 100) + 1


def short_prefix_size(n: int) -> int:
    """The same, where the other set is no smaller."""
    return n - -(-2 * n * THRESHOLD // (100 + THRESHOLD)) + 1


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(40)).astype(np.int64) % SLOTS


def _set_of(tokens: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    new = np.empty(len(tokens), bool)
    new[:1] = True
    np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
    return tokens[new], checks[order[new]]


def shingle_sets(w: Words, levels: np.ndarray | None = None, shingle: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct tokens of each text, and their checks; with levels (of word slots) in the first order: the level in the upper five bits."""
    h, n = w.hashes, len(w.hashes)
    grams, others = np.zeros(max(n - shingle + 1, 0), _U), np.zeros(max(n - shingle + 1, 0), _U)
    for k in range(shingle):
        grams += h[k : k + len(grams)] * _STEP[k]
        others += w.checks[k : k + len(grams)] * _STEP[k]
    grams = mix(grams) & _LOW
    others = (mix(others) >> _U(32)).astype(np.uint32)
    own = None
    if levels is not None:
        own = levels[slots(h)].astype(_U)
        least = own[: len(grams)].copy()
        for k in range(1, shingle):
            np.minimum(least, own[k : k + len(grams)], out=least)
        grams |= least << _U(59)
    out = []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(_set_of(grams[a : b - shingle + 1], others[a : b - shingle + 1]))
        elif b > a:
            step, size = np.array(_STEP[: b - a], _U), np.array([b - a], _U)
            short = mix((h[a:b] * step).sum(dtype=_U, keepdims=True) + size) & _LOW
            check = (mix((w.checks[a:b] * step).sum(dtype=_U, keepdims=True) + size) >> _U(32)).astype(np.uint32)
            out.append((short if own is None else short | (own[a:b].min() << _U(59)), check))
        else:
            out.append((np.empty(0, _U), np.empty(0, np.uint32)))
    return out


def other_prefixes(tokens: np.ndarray) -> list[np.ndarray]:
    """Prefixes of a set, given in the first order, under the other orders."""
    p = prefix_size(len(tokens))
    if p >= len(tokens):
        return [tokens] * len(_ORDERS)
    level = tokens & ~_LOW
    return [tokens[np.argpartition(level | (mix(tokens ^ c) & _LOW), p - 1)[:p]] for c in _ORDERS]


def _digest(tokens: np.ndarray, checks: np.ndarray) -> bytes:
    low = tokens & _LOW
    order = np.argsort(low)
    return hashlib.blake2b(low[order].tobytes() + checks[order].tobytes(), digest_size=16).digest()


def _profile(batches):
    counts = np.zeros(SLOTS, np.uint32)
    kinds = [("doc_id", pa.int64()), ("mark", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())]
    for batch, i, j, w in text_slices(batches, "text", NOT_SPACE):
        sets = shingle_sets(w)
        words, many = np.unique(w.hashes, return_counts=True)
        np.add.at(counts, slots(words), many.astype(np.uint32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("mark").slice(i, j - i), pa.array([_digest(*s) for s in sets], pa.binary()), pa.array([len(s) for s, _ in sets], pa.int64()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], [k for k, _ in kinds])
    rows = [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(counts.reshape(-1, CHUNK)) if part.any()]
    yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), t) for _, t in kinds[:4]] + [pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], [k for k, _ in kinds])


def _summed(batches):
    """Sums of the counters, chunk by chunk; a task holds one table at most, however many rows there are."""
    total: dict[int, np.ndarray] = {}
    for batch in streamed(batches):
        for k, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(data), np.uint32)
            total[k] = total[k] + part if k in total else part.astype(np.uint64)
    levels = [np.minimum(np.log2(np.maximum(t, 1)), 31).astype(np.uint8).tobytes() for t in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["chunk", "levels"])


def _prefixes(levels):
    """Of each set that is not empty its prefix under the first order."""

    def run(batches):
        for batch, _, _, w in text_slices(batches, "text", NOT_SPACE):
            sets = [s for s in shingle_sets(w, levels.value) if len(s[0])]
            parts = [t[: prefix_size(len(t))] for t, _ in sets]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            values = np.concatenate(parts) if parts else np.empty(0, _U)
            yield pa.RecordBatch.from_arrays([pa.array([_digest(*s) for s in sets], pa.binary()), pa.array([short_prefix_size(len(t)) for t, _ in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))], ["key", "short", "tokens"])

    return run


def _whole_sets(levels, wanted, shingle: int = SHINGLE):
    """The sets that may be wanted, in the first order: tokens, then their checks."""

    def run(batches):
        bits = wanted.value if wanted else None
        for batch, _, _, w in text_slices(batches, "text", NOT_SPACE):
            keys, data = [], []
            for tokens, checks in shingle_sets(w, levels and levels.value, shingle):
                if len(tokens):
                    key = _digest(tokens, checks)
                    if bits is None or _may_hold(bits, key):
                        keys.append(key)
                        data.append(tokens.tobytes() + checks.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["key", "tokens"])

    return run


def _may_hold(bits: np.ndarray, key: bytes) -> bool:
    slot = int.from_bytes(key[:4], "big") % (32 * len(bits))
    return bool(int(bits[slot >> 5]) >> (slot & 31) & 1)


def rows_wanted(wanted):
    """Of rows with a key those that may be wanted."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            slot = np.frombuffer(b"".join(k[:4] for k in batch.column("key").to_pylist()), ">u4").astype(np.int64) % (32 * len(bits))
            yield batch.filter(pa.array(bits[slot >> 5] >> (slot & 31).astype(np.uint32) & 1 == 1))

    return run


class _Index:
    """Which sets of a portion hold a token, and with which check."""

    def __init__(self, sets: list[np.ndarray], checks: list[np.ndarray] | None = None):
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner, self.n = tokens[order], owner[order], len(sets)
        self.checks = np.concatenate(checks)[order] if checks is not None else None

    def counts(self, tokens: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """How many of the tokens each set holds."""
        a, b = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        at = ragged(a, b - a)
        if checks is not None:
            at = at[self.checks[at] == np.repeat(checks, b - a)]
        return np.bincount(self.owner[at], minlength=self.n)


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Tokens of both sets whose checks agree."""
    spot = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    return int(((a[0][spot] == b[0]) & (a[1][spot] == b[1])).sum())


class Portion:
    """The held side of a block; match() finds links of one more set, one to each component that is not yet known to be its own."""

    threshold = THRESHOLD

    def __init__(self, nodes: list[int], roots: list[int], sets: list[tuple]):
        self.nodes, self.roots, self.sets = np.array(nodes), np.array(roots), sets
        self.group = self.roots.copy()  # components, as links join them
        self.joined: dict[int, int] = {}
        self.sizes = np.array([len(s[0]) for s in sets])
        self.whole = _Index([s[0] for s in sets], [s[1] for s in sets]) if len(sets) > 8 else None
        self.prepare()

    def prepare(self) -> None:
        prefixes = [[s[0][: prefix_size(len(s[0]))], *other_prefixes(s[0])] for s in self.sets]
        self.filters = [_Index([p[k] for p in prefixes]) for k in range(1 + len(_ORDERS))]

    def may_link(self, fits: np.ndarray, own: tuple) -> np.ndarray:
        """Of the held sets that fit by size, those that share a prefix token under every order."""
        for index, prefix in zip(self.filters, [own[0][: prefix_size(len(own[0]))], *other_prefixes(own[0])], strict=True):
            if not fits.any():
                break
            fits &= index.counts(prefix) > 0
        return fits

    def match(self, node: int, root: int, own: tuple) -> np.ndarray:
        n = len(own[0])
        while root in self.joined:
            root = self.joined[root]
        fits = (self.group != root) & (100 * np.minimum(self.sizes, n) >= self.threshold * np.maximum(self.sizes, n))
        left = np.flatnonzero(self.may_link(fits, own))
        if self.whole is not None and len(left) > 8:
            shared = self.whole.counts(*own[:2])[left]
        else:
            shared = np.array([common(self.sets[k], own) for k in left], np.int64)
        linked = left[100 * shared >= self.threshold * (self.sizes[left] + n - shared)]
        others, at = np.unique(self.group[linked], return_index=True)
        if len(others):
            self.group[np.isin(self.group, others)] = root
            self.joined.update(dict.fromkeys(others.tolist(), root))
        return self.nodes[linked[at]]


def _compare(kind: type[Portion]):
    """Links of sorted block rows, as pairs of the roots: of each block and portion first the held sets, then those to be compared with them."""

    def run(batches):
        now, held, portion = None, ([], []), None
        for batch in streamed(batches):
            a, b = [], []
            for block, part, side, root, data, more in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "side", "root", "tokens", "more")), strict=True):
                if (block, part) != now:
                    now, held, portion = (block, part), ([], []), None
                n = len(data) // 10
                own = (np.frombuffer(data, _U, n), np.frombuffer(data, np.uint16, n, 8 * n), more)
                if side == 0:
                    for x, y in zip(held, (root, (own[0].copy(), own[1].copy(), more)), strict=True):
                        x.append(y)
                    continue
                if not held[0]:
                    continue
                portion = portion or kind(held[0], *held)
                found = portion.match(root, root, own)
                a += found.tolist()
                b += [root] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(np.array(a, np.int64), np.array(b, np.int64))], ["a", "b"])

    return run


def _marked(text):
    """A digest of the whole text, which tells rows of one id apart."""
    return F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(text)))


def _fits(small, large, threshold: int):
    """Whether the sizes of two members allow a link; a member's m is 2 * size, plus 1 for a token beyond its short prefix."""
    return F.lit(100) * F.floor(small / 2) >= F.lit(threshold) * F.floor(large / 2)


def _matched(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows (token, part, node, m) without those of whole groups that no other member can match by size."""
    by_size = Window.partitionBy("token", "part").orderBy("m", "node")
    below = F.max(F.when(F.col("m") % 2 == 0, F.col("m"))).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    near = rows.withColumn("below", below).withColumn("above", F.lead("m").over(by_size))
    fine = _fits(F.col("below"), F.col("m"), threshold) | ((F.col("m") % 2 == 0) & _fits(F.col("m"), F.col("above"), threshold))
    return near.filter((F.col("part") >= 0) | fine).drop("below", "above")


class Join:
    """Links and components of sets; what finds candidates and what tells them apart is in the methods that near copies by sketches override."""

    shingle, threshold, portion = SHINGLE, THRESHOLD, Portion
    #: Numbers that a set has besides its tokens where it is held.
    besides = 0
    levels = None

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _filter(self, ends: DataFrame):
        """Bits of the keys of some nodes, which may be repeated, broadcast; None where they are too many for it."""
        n = ends.agg(F.approx_count_distinct("key")).first()[0]
        if 4 * n > FILTER_BITS:
            return None
        size = 1 << max(16, min(FILTER_BITS.bit_length() - 1, (16 * n).bit_length()))
        slot = F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(size))
        masks = ends.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 32).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("mask")).toArrow()  # size / 32 short rows at most
        bits = np.zeros(size // 32, np.uint32)
        bits[masks.column("word").to_numpy()] = masks.column("mask").to_numpy().astype(np.uint32)
        return self.spark.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes at most

    def links(self, members: DataFrame, name: str) -> DataFrame:
        """Links between the roots, of blocks given by rows block, part, side (0: held, 1: to compare), node, root."""
        keyed = self.scratch.keep(members.join(self.nodes.select("node", "key"), "node"), f"{name}-keyed")
        wanted = self._filter(keyed.select("key"))
        sets = self.docs.mapInArrow(_whole_sets(self.levels, wanted, self.shingle), "key binary, tokens binary").dropDuplicates(["key"])
        full = self.with_more(sets, wanted).join(keyed, "key").select("block", "part", "side", "root", "tokens", "more")
        ordered = full.repartition(self.parts, "block", "part").sortWithinPartitions("block", "part", "side")
        found = self.scratch.keep(ordered.mapInArrow(_compare(self.portion), "a long, b long"), f"{name}-links")
        if wanted:
            wanted.destroy()
        self.scratch.drop(f"{name}-keyed")
        return found

    def _levels(self, profile: DataFrame) -> None:
        sums = profile.filter("chunk is not null").select("chunk", "counts").repartition(min(self.parts, SLOTS // CHUNK), "chunk").mapInArrow(_summed, "chunk int, levels binary")
        levels = np.zeros(SLOTS, np.uint8)
        for row in sums.collect():  # SLOTS bytes
            levels[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.levels, np.uint8)
        self.levels = self.spark.sparkContext.broadcast(levels)  # SLOTS bytes

    def profile(self) -> DataFrame:
        """Rows (doc_id, mark, key, n), one a document; the word counts are summed up on the way."""
        docs = self.docs.withColumn("mark", _marked(F.col("text")))
        profile = self.scratch.keep(docs.mapInArrow(_profile, "doc_id long, mark binary, key binary, n long, chunk int, counts binary"), "profile")
        self._levels(profile)
        return profile.filter("key is not null").select("doc_id", "mark", "key", "n")

    def distinct(self, rows: DataFrame) -> DataFrame:
        """The distinct sets: key, n, least (document id), and what else with_more needs."""
        return rows.groupBy("key").agg(F.min("n").alias("n"), F.min("doc_id").alias("least"))

    def with_more(self, sets: DataFrame, wanted) -> DataFrame:
        """Sets (key, tokens) with more: what a comparison needs besides them; wanted: the filter of their keys, or None."""
        return sets.withColumn("more", F.lit(None).cast("binary"))

    def members(self) -> tuple[DataFrame, float]:
        """Of each node (node, n, short, tokens), the tokens of which it shares one with each partner, and how many rows of tokens there may be."""
        found = self.docs.mapInArrow(_prefixes(self.levels), "key binary, short int, tokens array<long>").dropDuplicates(["key"])
        prefixes = self.scratch.keep(found.join(self.nodes.select("key", "node", "n"), "key").select("node", "n", "short", "tokens"), "prefixes")
        return prefixes, prefixes.agg(F.sum(F.size("tokens"))).first()[0] or 0

    def groups(self) -> DataFrame:
        """Rows (token, part, node, m, lead, lead_m): the members of tokens' groups and what each points to; part is -1 where the group is whole."""
        prefixes, n = self.members()
        # A sketch tells tokens of over 2 / TRACKED of its rows at least; there are as many sketches as keep that share under WHOLE rows.
        sketches = max(1, -(-2 * int(n) // (TRACKED * WHOLE)))
        by = [F.pmod(F.xxhash64("token"), F.lit(sketches)).alias("k")] if sketches > 1 else []
        top = prefixes.select(F.explode("tokens").alias("token")).groupBy(*by).agg(F.expr(f"approx_top_k(token, {TRACKED // 2}, {TRACKED})").alias("top"))
        often = top.select(F.explode("top").alias("top")).select(F.col("top.item").alias("token"), F.ceil(F.col("top.count") / PART).cast("int").alias("parts")).filter("parts > 1")
        often = self.scratch.keep(often, "often")
        if sketches == 1:
            often = F.broadcast(often)  # TRACKED / 2 short rows at most
        tokens = prefixes.select("node", "n", "short", F.posexplode("tokens").alias("pos", "token")).select("token", "node", (F.col("n") * 2 + (F.col("pos") >= F.col("short")).cast("long")).alias("m"))
        tokens = tokens.join(often, "token", "left").select("token", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(-1)).alias("part"), "node", "m")
        near = _matched(tokens, self.threshold)
        group = Window.partitionBy("token", "part")
        near = near.withColumn("lead", F.min(F.struct("node", "m")).over(group)).withColumn("last", F.max("node").over(group)).filter("part >= 0 or lead.node <> last")
        found = self.scratch.keep(near.select("token", "part", "node", "m", F.col("lead.node").alias("lead"), F.col("lead.m").alias("lead_m")), "groups")
        self.scratch.drop("prefixes")
        return found

    def run(self) -> DataFrame:
        """Per row: doc_id, mark, n, root (null for an empty set), component_id."""
        keep, drop = self.scratch.keep, self.scratch.drop
        profile = self.profile()
        self.nodes = keep(self.distinct(profile.filter("n > 0")).withColumn("node", F.monotonically_increasing_id()), "nodes")
        rows = keep(profile.select("doc_id", "mark", "key", "n"), "rows")
        drop("profile")
        groups = self.groups()

        # The smallest nodes of a split group's parts point to the smallest of all.
        heads = groups.filter("part >= 0 and node = lead").select("token", "node", "m")
        upper = heads.withColumn("top", F.min(F.struct("node", "m")).over(Window.partitionBy("token"))).select("node", "m", F.col("top.node").alias("lead"), F.col("top.m").alias("lead_m"))
        pair = groups.select("node", "m", "lead", "lead_m").unionByName(upper).filter("node <> lead").filter(_fits(F.least("m", "lead_m"), F.greatest("m", "lead_m"), self.threshold)).groupBy("node", "lead").agg(F.count("*").alias("c"))
        first = pair.groupBy("node").agg(F.min(F.struct((-F.col("c")).alias("c"), "lead")).alias("best")).select(F.col("best.lead").alias("block"), "node")
        many = first.groupBy("block").agg(F.ceil(F.count("*") / F.lit(SLICE)).cast("int").alias("slices"))
        sides = first.join(many, "block").select("block", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("part"), F.lit(1).alias("side"), "node", F.col("node").alias("root"))
        held = many.select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"), F.lit(0).alias("side"), F.col("block").alias("node"), F.col("block").alias("root"))
        links = self.links(held.unionByName(sides), "first")
        roots = components(links, self.scratch, "early")

        # Groups that still hold several components.
        placed = keep(groups.select("token", "part", "node", "m").join(roots, "node", "left").select("token", "part", "node", "m", F.coalesce("root", "node").alias("root")), "placed")
        drop("groups")
        several = placed.groupBy("token").agg(F.min("root").alias("block"), F.max("root").alias("top"), F.max("part").alias("last")).filter("block <> top")
        several = several.select("token", "block", F.explode(F.sequence(F.least(F.lit(0), F.col("last")), F.col("last"))).alias("part"))
        open_ = _matched(placed.join(several, ["token", "part"]), self.threshold)
        members = keep(open_.groupBy("block", "node").agg(F.min("root").alias("root"), F.min(F.floor(F.col("m") / 2)).alias("n")), "members")
        portions = members.groupBy("block").agg(F.ceil(F.sum(F.when(F.col("root") != F.col("block"), F.col("n") + self.besides)) / F.lit(PORTION)).cast("int").alias("portions"), F.ceil(F.count("*") / F.lit(SLICE)).cast("int").alias("slices")).filter("portions > 0")
        spread = keep(members.join(portions, "block"), "spread")
        steps = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        one_of = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
        part = (F.col("portion") * F.col("slices") + F.col("slice")).alias("part")
        held = spread.filter("root <> block").select("*", one_of("portions").alias("portion"), steps("slices").alias("slice")).select("block", part, F.lit(0).alias("side"), "node", "root")
        sides = spread.select("*", one_of("slices").alias("slice"), steps("portions").alias("portion")).select("block", part, F.lit(1).alias("side"), "node", "root")
        late = self.links(held.unionByName(sides), "late")
        if self.levels:
            self.levels.destroy()
        later = components(late, self.scratch, "all").select(F.col("node").alias("root"), F.col("root").alias("top"))  # of roots

        node_root = self.nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(later, "root", "left").select("key", "least", F.coalesce("top", "root").alias("root"))
        label = node_root.groupBy("root").agg(F.min("least").alias("component_id"))
        of_key = keep(node_root.join(label, "root").select("key", "root", "component_id"), "labels")
        for name in ("placed", "members", "spread", "first-links", "late-links", "nodes", "often"):
            drop(name)
        return rows.join(of_key, "key", "left").select("doc_id", "mark", "n", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    return Join(docs, id_col, text_col).run().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id (null last; then by a digest of the text), all columns as they were.

    Texts without words are linked with nothing and stay; rows that repeat both id and text stay once.
    """
    return kept_rows(docs, Join(docs, id_col, text_col).run(), id_col, text_col)


def kept_rows(docs: DataFrame, label: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay, by the result of a run over them."""
    first = label.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")).alias("w")).select("w.doc_id", "w.mark")
    kept = first.unionByName(label.filter("root is null").select("doc_id", "mark").distinct()).select(F.col("doc_id").alias("kept_id__"), F.col("mark").alias("kept_mark__"))
    own = docs.withColumn("own_id__", F.col(id_col).cast("long")).withColumn("own_mark__", _marked(F.col(text_col)))
    return own.join(kept, F.col("own_id__").eqNullSafe(F.col("kept_id__")) & (F.col("own_mark__") == F.col("kept_mark__")), "left_semi").dropDuplicates(["own_id__", "own_mark__"]).drop("own_id__", "own_mark__")


def op8_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))


QUERIES = {"op8_ngram_join": op8_ngram_join}
#: Sets of 5-grams, links by counting common tokens, components by a closure.
SETS_SQL = r"""
ng_w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from DOCS),
ng_s as materialized (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from ng_w where len(w) > 0)),
ng_n as materialized (select doc_id, count(*) as n from ng_s group by doc_id),
ng_c as (select a.doc_id as a, b.doc_id as b, count(*) as c from ng_s a join ng_s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
ng_l as materialized (select a, b from ng_c join ng_n x on x.doc_id = a join ng_n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
ng_e as materialized (select a as u, b as v from ng_l union select b, a from ng_l),
ng_r as (select u, v from ng_e union select r.u, e.v from ng_r r join ng_e e on r.v = e.u),
ng_m as (select u as doc_id, min(v) as m from ng_r group by u)"""
SQL = {
    "op8_ngram_join": f"""
with recursive {SETS_SQL.replace('DOCS', 'documents')}
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id
from documents d left join ng_n using (doc_id) left join ng_m using (doc_id)"""
}
