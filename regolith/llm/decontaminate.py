"""Benchmark decontamination with suffix arrays over the training text.

Training documents are dealt with in shards: runs of whole documents, about
SHARD_BYTES of text (a longer document is a shard of its own).  A shard's words
are numbered and its suffixes sorted by their first 27 words, in three rounds
of three-fold ranking (two-fold where the ranks are too large), and further
where an item matches deeper.  Every suffix of every test item is looked up by
binary search in every shard, word by word, which gives the interval of its
occurrences at each depth: at depth 10 the hits of the contract's windows, at
the last depth that is not empty the longest verbatim match and its places.
Items that hold the same words have the same interval, whose places are read
once.  Documents end in a separator that no item has, so no match leaves its
document.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased and are
compared by 128-bit hashes.  A null or empty text has no words and is clean; an
item without words has no window; a null item_id is listed as an empty string,
and repeated items count once.  Empty tables are fine; further columns are not
read by scan, and remove_contaminated returns them as they are.  Rows that
share an id are documents of their own.

The items are broadcast in blocks of at most BLOCK_WORDS words each, at most
BLOCKS of them at a time: a larger benchmark takes several passes, with what
was found so far written down between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.store import Scratch, table
from regolith.llm.text import ALNUM, Words, buffers, ragged, slices, streamed, words_of

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 1 << 20
BLOCKS = 8


class SuffixArray:
    """Suffixes of a sequence of word numbers (0: separator), sorted by their first `depth` words."""

    def __init__(self, seq: np.ndarray, least: int = 16):
        self.seq = seq
        self.rank, self.depth, self.order = seq.astype(np.int64), 1, None
        while self.depth < least or self.order is None:
            self.deepen()

    def deepen(self) -> None:
        """One more round of ranking; suffixes that agreed up to the old depth stay together."""
        rank, depth = self.rank, self.depth
        top = int(rank.max(initial=0)) + 2
        fold = 3 if top < 1 << 21 else 2
        key = rank + 1
        for k in range(1, fold):
            key = key * top
            if k * depth < len(rank):
                key[: -k * depth] += rank[k * depth :] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.empty(len(key), bool)
        new[:1] = False
        np.not_equal(key[1:], key[:-1], out=new[1:])
        dense = np.cumsum(new)
        rank = np.empty(len(key), np.int64)
        rank[order] = dense
        self.rank, self.order, self.depth = rank, order, depth * fold
        if not len(dense) or dense[-1] == len(dense) - 1:
            self.depth = 1 << 40  # all suffixes are told apart

    def bound(self, lo: np.ndarray, hi: np.ndarray, at: int, word: np.ndarray, right: bool) -> np.ndarray:
        """For each interval, whose suffixes agree in `at` words, the first place whose next word is not below `word` (right: above it)."""
        lo, hi = lo.copy(), hi.copy()
        n = len(self.seq)
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) >> 1
            place = self.order[mid] + at
            here = np.where(place < n, self.seq[np.minimum(place, n - 1)], -1)
            below = here <= word[live] if right else here < word[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
        return lo


class Items:
    """Test items as one run of word hashes: words, offsets, and ids."""

    def __init__(self, ids: list[str], texts: list[str]):
        w = words_of(*buffers(pa.array(texts, pa.string())), ALNUM)
        self.ids, self.hashes, self.checks, self.offsets = ids, w.hashes, w.checks, w.offsets

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each suffix: its item, its start, its length."""
        sizes = np.diff(self.offsets)
        item = np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(len(self.hashes))
        return item, start, self.offsets[1:][item] - start


@dataclass
class Intervals:
    """Distinct intervals of a suffix order: bounds and depths, and the items of each (items[bounds[k]:bounds[k + 1]], sorted)."""

    lo: np.ndarray
    hi: np.ndarray
    depth: np.ndarray
    items: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(found: list[tuple], item: np.ndarray) -> Intervals:
        """From rows of (suffix, lo, hi, depth)."""
        q, lo, hi, depth = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
        rows = np.unique(np.stack([lo, hi, depth, item[q]], 1), axis=0)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
        at = np.flatnonzero(new)
        return Intervals(rows[at, 0], rows[at, 1], rows[at, 2], rows[:, 3], np.append(at, len(rows)))

    def places(self, shard: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """All places, and the number of the interval of each."""
        return shard.order[ragged(self.lo, self.hi - self.lo)], np.repeat(np.arange(len(self.lo)), self.hi - self.lo)


def lookup(shard: SuffixArray, numbers: np.ndarray, items: Items) -> tuple[Intervals, Intervals]:
    """The intervals of all windows of the items in a shard, and those of their longest matches (of WINDOW words at least)."""
    item, start, left = items.suffixes()
    window = np.minimum(WINDOW, np.diff(items.offsets)[item])
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(shard.seq), np.int64)
    alive = np.arange(len(start))
    hits: list[tuple] = []
    longest: list[tuple] = []
    depth = 0
    while len(alive):
        while depth >= shard.depth:
            shard.deepen()
        can = left[alive] > depth
        word = np.where(can, numbers[np.minimum(start[alive] + depth, len(numbers) - 1)], -1)
        a, b = lo[alive], hi[alive]
        b = np.where(word > 0, b, a)
        low = shard.bound(a, b, depth, word, False)
        high = shard.bound(low, b, depth, word, True)
        ended = low >= high
        if depth >= WINDOW and ended.any():  # the last depth that held is the longest match
            longest.append((alive[ended], lo[alive[ended]], hi[alive[ended]], np.full(int(ended.sum()), depth)))
        lo[alive], hi[alive] = low, high
        alive = alive[~ended]
        depth += 1
        full = alive[(window[alive] == depth) & (depth <= left[alive])]
        if len(full):
            hits.append((full, lo[full], hi[full], np.full(len(full), depth)))
    return Intervals.of(hits, item), Intervals.of(longest, item)


def _number(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 of a shard's words, and those of the items' words (-1 for words that the shard has not)."""
    known, first, number = np.unique(w.hashes, return_index=True, return_inverse=True)
    checks = w.checks[first]
    if (checks[number] != w.checks).any():  # two words share half a hash: both halves count
        both = np.stack([np.concatenate([w.hashes, items.hashes]), np.concatenate([w.checks, items.checks])], 1)
        own = np.unique(both, axis=0, return_inverse=True)[1].ravel() + 1
        return own[: len(w.hashes)], np.where(np.isin(own[len(w.hashes) :], own[: len(w.hashes)]), own[len(w.hashes) :], -1)
    if not len(known):
        return number, np.full(len(items.hashes), -1)
    spot = np.minimum(np.searchsorted(known, items.hashes), len(known) - 1)
    return number + 1, np.where((known[spot] == items.hashes) & (checks[spot] == items.checks), spot + 1, -1)


def scan_texts(texts: pa.Array, blocks: list) -> Iterator[dict]:
    """Facts of each text, shard by shard: n_words, hits (merged ranges of words), items (sorted ids), longest, longest_at, longest_item."""
    buf, offs = buffers(texts)
    for i, j in slices(offs, SHARD_BYTES):
        w = words_of(buf, offs[i : j + 1], ALNUM)
        n = j - i
        sizes = np.diff(w.offsets)
        first = w.offsets[:-1] + np.arange(n)
        at = np.arange(len(w.hashes)) + np.repeat(np.arange(n), sizes)
        mark = np.zeros(len(w.hashes) + n + 1, np.int64)
        found: list[set] = [set() for _ in range(n)]
        best: list[tuple] = [(0, None, None)] * n
        shard = None
        for block in blocks:
            items = block.value if hasattr(block, "value") else block
            if not len(items.hashes) or not len(w.hashes):
                continue
            number, numbers = _number(w, items)
            if shard is None or (shard.seq[at] != number).any():
                seq = np.zeros(len(number) + n, np.int64)  # a separator stands after each document
                seq[at] = number
                shard = SuffixArray(seq)
            windows, longest = lookup(shard, numbers, items)
            place, k = windows.places(shard)
            np.add.at(mark, place, 1)
            np.add.at(mark, place + windows.depth[k], -1)
            doc = np.searchsorted(first, place, "right") - 1
            own: dict[int, list[int]] = {}
            for d, x in np.unique(np.stack([doc, k], 1), axis=0).tolist():
                own.setdefault(d, []).append(x)
            named: dict[tuple, frozenset] = {}  # documents with the same passages share their items
            for d, xs in own.items():
                key = tuple(xs)
                if key not in named:
                    named[key] = frozenset(items.ids[y] for y in np.unique(np.concatenate([windows.items[windows.bounds[x] : windows.bounds[x + 1]] for x in xs])).tolist())
                found[d] |= named[key]
            place, k = longest.places(shard)
            doc = np.searchsorted(first, place, "right") - 1
            order = np.lexsort((place, -longest.depth[k], doc))
            head = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
            for d, p, x in zip(doc[head].tolist(), place[head].tolist(), k[head].tolist(), strict=True):
                size = int(longest.depth[x])
                best_name = min(items.ids[y] for y in longest.items[longest.bounds[x] : longest.bounds[x + 1]].tolist())
                known = best[d]
                if known[1] is None or (-size, p - int(first[d]), best_name) < (-known[0], known[1], known[2]):
                    best[d] = (size, p - int(first[d]), best_name)
        covered = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
        edge = np.diff(covered.astype(np.int8))
        begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        doc = np.searchsorted(first, begin, "right") - 1
        hits: list[list[int]] = [[] for _ in range(n)]
        for d, a, b in zip(doc.tolist(), (begin - first[doc]).tolist(), (end - first[doc]).tolist(), strict=True):
            hits[d] += [a, b]
        yield {"n_words": sizes, "hits": hits, "items": [sorted(x) for x in found], "longest": [b[0] for b in best], "longest_at": [b[1] for b in best], "longest_item": [b[2] for b in best]}


def merged(ranges: list[int]) -> list[int]:
    """Ranges start, end, start, end ... in order, those that meet as one."""
    out: list[int] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def item_passes(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_WORDS, blocks: int = BLOCKS) -> Iterator[list]:
    """The items in broadcast blocks of bounded size, pass by pass; one block is on the driver at a time."""
    spark = benchmark.sparkSession
    held, ids, texts, size = [], [], [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    for row in rows.toLocalIterator():
        if ids and size + len(row.t) // 2 > most:
            held.append(spark.sparkContext.broadcast(Items(ids, texts)))
            ids, texts, size = [], [], 0
            if len(held) == blocks:
                yield held
                held = []
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t) // 2
    if ids:
        held.append(spark.sparkContext.broadcast(Items(ids, texts)))
    yield held


_STATE = "n_words long, hits array<long>, items array<string>, longest long, longest_at long, longest_item string"


def _find(blocks: list, last: bool):
    """One pass: adds what its items hit to what was found before; the last one leaves the text out."""

    def run(batches):
        for batch in streamed(batches):
            at = 0
            for f in scan_texts(batch.column("text"), blocks):
                n = len(f["n_words"])
                old = batch.slice(at, n)
                hits = [merged([*(a or []), *b]) for a, b in zip(old.column("hits").to_pylist(), f["hits"], strict=True)]
                items = [sorted({*(a or []), *b}) for a, b in zip(old.column("items").to_pylist(), f["items"], strict=True)]
                before = zip(*(old.column(c).to_pylist() for c in ("longest", "longest_at", "longest_item")), strict=True)
                best = [min((x for x in (a, b) if x[0]), key=lambda x: (-x[0], x[1], x[2]), default=(0, None, None)) for a, b in zip(before, zip(f["longest"], f["longest_at"], f["longest_item"], strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [old.column("doc_id"), *([] if last else [old.column("text")]), pa.array(f["n_words"], pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), *(pa.array([b[k] for b in best], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))],
                    ["doc_id", *([] if last else ["text"]), "n_words", "hits", "items", "longest", "longest_at", "longest_item"],
                )
                at += n

    return run


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", passes: Iterator[list] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hits (ranges of words), longest, longest_at, longest_item."""
    scratch = Scratch(docs.sparkSession)
    state = [F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in _STATE.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *state)
    passes = passes or item_passes(benchmark, item_col, item_text_col)
    blocks, k = next(passes), 0
    while (after := next(passes, None)) is not None:
        rows, blocks, k = scratch.keep(rows.mapInArrow(_find(blocks, False), f"doc_id long, text string, {_STATE}"), f"pass-{k}"), after, k + 1
    now = rows.mapInArrow(_find(blocks, True), f"doc_id long, {_STATE}")
    n_hit = F.expr("aggregate(sequence(0, size(hits) - 1, 1), 0L, (s, k) -> s + IF(k % 2 = 0, -hits[k], hits[k]))")
    n_hit = F.when(F.size("hits") > 0, n_hit).otherwise(0)
    out = now.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "items", "hits", "longest", "longest_at", "longest_item")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "items", "hits", "longest", "longest_at", "longest_item")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without a hit, all their columns as they were; decided where they lie."""

    def without(blocks):
        def run(batches):
            for batch in streamed(batches):
                clean = [not h for f in scan_texts(batch.column(text_col), blocks) for h in f["hits"]]
                if clean:
                    yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    scratch, now = Scratch(docs.sparkSession), None
    for k, blocks in enumerate(item_passes(benchmark, item_col, item_text_col)):
        docs = docs if now is None else scratch.keep(now, f"pass-{k}")
        now = docs.mapInArrow(without(blocks), docs.schema)
    return now


def op3_decontaminate(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at", "longest_item")


QUERIES = {"op3_decontaminate": op3_decontaminate}
#: Words as arrays; windows of 10 (or a whole shorter item) joined to the documents' runs of the same length.
HITS_SQL = r"""
w_d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from DOCS),
w_b as (select coalesce(item_id::varchar, '') as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from w_b where len(w) > 0)),
sizes as (select distinct n from win),
run as materialized (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from w_d, sizes where len(w) >= n)),
hit as (select r.doc_id, r.i, r.n, win.item_id from run r join win on r.n = win.n and r.g = win.g),
pos as (select distinct doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)),
n_hit as (select doc_id, count(*) as n_hit from pos group by doc_id),
n_items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from hit) group by doc_id),
wpos as (select item_id, j, array_to_string(w[j:j + 9], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 8)) as j from w_b where len(w) >= 10)),
diag as (select r.doc_id, wpos.item_id, r.i, r.i - wpos.j as d from run r join wpos on r.n = 10 and r.g = wpos.g),
stretch as (select doc_id, item_id, min(i) as i, count(*) + 9 as m from (select *, i - row_number() over (partition by doc_id, item_id, d order by i) as island from (select distinct * from diag)) group by doc_id, item_id, d, island),
longest as (select doc_id, min(row(-m, i - 1, item_id)) as b from stretch group by doc_id)"""
SQL = {
    "op3_decontaminate": f"""
with {HITS_SQL.replace('DOCS', 'documents')}
select w_d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
       coalesce(-b[1], 0)::bigint as longest, b[2]::bigint as longest_at, b[3] as longest_item
from w_d left join n_hit using (doc_id) left join n_items using (doc_id) left join longest using (doc_id)"""
}
