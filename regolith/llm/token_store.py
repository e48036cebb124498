"""Token-ID output in shards compressed by Re-Pair, readable at any place.

Documents are range-partitioned by id and tokenised in runs of whole documents.
Where the tokenizer's file shows that white space always splits (splits_at_space),
the distinct words of a run (pieces between white space, a closing comma or full
stop apart) are encoded once by the tokenizers library and kept in a bounded
cache of the worker, under 128-bit hashes; texts are put together from their
words' ids.  With any other tokenizer each text is encoded as a whole.  Special
tokens that stand in a text become their own ids, as the library does it.

A run's ids are one shard, over an alphabet of the ids that occur in it.
Re-Pair replaces pairs of neighbouring symbols by new symbols until no pair
occurs twice: each round takes frequent pairs whose left and right symbols do
not clash, so that all their places are replaced at once; in a run of one
symbol every second pair counts.  Pairs never cross the end of a document.  The
shard holds the alphabet, the rules, the expansion length of each new symbol,
the symbols, and for each document its id, its first symbol and its number of
ids; any document or id can be decoded without the rest.  least_count, most_rules
and least_gain stop earlier, for less time at more bytes.

Shards are rows of a Parquet table in the shared folder, written by Spark's
committer, so that a lost executor leaves no half-written shard; they are
ordered by (part, seq), which is ascending document id (null first; repeated
ids by a hash of their text).

A null or empty text has the end id only.  An empty table gives no shard.
Further columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.store import Scratch, table
from regolith.llm.text import NOT_SPACE, buffers, ragged, slices, streamed, words_of

END_ID = 2
SHARD_BYTES = 3 << 20
CACHE_WORDS = 700_000
#: New words that are encoded together.
WORDS_A_TEXT = 400
#: Pairs looked at in one round while the most frequent one occurs over RARE times; then all are.
PAIRS_A_ROUND, RARE = 32768, 200
_MAGIC = b"RPTS2\0\0\0"
#: Normalizers and the pattern that never look across white space.
_SPACE_SAFE = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
_SPACE_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def splits_at_space(path: str) -> bool:
    """Whether a tokenizer file is known to encode the words of a text one by one: then words can be cached."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    normalizer, before = t.get("normalizer") or {}, t.get("pre_tokenizer") or {}
    plain = all(n in _SPACE_SAFE for n in normalizer.get("normalizers", [normalizer] if normalizer else []))
    steps = before.get("pretokenizers", [before])
    split = steps[0] == _SPACE_SPLIT and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in steps[1:])
    added = all(not (x["lstrip"] or x["rstrip"] or x["normalized"]) and not any(c.isspace() for c in x["content"]) for x in t.get("added_tokens", []))
    return plain and split and added and t["model"].get("dropout") is None


class Encoder:
    """Ids of texts, by a cache of words (sorted hashes with their other halves, and their ids in one array)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_space(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.begin = np.empty(0, np.int32)
        self.size = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)
        self.again = np.empty(0, bool)  # words that were met in a later run than the one they came from

    def _make_room(self, more: int) -> bool:
        """Leaves out words that were not met again; all, where these are too few. Whether some are left."""
        stay = np.flatnonzero(self.again)
        if 2 * len(stay) > CACHE_WORDS or len(stay) + more > CACHE_WORDS:
            self.clear()
            return False
        self.ids = self.ids[ragged(self.begin[stay], self.size[stay])]
        self.hashes, self.checks, self.size = self.hashes[stay], self.checks[stay], self.size[stay]
        self.begin = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.again = np.zeros(len(stay), bool)
        return True

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has; many words are encoded as one text and told apart by their places."""
        all_ids, sizes = [], []
        for at in range(0, len(starts), WORDS_A_TEXT):
            a, b = starts[at : at + WORDS_A_TEXT], ends[at : at + WORDS_A_TEXT]
            after = np.cumsum(b - a + 1)
            joined = buf[np.minimum(ragged(a, b - a + 1), len(buf) - 1)]
            joined[after - 1] = 32
            try:
                text = joined.tobytes().decode("utf-8")
                chars = np.concatenate([[0], np.cumsum(joined & 0xC0 != 0x80)])
                first = chars[after - (b - a + 1)]
            except UnicodeDecodeError:  # word by word, as each replaces what is no text
                own = [buf[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                text, first = " ".join(own), np.cumsum([0] + [len(w) + 1 for w in own[:-1]])
            e = self.tokenizer.encode(text, add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            all_ids.append(ids)
            begin = [e.char_to_token(x) for x in first.tolist()]
            if None in begin:  # a word whose first character no token holds
                place = np.array([x for x, _ in e.offsets], np.int64)
                sizes.append(np.bincount(np.searchsorted(first, place, "right") - 1, minlength=len(a)))
            else:
                sizes.append(np.diff(np.array([*begin, len(ids)], np.int64)))
        return np.concatenate(all_ids), np.concatenate(sizes)

    def _learn(self, buf, w, new: np.ndarray, first: np.ndarray, distinct: np.ndarray) -> None:
        ids, sizes = self._encode(buf, w.starts[first[new]], w.ends[first[new]])
        begin = (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)
        self.ids = np.concatenate([self.ids, ids])
        own = np.searchsorted(self.hashes, distinct[new]) + np.arange(len(new))  # both are sorted
        old = np.ones(len(self.hashes) + len(new), bool)
        old[own] = False
        for name, added in (("checks", w.checks[first[new]]), ("begin", begin), ("size", sizes.astype(np.int32)), ("again", np.zeros(len(new), bool)), ("hashes", distinct[new])):
            both = np.empty(len(old), added.dtype)
            both[old], both[own] = getattr(self, name), added
            setattr(self, name, both)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, each with the end id, and how many each text has."""
        if not self.by_word:
            return self.encode_whole(buf, offs)
        w = words_of(buf, offs, NOT_SPACE, cut_tail=True)
        order = np.argsort(w.hashes)
        ordered = w.hashes[order]
        edge = np.ones(len(order), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=edge[1:])
        distinct, first = ordered[edge], order[edge]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(edge) - 1
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            spot = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            known = self.hashes[spot] == distinct
            self.again[spot[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.hashes) + len(new) > CACHE_WORDS and not self._make_room(len(new)):
                new = np.arange(len(distinct))
            self._learn(buf, w, new, first, distinct)
        spot = np.searchsorted(self.hashes, distinct)
        if (self.checks[spot][number] != w.checks).any():  # two words share half a hash
            return self.encode_whole(buf, offs)
        begin, size = self.begin[spot][number] if len(number) else np.empty(0, np.int64), self.size[spot][number] if len(number) else np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        per_text = total[w.offsets[1:]] - total[w.offsets[:-1]] + 1
        ends = np.cumsum(per_text) - 1
        out = np.full(int(per_text.sum()), END_ID, np.uint32)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = self.ids[ragged(begin, size)]
        return out, per_text

    def encode_whole(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, each text by one call of the library."""
        raw = memoryview(buf)
        own = [np.array([*self.tokenizer.encode(bytes(raw[a:b]).decode("utf-8", "replace"), add_special_tokens=False).ids, END_ID], np.uint32) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return np.concatenate(own) if own else np.empty(0, np.uint32), np.array([len(x) for x in own], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _clash_free(pairs: np.ndarray, counts: np.ndarray, bits: int, size: int) -> np.ndarray:
    """Which of the pairs to replace together: no symbol is the left of one and the right of another.

    Pairs are taken greedily, the most frequent first.
    """
    left, right = pairs >> pairs.dtype.type(bits), pairs & pairs.dtype.type((1 << bits) - 1)
    order = np.argsort(-counts.astype(np.int32))
    if counts[order[0]] > RARE:
        order = order[:PAIRS_A_ROUND]
    lefts, rights, taken = bytearray(size), bytearray(size), []
    is_left, is_right = np.frombuffer(lefts, np.uint8), np.frombuffer(rights, np.uint8)
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        some = some[(is_right[left[some]] | is_left[right[some]]) == 0]  # most clash with pairs of earlier portions
        for k, a, b in zip(some.tolist(), left[some].tolist(), right[some].tolist(), strict=True):
            if not (rights[a] or lefts[b]):
                lefts[a] = rights[b] = 1
                taken.append(k)
    return np.sort(np.array(taken, np.int64))


def _sorted_places(seq: np.ndarray, here: np.ndarray, size: int, least_count: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of symbols below `size` that start at some places, as sorted numbers, and their places; without those that occur once, if that is too seldom."""
    half, place = (size - 1).bit_length(), (len(seq) - 1).bit_length()
    key = seq[here].astype(np.uint64)
    key <<= np.uint64(half)
    key |= seq[here + 1]
    packed = 2 * half + place <= 64
    if packed:  # pair and place in one number
        both = key
        both <<= np.uint64(place)
        both |= here.view(np.uint64)
        both.sort()
        key = both >> np.uint64(place)
    else:
        order = np.argsort(key, kind="stable")
        key, both = key[order], here[order]
    if least_count > 1:
        again = np.zeros(len(key) + 1, bool)
        np.equal(key[1:], key[:-1], out=again[1:-1])
        again = again[1:] | again[:-1]
        key, both = key[again], both[again]
    return key, (both & np.uint64((1 << place) - 1)).astype(np.int64) if packed else both


def re_pair(symbols: np.ndarray, last: np.ndarray, base: int, least_count: int = 2, most_rules: int | None = None, least_gain: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols below `base` compressed: symbols, which of them end a document, rules (left, right), and expansion lengths of all symbols."""
    seq, last = symbols.astype(np.uint32), last.copy()
    open_ = ~last[:-1]  # places whose pair may still occur often enough
    rules: list[np.ndarray] = []
    made, most = 0, most_rules if most_rules is not None else (1 << 31) - base
    length = np.ones(base, np.int64)
    while len(seq) > 1 and made < most:
        bits = 16 if base + made <= 1 << 16 else 32
        twin = np.flatnonzero(open_ & (seq[:-1] == seq[1:]))
        usable, open_ = open_, np.zeros(len(open_), bool)
        if len(twin):  # of a run of one symbol every second pair
            new = np.concatenate([[True], np.diff(twin) > 1])
            run = twin[new][np.cumsum(new) - 1]
            odd = twin[(twin - run) & 1 == 1]
            usable[odd], open_[odd] = False, True
        here = np.flatnonzero(usable)
        if not len(here):
            break
        keys, here = _sorted_places(seq, here, base + made, least_count)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        counts = np.diff(np.append(edge, len(keys)))
        often = np.flatnonzero(counts >= least_count)
        if not len(often):
            break
        open_[here if len(often) == len(edge) else here[np.repeat(counts >= least_count, counts)]] = True
        left, right = seq[here[edge[often]]], seq[here[edge[often]] + 1]
        pairs = (left.astype(np.uint64) << np.uint64(bits)) | right
        chosen = _clash_free(pairs.astype(np.uint32) if bits == 16 else pairs, counts[often], bits, base + made)[: most - made]  # in the order of pairs
        left, right, picked = left[chosen], right[chosen], often[chosen]
        at = here[ragged(edge[picked], counts[picked])]
        spot = np.repeat(np.arange(len(picked)), counts[picked])
        seq[at] = (base + made + spot).astype(np.uint32)
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        gain = len(at) / len(seq)
        for near in (at[at < len(open_)], at[at > 0] - 1):  # pairs that are new
            open_[near] = ~last[near]
        seq, last, open_ = seq[stay], last[stay], open_[stay[:-1]]
        if len(open_) == len(seq):  # the last symbol was the right one of a pair
            open_ = open_[:-1]
        rules.append(np.stack([left, right], 1))
        length = np.concatenate([length, length[left] + length[right]])
        made += len(picked)
        if gain < least_gain:
            break
    return seq, last, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), length


def _overlaps(bits: int):
    """Of eight numbers of so many bits each, in as many bytes: which byte holds a part of which number, and how far left of the byte's end that number ends."""
    return [(i, j, 8 * i + 8 - (j + 1) * bits) for i in range(bits) for j in range(8 * i // bits, (8 * i + 7) // bits + 1)]


def pack(values: np.ndarray, bits: int) -> bytes:
    """Numbers of so many bits each, one after another."""
    padded = np.zeros(-(-len(values) // 8) * 8, np.uint32)
    padded[: len(values)] = values
    eights = np.ascontiguousarray(padded.reshape(-1, 8).T)
    out = np.zeros((bits, eights.shape[1]), np.uint8)
    for i, j, left in _overlaps(bits):
        out[i] |= (eights[j] << np.uint32(left) if left >= 0 else eights[j] >> np.uint32(-left)).astype(np.uint8)
    return out.T.tobytes()[: -(-len(values) * bits // 8)]


def unpack(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    padded = np.zeros(-(-n // 8) * bits, np.uint8)
    padded[: len(raw)] = raw
    parts = np.ascontiguousarray(padded.reshape(-1, bits).T).astype(np.uint32)
    out = np.zeros((8, parts.shape[1]), np.uint32)
    for i, j, left in _overlaps(bits):
        out[j] |= parts[i] >> np.uint32(left) if left >= 0 else parts[i] << np.uint32(-left)
    return (out & np.uint32((1 << bits) - 1)).T.reshape(-1)[:n]


def write_shard(doc_ids: list, ids: np.ndarray, sizes: np.ndarray, **stops) -> bytes:
    """The bytes of a shard: header, document table, alphabet, rules, expansion lengths, symbols."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    alphabet = np.flatnonzero(np.bincount(ids))
    number = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    symbols, base = number[ids], len(alphabet)
    seq, ends, rules, length = re_pair(symbols, last, base, **stops)
    first = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if len(sizes) else np.empty(0, np.int64)
    bits = max(1, int(base + len(rules)).bit_length())
    span = max(1, int(length.max(initial=1)).bit_length())
    head = struct.pack("<8sIIQQBB6x", _MAGIC, base, len(rules), len(sizes), len(seq), bits, span)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    return b"".join([head, known.tobytes(), docs.tobytes(), sizes.astype("<u4").tobytes(), first.astype("<u4").tobytes(), alphabet.astype("<u4").tobytes(), pack(rules.ravel(), bits), pack(length[base:], span), pack(seq, bits)])


@dataclass
class Shard:
    """A shard read back; documents and ids decode one by one."""

    doc_ids: list
    sizes: np.ndarray
    first: np.ndarray
    alphabet: np.ndarray
    rules: np.ndarray
    length: np.ndarray
    symbols: np.ndarray

    @staticmethod
    def read(blob: bytes) -> Shard:
        magic, base, n_rules, n_docs, n_symbols, bits, span = struct.unpack_from("<8sIIQQBB6x", blob)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<8sIIQQBB6x")

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        known, docs, sizes, first = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs), take("<u4", n_docs)
        alphabet = take("<u4", base)
        rules, length, symbols = (unpack(take("u1", -(-n * k // 8)), n, k) for n, k in ((2 * n_rules, bits), (n_rules, span), (n_symbols, bits)))
        return Shard([d if k else None for d, k in zip(docs.tolist(), known.tolist(), strict=True)], sizes.astype(np.int64), first.astype(np.int64), alphabet, rules.reshape(-1, 2), length.astype(np.int64), symbols)

    @property
    def base(self) -> int:
        return len(self.alphabet)

    def _lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        new = symbols >= self.base
        out[new] = self.length[symbols[new] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols; for many of them each rule is expanded once, where all rules together have no more ids."""
        size = self._lengths(symbols)
        if self.length.sum() > size.sum():
            return self._expand(symbols, size)
        rules = self._expand(self.base + np.arange(len(self.rules)), self.length)
        begin = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.length) - self.length])
        return np.concatenate([self.alphabet, rules])[ragged(begin[symbols], size)]

    def _expand(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same: each symbol's room is known from the expansion lengths, and pairs are written into it level by level."""
        symbols = symbols.astype(np.int64)
        out = np.empty(int(size.sum()), np.uint32)
        at = np.cumsum(size) - size
        rules = self.rules.astype(np.int64)
        while len(symbols):
            new = symbols >= self.base
            out[at[~new]] = self.alphabet[symbols[~new]]
            a, b = rules[symbols[new] - self.base].T
            place = at[new]
            symbols, at = np.concatenate([a, b]), np.concatenate([place, place + self._lengths(a)])
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document alone."""
        end = self.first[k + 1] if k + 1 < len(self.first) else len(self.symbols)
        return self.expand(self.symbols[self.first[k] : end])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; only the documents they lie in are expanded."""
        bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        i, j = int(np.searchsorted(bounds, start, "right")) - 1, int(np.searchsorted(bounds, stop, "left"))
        if start >= stop:
            return np.empty(0, np.uint32)
        end = self.first[j] if j < len(self.first) else len(self.symbols)
        return self.expand(self.symbols[self.first[i] : end])[start - bounds[i] : stop - bounds[i]]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **stops) -> None:
    """Writes the shards: part, seq, n_docs, n_tokens, shard.  stops: least_count, most_rules, least_gain of re_pair."""

    def run(batches):
        from pyspark import TaskContext

        own, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in streamed(batches):
            buf, offs = buffers(batch.column("text"))
            for i, j in slices(offs, SHARD_BYTES):
                ids, sizes = own.encode(buf, offs[i : j + 1])
                blob = write_shard(batch.column("doc_id").slice(i, j - i).to_pylist(), ids, sizes, **stops)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([j - i], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "shard"])
                seq += 1

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ready = ready.withColumn("tie", F.xxhash64("text"))  # rows of one id, or of none, may fill several partitions
    ordered = ready.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(run, "part int, seq long, n_docs long, n_tokens long, shard binary").write.mode("overwrite").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens, ids_crc32 (and ids)."""

    def run(batches):
        for batch in streamed(batches):
            for row in range(batch.num_rows):
                shard = Shard.read(batch.column("shard")[row].as_py())
                ids = shard.expand(shard.symbols).astype("<u4")
                n = len(shard.sizes)
                bounds = np.concatenate([[0], np.cumsum(shard.sizes)])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                arrays = [pa.array([batch.column("part")[row].as_py()] * n, pa.int32()), pa.array([batch.column("seq")[row].as_py()] * n, pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(bounds[:-1], pa.int64()), pa.array(shard.sizes, pa.int64()), pa.array(crc, pa.int64())]
                names = ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    shards = spark.read.schema("part int, seq long, n_docs long, n_tokens long, shard binary").parquet(path)
    facts = shards.select("part", "seq", "n_tokens")
    of_part = facts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = of_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = facts.select("part", "seq", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    offsets = inside.join(before, "part").select("part", "seq", (F.col("before") + F.col("earlier")).alias("base"))
    rows = shards.select("part", "seq", "shard").mapInArrow(run, "part int, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    return rows.join(offsets, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_and_read_back(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    path = f"{Scratch(spark).root}/shards"
    write_tokens(docs, path, tokenizer or tokenizer_path(), id_col, text_col)
    return read_tokens(spark, path)


def op10_token_store(spark, sf_dir):
    return encode_and_read_back(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_store": op10_token_store}
SQL: dict[str, str] = {}
