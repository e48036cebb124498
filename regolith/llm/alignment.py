"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers read the bytes of a space and the text.  The ends of the tokens
of either are bits of a packed bitset over these bytes.  The AND of the two has
the cuts that both share; ranks (popcounts over words, with prefix sums) turn a
cut into the numbers of tokens before it, and so a pair of cuts into a range of
tokens of either side; the ranks of a token's first and last byte in the other
bitset give all tokens it overlaps with.

Where neither tokenizer can join bytes across the space after a visible ASCII
character (shown by its pre-tokenizer's pattern, or by its pieces), the bytes
are cut there, each distinct chunk is aligned once, and a bounded cache keeps
it; a document is then a sequence of chunks.  With other tokenizers a document
is one chunk.  A document of any length is read in blocks of chunks.

The count of a pair of ids, over all documents, needs a second look at each
document.  The first pass writes each document's distinct pairs, in packs of
about PACK bytes of text, and the pair counts of each task.  The summed counts
are split by the A id into slices of about SLICE pairs; a task of the second
pass holds one slice and streams the packs of its share of documents past it.
No id, pair or document gathers rows in one task.

A text that is null, empty, or whose tokens of either side do not spell the
bytes (a normalising tokenizer, an unknown piece) has no tokens: zeros, and ''
as digest.  Repeated rows are documents of their own.  An empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.store import Scratch, table
from regolith.llm.text import buffers, hash_words, ragged, slices, streamed

#: Bytes of text of a pack (or one longer text), of a block within a text, pairs of a slice, and chunks that the cache keeps.
PACK, BLOCK, SLICE, CACHE = 1 << 21, 1 << 21, 1 << 20, 1 << 18
#: Pair counts that a task sums up before it gives them on.
PAIRS = 1 << 20
_SPACE = "▁"
#: The pattern of byte-level pre-tokenizing, in which no match has a space after another character, and which never looks back.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False}


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabets write printable Latin-1 bytes as themselves and all others as characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = _byte_of_char()
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        self.spelling = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in names]
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        before = t.get("pre_tokenizer") or {}
        plain = not t.get("normalizer") and t["model"].get("dropout") is None and not any(x["lstrip"] or x["rstrip"] or not x["special"] for x in t.get("added_tokens", []))
        self.by_chunk = plain and {k: before.get(k) for k in _BYTE_LEVEL} == _BYTE_LEVEL and before.get("use_regex", True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of space + text."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.spelling = [bytes([int(m[1], 16)]) if self.model.is_byte(k) and (m := byte.fullmatch(t)) else t.replace(_SPACE, " ").encode() for k, t in enumerate(names)]
        # No piece has a space after another character, spaces are neither dropped nor joined, and no letter is rewritten.
        apart = not any(re.search(f"[^{_SPACE}]{_SPACE}", t) for t in names)
        probe = " x  ﬁ y Å"
        kept = b"".join(self.spelling[k] for k in self.model.encode(probe)) == b" " + probe.encode()
        self.by_chunk = apart and kept and not any(self.model.is_unused(k) for k in range(len(names)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def load(path: str):
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


class Bits:
    """A packed bitset with ranks."""

    def __init__(self, n: int, at: np.ndarray | None = None, words: np.ndarray | None = None):
        self.n = n
        if words is None:
            flags = np.zeros(-(-(n + 1) // 64) * 64, bool)
            flags[at] = True
            words = np.packbits(flags, bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.n, words=self.words & other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before a place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def places(self) -> np.ndarray:
        """The select of every rank: where the bits are."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def aligned(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the ends of two token sequences over the same n bytes: ends of the groups in bytes, in A tokens, and in B tokens; links as A and B numbers."""
    a, b = Bits(n, a_ends - 1), Bits(n, b_ends - 1)  # a token's bit is that of its last byte
    cuts = (a & b).places() + 1
    first = b.rank(np.concatenate([[0], a_ends[:-1]]))
    last = b.rank(a_ends - 1)
    many = last - first + 1
    return cuts, a.rank(cuts), b.rank(cuts), np.repeat(np.arange(len(a_ends)), many), ragged(first, many)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    many = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(many.sum())), many


class _Strings:
    """Byte strings by number, in one array."""

    def __init__(self, all_of: list[bytes]):
        self.size = np.array([len(s) for s in all_of], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(all_of), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.at[numbers], self.size[numbers])]


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind, *width: int):
        self.held, self.n = np.empty((1024, *width), kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.empty((self.n + 2 * len(more), *self.held.shape[1:]), self.held.dtype)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


@dataclass
class Groups:
    """Aligned chunks one behind the other: ids of both sides, group ends in A tokens, B tokens and bytes, links as A and B numbers, and where each chunk starts in all of these."""

    a: np.ndarray
    b: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    byte_cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    group_at: np.ndarray
    link_at: np.ndarray


class Aligner:
    """Chunks of bytes and how their tokens align; the arrays have one entry a known chunk."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = load(a_path), load(b_path)
        self.by_chunk = self.a.by_chunk and self.b.by_chunk
        self.sides = [(x, _Strings(x.spelling)) for x in (self.a, self.b)]
        self.base = len(self.b.spelling)
        numbers = range(max(len(self.a.spelling), self.base))
        self.decimals = _Strings([b"%d%c" % (k, c) for c in b",|;" for k in numbers])
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self._hashes, self._checks, self._uses = _Growing(np.uint64), _Growing(np.uint64), _Growing(np.int64)
        self._counts, self._fine = _Growing(np.int64, 4), _Growing(bool)  # A tokens, B tokens, groups, links; all zero where the spelling differs
        self._codes, self._shown, self._code_end, self._shown_end = _Growing(np.int64), _Growing(np.uint8), _Growing(np.int64), _Growing(np.int64)
        for ends in (self._code_end, self._shown_end):
            ends.add(np.zeros(1, np.int64))

    counts, fine, codes, shown, code_at, shown_at = (property(lambda self, n=n: getattr(self, n).all) for n in ("_counts", "_fine", "_codes", "_shown", "_code_end", "_shown_end"))

    def _spelled(self, side: int, flat: np.ndarray, many: np.ndarray, texts: np.ndarray, text_size: np.ndarray) -> np.ndarray:
        """Which chunks the tokens of a side spell, byte by byte."""
        strings = self.sides[side][1]
        owner = np.repeat(np.arange(len(many)), many)
        size = np.bincount(owner, strings.size[flat], len(many)).astype(np.int64)
        fine = (size == text_size) & (many > 0)
        at = np.cumsum(text_size) - text_size
        some = np.flatnonzero(fine)
        differ = strings.joined(flat[fine[owner]]) != texts[ragged(at[some], text_size[some])]
        fine[np.repeat(some, text_size[some])[differ]] = False
        return fine

    def groups(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, Groups]:
        """Which of the chunks b[starts:ends] both sides spell, and the groups of those."""
        raw = memoryview(b)
        words = [bytes(raw[i + 1 : j]).decode("utf-8", "replace") for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        size = ends - starts
        texts = b[ragged(starts, size)]
        flat = [_flat(x.encode(words)) for x, _ in self.sides]
        fine = self._spelled(0, *flat[0], texts, size) & self._spelled(1, *flat[1], texts, size)
        ids = [f[np.repeat(fine, many)] for f, many in flat]
        token_ends = [np.cumsum(strings.size[x]) for x, (_, strings) in zip(ids, self.sides, strict=True)]
        total = np.concatenate([[0], np.cumsum(size[fine])])
        cuts, a_cut, b_cut, left, right = aligned(*token_ends, int(total[-1]))
        a_at, b_at = (np.concatenate([[0], np.cumsum(many[fine])]) for _, many in flat)
        return fine, Groups(*ids, a_cut, b_cut, cuts, left, right, a_at, b_at, np.searchsorted(cuts, total, "right"), np.searchsorted(left, a_at))

    def _written(self, g: Groups) -> tuple[np.ndarray, np.ndarray]:
        """`a1,a2|b1;` of every group, and the bytes of each chunk."""
        n = len(g.a) + len(g.b)
        token, sign, numbers = np.empty(n, np.int64), np.empty(n, np.int64), len(self.decimals.size) // 3
        before = np.concatenate([[0], g.b_cut])
        for ids, cut, other, last in ((g.a, g.a_cut, before, 1), (g.b, g.b_cut, g.a_cut, 2)):
            at = np.arange(len(ids))
            group = np.searchsorted(cut, at, "right")
            place = at + other[group]
            token[place], sign[place] = ids, np.where(at + 1 == cut[group], last, 0)
        which = token + sign * numbers
        ends = np.concatenate([[0], np.cumsum(self.decimals.size[which])])
        return self.decimals.joined(which), np.diff(ends[g.a_at + g.b_at])

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        fine, g = self.groups(b, starts, ends)
        counts, shown_size = np.zeros((len(starts), 4), np.int64), np.zeros(len(starts), np.int64)
        counts[fine] = np.stack([np.diff(x) for x in (g.a_at, g.b_at, g.group_at, g.link_at)], axis=1)
        shown, shown_size[fine] = self._written(g)
        self._hashes.add(hashes)
        self._checks.add(checks)
        self._uses.add(np.zeros(len(starts), np.int64))
        self._counts.add(counts)
        self._fine.add(fine)
        self._codes.add(g.a[g.left] * self.base + g.b[g.right])
        self._code_end.add(self.code_at[-1] + np.cumsum(counts[:, 3]))
        self._shown.add(shown)
        self._shown_end.add(self.shown_at[-1] + np.cumsum(shown_size))

    def _forget(self) -> None:
        """Keeps the half of the cache that was met most often."""
        uses, old = self._uses.all, {n: getattr(self, n).all for n in ("_hashes", "_checks", "_counts", "_fine", "_codes", "_shown", "_code_end", "_shown_end")}
        most = np.argsort(-uses, kind="stable")[: CACHE // 2]
        most = np.sort(most[uses[most] > 1])
        self.clear()
        for n in ("_hashes", "_checks", "_counts", "_fine"):
            getattr(self, n).add(old[n][most])
        self._uses.add(uses[most] // 2)
        for n in ("_codes", "_shown"):
            at = old["_code_end" if n == "_codes" else "_shown_end"]
            size = at[most + 1] - at[most]
            getattr(self, n).add(old[n][ragged(at[most], size)])
            (self._code_end if n == "_codes" else self._shown_end).add(np.cumsum(size))
        self.number = dict(zip(self._hashes.all.tolist(), range(len(most)), strict=True))

    def numbers(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of chunks; unknown ones are learned.  They hold until the next call."""
        hashes, checks = hash_words(b, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        known = distinct.tolist()
        spot = np.fromiter((self.number.get(h, -1) for h in known), np.int64, len(known))
        new = np.flatnonzero(spot < 0)
        if len(new) and len(self.number) + len(new) > CACHE:
            self._forget()
            spot = np.fromiter((self.number.get(h, -1) for h in known), np.int64, len(known))
            new = np.flatnonzero(spot < 0)
        if len(new):
            spot[new] = self._hashes.n + np.arange(len(new))
            self._learn(distinct[new], checks[first[new]], b, starts[first[new]], ends[first[new]])
            self.number.update(zip(distinct[new].tolist(), spot[new].tolist(), strict=True))
        if (self._checks.all[spot][which] != checks).any():  # two chunks share half a hash: all are learned one by one, and forgotten after this call
            self.clear()
            self._learn(hashes, checks, b, starts, ends)
            return np.arange(len(starts))
        self._uses.all[spot] += np.bincount(which, minlength=len(spot))
        return spot[which]


def _blocks(buf: np.ndarray, offs: np.ndarray, by_chunk: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts, each with a space before it: (bytes, chunk starts, chunk ends, the chunks' texts), block by block; empty texts have no chunk."""
    size = np.diff(offs)
    live = np.flatnonzero(size > 0)
    i = 0
    while i < len(live):
        j = i + max(1, int(np.searchsorted(np.cumsum(size[live[i:]] + 1), BLOCK, "right")))
        own = live[i:j]
        starts = np.cumsum(size[own] + 1) - size[own] - 1
        b = np.full(int((size[own] + 1).sum()), 32, np.uint8)
        inside = np.ones(len(b), bool)
        inside[starts] = False
        b[inside] = buf[ragged(offs[own], size[own])]
        text_ends = starts + size[own] + 1
        if by_chunk:
            # A space after a visible ASCII character, unless it is the text's last byte.
            cut = np.flatnonzero((b[1:] == 32) & (b[:-1] > 32) & (b[:-1] < 127)) + 1
            cut = cut[~np.isin(cut, text_ends - 1)]
            at = np.union1d(starts, cut)
        else:
            at = starts
        ends = np.concatenate([at[1:], [len(b)]])
        of = own[np.searchsorted(starts, at, "right") - 1]
        step = max(1, int(len(at) * BLOCK / max(len(b), 1)))
        for k in range(0, len(at), step):  # more than one step only in a text of over BLOCK bytes
            lo, hi = at[k], ends[min(k + step, len(at)) - 1]
            yield b[lo:hi], at[k : k + step] - lo, ends[k : k + step] - lo, of[k : k + step]
        i = j


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, weights, len(distinct)).astype(np.int64)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[(a_path, b_path)] = Aligner(a_path, b_path)
    return _aligners[(a_path, b_path)]


def _packed(array: np.ndarray) -> bytes:
    return pa.compress(np.diff(array, prepend=array.dtype.type(0)).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind=np.int64) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind), dtype=kind)


_FIRST = {
    "row_no": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "rows": pa.binary(), "many": pa.binary(), "codes": pa.binary(), "times": pa.binary(), "n_rows": pa.int32(), "n_codes": pa.int32(), "pairs": pa.list_(pa.int64()), "documents": pa.list_(pa.int64()),
}
FIRST_SCHEMA = "row_no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, rows binary, many binary, codes binary, times binary, n_rows int, n_codes int, pairs array<long>, documents array<long>"


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _FIRST.items()], list(_FIRST))


def document_rows(own: Aligner, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: counts (A, B, groups, links), digests of the groups, and (text, code, times) of the distinct linked pairs, sorted."""
    n = len(offs) - 1
    counts, fine = np.zeros((n, 4), np.int64), np.ones(n, bool)
    digests: dict[int, object] = {}
    keys, times = [], []
    for b, starts, ends, of in _blocks(buf, offs, own.by_chunk):
        number = own.numbers(b, starts, ends)
        np.add.at(counts, of, own.counts[number])
        fine[of[~own.fine[number]]] = False
        size = own.shown_at[number + 1] - own.shown_at[number]
        shown = own.shown[ragged(own.shown_at[number], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])
        edges = np.flatnonzero(np.diff(of, prepend=-1))
        for k, i, j in zip(of[edges].tolist(), at[edges].tolist(), [*at[edges[1:]].tolist(), len(shown)], strict=True):
            last, digest = digests.get(k, (b"", hashlib.sha256()))
            digest.update(last + shown[i : j - 1])  # the last group's semicolon only if more follows
            digests[k] = (b";", digest)
        # The chunks of a text are counted first, then their pairs.
        chunk, often = _summed(of * (len(own.counts) + 1) + number, np.ones(len(of)))
        of, number = chunk // (len(own.counts) + 1), chunk % (len(own.counts) + 1)
        links = own.code_at[number + 1] - own.code_at[number]
        codes = own.codes[ragged(own.code_at[number], links)]
        space = len(own.a.spelling) * own.base
        key, many = _summed(np.repeat(of, links) * space + codes, np.repeat(often, links))
        keys.append(key)
        times.append(many)
    if len(keys) > 1:
        keys, times = _summed(np.concatenate(keys), np.concatenate(times))
    else:
        keys, times = (keys[0], times[0]) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
    space = len(own.a.spelling) * own.base
    of = keys // space
    keep = fine[of]
    counts[~fine] = 0
    names = [digests[k][1].hexdigest() if k in digests and ok else "" for k, ok in enumerate(fine.tolist())]
    return counts, names, of[keep], (keys % space)[keep], times[keep]


def _first_pass(a_path: str, b_path: str):
    def run(batches):
        own = aligner(a_path, b_path)
        pairs, documents = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in streamed(batches):
            buf, offs = buffers(batch.column("text"))
            row_no = batch.column("row_no").to_numpy()
            for i, j in slices(offs, PACK):
                counts, names, of, codes, times = document_rows(own, buf, offs[i : j + 1])
                yield _rows(j - i, row_no=row_no[i:j], doc_id=batch.column("doc_id").slice(i, j - i), n_a=counts[:, 0], n_b=counts[:, 1], n_groups=counts[:, 2], n_links=counts[:, 3], groups_sha256=names)
                if not len(codes):
                    continue
                texts, many = np.unique(of, return_counts=True)
                yield _rows(1, rows=[_packed(row_no[i:j][texts])], many=[_packed(many)], codes=[_packed(codes)], times=[_packed(times)], n_rows=[len(texts)], n_codes=[len(codes)])
                pairs, documents = _summed(np.concatenate([pairs, codes]), np.concatenate([documents, np.ones(len(codes))]))
                if len(pairs) > PAIRS:
                    yield _rows(1, pairs=[pairs], documents=[documents])
                    pairs, documents = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(pairs):
            yield _rows(1, pairs=[pairs], documents=[documents])

    return run


def _slice_rows(base: int, parts: int, pieces: int):
    """Packs, cut by slices of A ids; each goes to a piece of its slice's task."""

    def run(batches):
        for batch in batches:
            for rows, many, codes, times, n, m in zip(*(batch.column(c).to_pylist() for c in ("rows", "many", "codes", "times", "n_rows", "n_codes")), strict=True):
                rows = _unpacked(rows, n)
                of, codes, times = np.repeat(np.arange(n), _unpacked(many, n)), _unpacked(codes, m), _unpacked(times, m)
                out = []
                for k in range(parts):
                    sel = np.flatnonzero(codes // base % parts == k) if parts > 1 else np.arange(m)
                    if len(sel):
                        texts, own = np.unique(of[sel], return_counts=True)
                        out.append((k, int(rows[0]) % pieces, 1, _packed(rows[texts]), _packed(own), _packed(codes[sel]), _packed(times[sel]), len(texts), len(sel)))
                kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], ["slice", "piece", "side", "rows", "many", "codes", "times", "n_rows", "n_codes"])

    return run


SLICED = "slice int, piece int, side int, rows binary, many binary, codes binary, times binary, n_rows int, n_codes int"


def _slice_counts(batches):
    """Sorted (slice, code, documents, best) rows as rows of packed arrays, one or more a slice."""
    for batch in batches:
        k, codes, documents, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slice", "code", "documents", "best"))
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        out = [(int(k[i]), 0, _packed(codes[i:j]), _packed(documents[i:j]), _packed(best[i:j].astype(np.int64)), j - i) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate([pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()])], ["slice", "side", "codes", "times", "many", "n_codes"])


def _look_up(batches):
    now, held = None, None
    for batch in streamed(batches):
        out = []
        for k, piece, side, rows, many, codes, times, n, m in zip(*(batch.column(c).to_pylist() for c in ("slice", "piece", "side", "rows", "many", "codes", "times", "n_rows", "n_codes")), strict=True):
            if (k, piece) != now:
                now, held, counts = (k, piece), [], None
            if side == 0:
                held.append((_unpacked(codes, m), _unpacked(times, m), _unpacked(many, m)))
                continue
            if counts is None:
                counts = [np.concatenate(x) for x in zip(*held, strict=True)]
                order = np.argsort(counts[0])
                counts, held = [x[order] for x in counts], []
            of, times, spot = np.repeat(np.arange(n), _unpacked(many, n)), _unpacked(times, m), np.searchsorted(counts[0], _unpacked(codes, m))
            best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(best, of, times * counts[2][spot])
            np.add.at(total, of, times * counts[1][spot])
            out.append((_unpacked(rows, n), best, total))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row_no", "n_best", "count_sum"])


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Alignment:
    """The first pass over a table, written down; pair_counts() and documents() read it."""

    def __init__(self, docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"):
        a_path, b_path = a_path or default_paths()[0], b_path or default_paths()[1]
        self.spark, self.scratch = docs.sparkSession, Scratch(docs.sparkSession)
        self.base = len(load(b_path).spelling)
        texts = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.first = self.scratch.keep(texts.mapInArrow(_first_pass(a_path, b_path), FIRST_SCHEMA), "first")

    def pair_counts(self) -> DataFrame:
        """Per pair of ids that are linked anywhere: a, b, documents, best (no other pair of this A id is in more documents)."""
        pairs = self.first.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "documents")).alias("p"))
        summed = pairs.select(F.col("p.pairs").alias("code"), F.col("p.documents").alias("documents")).groupBy("code").agg(F.sum("documents").alias("documents"))
        a = F.floor(F.col("code") / F.lit(self.base)).cast("int")
        one = summed.select(a.alias("a"), (F.col("code") % self.base).cast("int").alias("b"), "code", "documents")
        return one.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))  # an A id has as many pairs as B has pieces, at most

    def documents(self) -> DataFrame:
        """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        counts = self.scratch.keep(self.pair_counts().select("a", "code", "documents", "best"), "counts")
        n, shuffles = counts.count(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, -(-n // SLICE))
        pieces = max(1, -(-shuffles // parts))
        held = counts.select((F.col("a") % parts).cast("int").alias("slice"), "code", "documents", "best").repartition(min(parts, shuffles), "slice").sortWithinPartitions("slice", "code")
        held = held.mapInArrow(_slice_counts, "slice int, side int, codes binary, times binary, many binary, n_codes int").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        packs = self.first.filter("codes is not null").select("rows", "many", "codes", "times", "n_rows", "n_codes").mapInArrow(_slice_rows(self.base, parts, pieces), SLICED)
        both = packs.unionByName(held, allowMissingColumns=True).repartition(parts * pieces, "slice", "piece").sortWithinPartitions("slice", "piece", "side")
        sums = both.mapInArrow(_look_up, "row_no long, n_best long, count_sum long").groupBy("row_no").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        rows = self.first.filter("row_no is not null").select("row_no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        none = F.lit(0).cast("long")
        return rows.join(sums, "row_no", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves, one row each: doc_id, group_no, byte_from, byte_to (in space + text), a_ids, b_ids."""
    a_path, b_path = a_path or default_paths()[0], b_path or default_paths()[1]

    def run(batches):
        own = aligner(a_path, b_path)
        for batch in streamed(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = np.frombuffer(b" " + (text or "").encode(), np.uint8)
                fine, g = own.groups(raw, np.zeros(1, np.int64), np.array([len(raw)])) if text else (np.zeros(1, bool), None)
                if not fine[0]:
                    continue
                n, edges = len(g.byte_cut), lambda x: zip([0, *x.tolist()[:-1]], x.tolist(), strict=True)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([doc_id] * n, pa.int64()), "group_no": pa.array(range(n), pa.int64()),
                    "byte_from": pa.array([0, *g.byte_cut.tolist()[:-1]], pa.int64()), "byte_to": pa.array(g.byte_cut.tolist(), pa.int64()),
                    "a_ids": pa.array([g.a[i:j] for i, j in edges(g.a_cut)], pa.list_(pa.int32())), "b_ids": pa.array([g.b[i:j] for i, j in edges(g.b_cut)], pa.list_(pa.int32())),
                })

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, group_no long, byte_from long, byte_to long, a_ids array<int>, b_ids array<int>")


def op13_token_alignment(spark, sf_dir):
    return Alignment(table(spark, sf_dir, "documents")).documents()


QUERIES = {"op13_token_alignment": op13_token_alignment}
SQL: dict[str, str] = {}
