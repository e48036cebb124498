"""Vectorised tokenising of Arrow text columns, shared by the text operators.

Texts stay in Arrow's own buffers.  Word bounds and hashes are computed with
numpy over blocks of bounded size, cut between words; a text of any length is
read whole.  The temporaries follow the block, the results (bounds and hashes
of all words) follow the slice of texts, or the text where one is longer.

A word's hash is 128 bits in two independent halves, `hashes` and `checks`:
eight bytes at a time go through multiply-and-shift steps that are bijections
of the state, so words of up to eight bytes and equal length never share a
hash; words of over LONG_WORD bytes take theirs from BLAKE2.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that stand in words once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_ASCII_ALNUM = ALNUM & (np.arange(256) < 128)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)


def hash_words(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hashes of the words b[starts:ends]; they depend on a word's bytes alone."""
    if not len(starts):
        return np.empty(0, _U), np.empty(0, _U)
    eight = np.ndarray(len(b) + 1, "<u8", np.concatenate([b, np.zeros(8, np.uint8)]), strides=(1,))
    left = ends - starts
    h, g = left.astype(_U) * _U(0x9E3779B97F4A7C15), left.astype(_U) * _U(0xC2B2AE3D27D4EB4F)
    g ^= _U(0x165667B19E3779F9)
    long = np.flatnonzero(left > LONG_WORD)
    live, at = None, starts
    if len(long):
        live = np.flatnonzero(left <= LONG_WORD)
        at, left = starts[live], left[live]
    while len(at):
        x = eight[at] & _FIRST_BYTES[np.minimum(left, 8)]
        u, v = (h, g) if live is None else (h[live], g[live])
        u = (u ^ x) * _U(0xBF58476D1CE4E5B9)
        u ^= u >> _U(29)
        v = (v + x) * _U(0xD6E8FEB86659FD93)
        v ^= v >> _U(32)
        if live is None:
            h, g = u, v
        else:
            h[live], g[live] = u, v
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    h, g = mix(h), mix(g)
    for k in long.tolist():
        d = hashlib.blake2b(b[starts[k] : ends[k]].tobytes(), digest_size=16).digest()
        h[k], g[k] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")
    return h, g


@dataclass
class Words:
    """Words of some texts: byte bounds in buf, both halves of their hashes, and for each text the range of its words."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    checks: np.ndarray
    offsets: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def _cut(buf: np.ndarray, offs: np.ndarray, at: int, is_word: np.ndarray) -> int:
    """The first place from `at` on where no word is cut."""
    n = len(buf)
    k = int(np.searchsorted(offs, at))
    nearest = int(offs[k]) if k < len(offs) else n
    while at < nearest:
        gap = np.flatnonzero(~is_word[LOWER[buf[at : min(at + 65536, nearest)]]])
        if len(gap):
            return at + int(gap[0])
        at = min(at + 65536, nearest)
    return nearest


def words_of(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = ALNUM, cut_tail: bool = False) -> Words:
    """Words of the texts buf[offs[i]:offs[i + 1]], A-Z lower-cased.

    cut_tail: a comma or full stop that ends a word after an ASCII letter or digit is a word of its own.
    """
    starts, ends, hashes, checks = [], [], [], []
    lo, n = int(offs[0]), int(offs[-1])
    while lo < n:
        hi = n if n - lo <= BLOCK else _cut(buf, offs, lo + BLOCK, is_word)
        b = LOWER[buf[lo:hi]]
        w = is_word[b]
        m = hi - lo
        edge = np.zeros(m + 1, bool)
        edge[offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi, "right")] - lo] = True
        edge[0] = edge[m] = True
        before = np.empty(m, bool)
        before[0] = False
        before[1:] = w[:-1]
        after = np.empty(m, bool)
        after[-1] = False
        after[:-1] = w[1:]
        if cut_tail:
            tail = np.flatnonzero(((b == 44) | (b == 46)) & (~after | edge[1:]))
            tail = tail[tail > 0]
            edge[tail[_ASCII_ALNUM[b[tail - 1]]]] = True
        s = np.flatnonzero(w & (~before | edge[:m]))
        e = np.flatnonzero(w & (~after | edge[1:])) + 1
        if len(s):
            h, g = hash_words(b, s, e)
            starts.append(s + lo)
            ends.append(e + lo)
            hashes.append(h)
            checks.append(g)
        lo = hi
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    st = cat(starts, np.int64)
    return Words(buf, st, cat(ends, np.int64), cat(hashes, _U), cat(checks, _U), np.searchsorted(st, offs))


def _release() -> None:
    """Gives memory that was freed back to the system: a worker lives on between tasks, and its executor's limit counts it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def streamed(batches: Iterable) -> Iterator:
    """Batches one by one; what each left behind is released before the next."""
    for batch in batches:
        yield batch
        del batch
        _release()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offs


def slices(offs: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or of one longer text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def text_slices(batches, column: str, is_word: np.ndarray = ALNUM, most: int = 2 << 20):
    """For Arrow batches: (batch, first row, last row + 1, Words)."""
    for batch in streamed(batches):
        buf, offs = buffers(batch.column(column))
        for i, j in slices(offs, most):
            yield batch, i, j, words_of(buf, offs[i : j + 1], is_word)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ..."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths) or not lengths.sum():
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(np.asarray(starts, np.int64) - ends + lengths, lengths)
