"""Hashed byte features of words, computed for many words at once."""

from __future__ import annotations

import numpy as np

from regolith.llm.text import LOWER, Words, mix, ragged

_U = np.uint64


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct words, and for each word the number of its distinct one."""
    _, first, number = np.unique(w.hashes, return_index=True, return_inverse=True)
    return first, number


def affix(w: Words, which: np.ndarray, size: int, end: bool) -> np.ndarray:
    """Hashes of the first (end: last) `size` bytes of words; 0 for shorter words."""
    s, e = w.starts[which], w.ends[which]
    fits = e - s >= size
    base = np.where(fits, e - size if end else s, 0)
    h = np.full(len(which), size * 2 + end + 1, _U)
    for k in range(size):
        h = h * _U(0x100000001B3) + LOWER[w.buf[np.minimum(base + k, len(w.buf) - 1)]].astype(_U) + _U(1)
    return np.where(fits, mix(h), _U(0))


def grams(w: Words, which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` bytes of words, and how many each word has."""
    s, e = w.starts[which], w.ends[which]
    many = np.maximum(e - s - size + 1, 0)
    at = ragged(s, many)
    h = np.full(len(at), 1000 + size, _U)
    for k in range(size):
        h = h * _U(0x100000001B3) + LOWER[w.buf[at + k]].astype(_U) + _U(1)
    return mix(h), many
