"""Words and word shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of ASCII letters, digits, underscores and characters beyond ASCII.
Texts are expected in lower case."""

from __future__ import annotations

import numpy as np

WORD_PATTERN = "[0-9a-z_\\x80-\\U0010ffff]+"
SHINGLE = 5

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POS = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them; kept by the worker."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        size = 1 << max(17, int(n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(p, out=p)
        if size <= 1 << 20:
            _powers[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def runs(data: np.ndarray, offsets: np.ndarray, of_run: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that of_run marks, none across texts, and the n + 1 offsets of each text's runs."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = of_run[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = inside[cuts]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length in bytes of every word, and the n + 1 offsets of each text's words."""
    start, end, at = runs(data, offsets)
    return hashes_of(data, start, end), end - start, at


def shingles(hashes: np.ndarray, word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of five words, in order, and their n + 1 offsets.

    A text of one to four words has one shingle, of all its words; a text without words has none."""
    counts = np.diff(word_offsets)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(offsets[-1]) + np.repeat(word_offsets[:-1] - offsets[:-1], n)
    have = np.repeat(counts, n)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    short = bool((have < SHINGLE).any())
    for k in range(SHINGLE):
        w = padded[at + k] * _POS[k]
        out += np.where(k < have, w, _U(0)) if short else w
    return mix(out), offsets


def runs_of(hashes: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words (under five), as shingles() has them for a text of n words, and their offsets."""
    counts = np.maximum(np.diff(word_offsets) - n + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(offsets[-1]) + np.repeat(word_offsets[:-1] - offsets[:-1], counts)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out += hashes[at + k] * _POS[k]
    return mix(out), offsets
