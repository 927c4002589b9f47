"""Circulant MinHash signatures over shingle hashes.

Two permutations of the 32-bit universe do all the work: ``sigma`` scatters the
shingles once, ``pi`` is read at circular shifts ``0, 1, .. K-1`` times a fixed
stride, so coordinate k of a signature is ``min(pi(sigma(x) + k * stride))``.
Both permutations are bijective integer mixers, so no table is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import replace
from typing import NamedTuple

import numpy as np

from ._tok import BLANK_SEPARATED, FOLD, Chunk, Hasher, chunks, mix64, pieces, same_bytes

_W = np.uint32
SHINGLE = 5
_STRIDE = 0x61C88647


def sigma(x: np.ndarray) -> np.ndarray:
    """First permutation, of the low 32 bits."""
    x = x ^ (x >> _W(16))
    x = x * _W(0x7FEB352D)
    x = x ^ (x >> _W(15))
    x = x * _W(0x846CA68B)
    return x ^ (x >> _W(16))


def pi(x: np.ndarray) -> np.ndarray:
    """Second permutation; works in place."""
    x ^= x >> _W(16)
    x *= _W(0x21F0AAAD)
    x ^= x >> _W(15)
    x *= _W(0x735A2D97)
    x ^= x >> _W(15)
    return x


class Shingled(NamedTuple):
    """The shingle sets of some consecutive rows."""

    row: int
    bounds: np.ndarray  # of each row's set in hashes
    hashes: np.ndarray  # sorted and distinct within a row, row after row
    at: np.ndarray  # the word where an occurrence of each begins
    sizes: np.ndarray  # different shingles of each row, by their words
    chunk: Chunk  # of folded bytes

    def length(self, row: int) -> int:
        """Words of a shingle of the row."""
        return int(min(SHINGLE, self.chunk.first[row + 1] - self.chunk.first[row]))

    def words(self, row: int) -> list[bytes]:
        return self.chunk.text(int(self.chunk.first[row]), int(self.chunk.first[row + 1]))

    def one(self, row: int) -> ShingleSet:
        """The set of one row, as a copy that outlives the chunk."""
        lo, hi, a, b = self.bounds[row], self.bounds[row + 1], *self.chunk.first[row : row + 2]
        if a == b:
            return ShingleSet(self.hashes[:0], self.at[:0], 0, 0, np.zeros(0, dtype=np.uint8), self.at[:0], self.at[:0])
        left, right = self.chunk.start[a], self.chunk.end[b - 1]
        return ShingleSet(
            self.hashes[lo:hi].copy(), self.at[lo:hi] - a, int(self.sizes[row]), self.length(row), self.chunk.buf[left:right].copy(),
            self.chunk.start[a:b] - left, self.chunk.end[a:b] - left,
        )


class ShingleSet(NamedTuple):
    hashes: np.ndarray
    at: np.ndarray
    size: int
    k: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def exact(self) -> set[tuple[bytes, ...]]:
        words = [self.buf[s:e].tobytes() for s, e in zip(self.start, self.end)]
        return _tuples(words)


def _tuples(words: list[bytes]) -> set[tuple[bytes, ...]]:
    k = min(SHINGLE, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def common(a: ShingleSet, b: ShingleSet) -> tuple[int, int, int]:
    """Sizes of both sets and of their intersection, by their words."""
    if a.k != b.k:
        return a.size, b.size, 0
    both = np.concatenate((a.hashes, b.hashes))
    order = np.argsort(both, kind="stable")
    equal = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    i, j = order[equal], order[equal + 1] - len(a.hashes)
    if len(a.hashes) == a.size and len(b.hashes) == b.size and _same(np.concatenate((a.buf, b.buf)), a.start, a.end, b.start + len(a.buf), b.end + len(a.buf), a.at[i], b.at[j], a.k).all():
        return a.size, b.size, len(equal)
    x, y = a.exact(), b.exact()
    return len(x), len(y), len(x & y)


def _same(buf, start, end, start2, end2, i, j, k: int) -> np.ndarray:
    """True where the k words from word i are those from word j of the second bounds."""
    steps = np.arange(k)
    i, j = (i[:, None] + steps).ravel(), (j[:, None] + steps).ravel()
    size, size2 = end[i] - start[i], end2[j] - start2[j]
    same = (size == size2) & same_bytes(pieces(buf), start[i], start2[j], np.minimum(size, size2))
    return same.reshape(-1, k).all(axis=1) if k else np.ones(0, dtype=bool)


def shingle_sets(column, hasher: Hasher) -> Iterator[Shingled]:
    """The sets of every row of a column, chunk by chunk.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a row with
    fewer than five words has its whole word sequence as its only shingle.
    Shingles of one hash in a row are compared by their words.
    """
    for c in chunks(column, BLANK_SEPARATED):
        c = replace(c, buf=FOLD[c.buf])
        words = hasher.words(c.buf, c.start, c.end, None)
        n = np.diff(c.first)
        count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        owner = np.repeat(np.arange(c.rows), count)
        skipped = np.cumsum(count) - count
        start = np.arange(int(count.sum())) - skipped[owner] + c.first[:-1][owner]
        shingles = hasher.windows(words, start, np.minimum(n, SHINGLE)[owner])
        order = np.lexsort((shingles, owner))
        shingles, start, owner = shingles[order], start[order], owner[order]
        fresh = np.ones(len(shingles), dtype=bool)
        fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
        sizes = np.bincount(owner[fresh], minlength=c.rows)
        again = np.flatnonzero(~fresh)
        for k in np.unique(np.minimum(n, SHINGLE)[owner[again]]).tolist():
            i = again[np.minimum(n, SHINGLE)[owner[again]] == k]
            for row in np.unique(owner[i[~_same(c.buf, c.start, c.end, c.start, c.end, start[i - 1], start[i], k)]]).tolist():
                sizes[row] = len(_tuples(c.text(int(c.first[row]), int(c.first[row + 1]))))
        yield Shingled(c.row, np.concatenate(([0], np.cumsum(np.bincount(owner[fresh], minlength=c.rows)))), shingles[fresh], start[fresh], sizes, c)


def signatures(shingles: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """rows x size coordinates, for rows whose sets are not empty."""
    spots = sigma((shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32))
    out = np.empty((len(bounds) - 1, size), dtype=np.uint32)
    for lo in range(0, len(bounds) - 1, 64):
        at = bounds[lo : lo + 65]
        part = spots[at[0] : at[-1]]
        for k in range(size):
            out[lo : lo + 64, k] = np.minimum.reduceat(pi(part + _W(_STRIDE * k & 0xFFFFFFFF)), at[:-1] - at[0])
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` coordinates, different between bands."""
    wide = signature.astype(np.uint64)
    key = np.zeros((len(wide), wide.shape[1] // rows), dtype=np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, r::rows] + np.uint64(1))
    return mix64(key + np.arange(key.shape[1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sequence_digests(sets: Shingled) -> list[bytes]:
    """SHA-256 of each row's words in order: rows of one digest have one set."""
    c = sets.chunk
    out = []
    for row in range(c.rows):
        a, b = int(c.first[row]), int(c.first[row + 1])
        # bytes.split() knows exactly the separators of the words: blank, and 9 to 13.
        out.append(hashlib.sha256(b" ".join(c.buf[c.start[a] : c.end[b - 1]].tobytes().split()) if a < b else b"").digest())
    return out
