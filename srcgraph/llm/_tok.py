"""Vectorised word and shingle hashing over Arrow string columns.

Everything works on UTF-8 bytes: the word patterns of the operators only name
ASCII characters, so a byte table classifies exactly and multi-byte characters
always stay inside words.  Hashes of words and of windows only nominate:
operators confirm on the bytes of the words themselves, with `same_bytes`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; bounds the temporary arrays of a Python worker.
CHUNK_BYTES = 1 << 18

_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit values."""
    start = (seed * 0xD1342543DE82EF95 + 1) & _MASK
    with np.errstate(over="ignore"):
        return mix64(_U(start) + np.arange(1, n + 1, dtype=np.uint64) * _U(_GOLDEN))


def byte_table(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: Words ``[^\x20\x09-\x0D]+``.
BLANK_SEPARATED = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, of lower-cased text: digits, letters and all beyond ASCII.
ALNUM_RUNS = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


#: Keeps the first n bytes of a little-endian 64-bit number.
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def pieces(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf as one number; beyond the end are zeros."""
    data = np.zeros(len(buf) + 8, dtype=np.uint8)
    data[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, dtype="<u8", buffer=data, strides=(1,))


def same_bytes(wide: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """True where the `length` bytes from a are those from b; wide: pieces() of their buffer."""
    out = np.ones(len(a), dtype=bool)
    left, at = np.flatnonzero(length > 0), 0
    while len(left):
        keep = _FIRST_BYTES[np.minimum(length[left] - at, 8)]
        equal = (wide[a[left] + at] ^ wide[b[left] + at]) & keep == 0
        out[left[~equal]] = False
        at += 8
        left = left[equal & (length[left] > at)]
    return out


class Hasher:
    """One family of word and window hashes, fixed by its seed.

    A word's pieces of eight bytes are each mixed with a key of their position
    before they are added, and a window's words are multiplied by a random odd
    number for each position: no sum of equal terms cancels, whatever the pattern
    in which words or bytes repeat.
    """

    def __init__(self, seed: int):
        self.seed = seed
        self.salt = int(seeded(seed, 1)[0])
        self.factors = seeded(seed + 1, 64) | _U(1)

    def _key(self, k: np.ndarray | int) -> np.ndarray:
        return mix64(_U(self.salt) + np.asarray(k, dtype=np.uint64) * _U(_GOLDEN))

    def words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
        wide, length = pieces(buf if fold is None else fold[buf]), end - start
        with np.errstate(over="ignore"):
            total = mix64((wide[start] & _FIRST_BYTES[np.minimum(length, 8)]) ^ self._key(0))
            long = np.flatnonzero(length > 8)
            if len(long):
                more = (length[long] - 1) // 8
                owner = np.repeat(np.arange(len(long)), more)
                first = np.cumsum(more) - more
                k = np.arange(len(owner)) - first[owner] + 1
                keep = _FIRST_BYTES[np.minimum(length[long][owner] - 8 * k, 8)]
                total[long] += np.add.reduceat(mix64((wide[start[long][owner] + 8 * k] & keep) ^ self._key(k)), first)
            return mix64(total + length.astype(np.uint64) * _U(_GOLDEN))

    def windows(self, words: np.ndarray, start: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        """Of k consecutive words from each start."""
        if not np.isscalar(k):
            out = np.zeros(len(start), dtype=np.uint64)
            for n in np.unique(k).tolist():
                out[k == n] = self.windows(words, start[k == n], n)
            return out
        size = len(words) - k + 1
        if size <= 0 or not len(start):
            return np.zeros(len(start), dtype=np.uint64)
        with np.errstate(over="ignore"):
            if k > len(self.factors):
                self.factors = seeded(self.seed + 1, 2 * k) | _U(1)
            raw = words[:size] * self.factors[0]
            for j in range(1, k):
                raw += words[j : j + size] * self.factors[j]
            return mix64(raw + _U(k) * _U(_GOLDEN))[start]


@dataclass
class Chunk:
    """The words of some consecutive rows: bytes, word bounds, and each row's range of words."""

    row: int
    rows: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # rows + 1 bounds into start

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.buf[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j])]

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes with one blank for whatever stands between two words of a row, and where words then start and end."""
        inside = np.zeros(len(self.buf) + 1, dtype=np.int8)
        np.add.at(inside, self.start, 1)
        np.add.at(inside, self.end, -1)
        word = np.cumsum(inside[:-1]) > 0
        keep = word.copy()
        keep[1:] |= word[:-1]
        place = np.concatenate(([0], np.cumsum(keep)))
        return np.where(word, self.buf, np.uint8(0x20))[keep].tobytes(), place[self.start], place[self.end - 1] + 1


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most limit bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def chunks(column: pa.Array, table: np.ndarray, fold: np.ndarray | None = None) -> Iterator[Chunk]:
    """Words of every row. fold is only used to tell words from separators."""
    data, offsets = string_bytes(column)
    is_word = table if fold is None else table[fold]
    for lo, hi in row_groups(offsets):
        buf, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        inside = is_word[buf]
        n = len(buf)
        if n == 0:
            none = np.zeros(0, dtype=np.int64)
            yield Chunk(lo, hi - lo, buf, none, none, np.zeros(hi - lo + 1, dtype=np.int64))
            continue
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = at[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Chunk(lo, hi - lo, buf, start, end, np.searchsorted(start, at))


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window of k words inside one row, and the row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    skipped = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, dtype=np.int64)
    return np.arange(int(counts.sum())) - skipped[owner] + first[:-1][owner], owner


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
