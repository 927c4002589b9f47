"""Benchmark decontamination: token windows of documents against a broadcast hash set of benchmark n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from ._store import Scratch, without
from ._tok import ALNUM_RUNS, FOLD, Hasher, chunks, window_starts

NGRAM = 10
#: Bytes of benchmark text in one broadcast set, which takes about five times as many in each worker. Of a larger benchmark
#: only the windows that may occur in the documents are kept. Should these be larger still, they are scanned for in so many
#: passes, each written before the next begins, so that one set at a time is held.
BROADCAST_BYTES = 16 << 20
#: Bits of the broadcast bitmap that finds them (32 MB).
BITMAP = 1 << 28
_HASHER = Hasher(41)


class Table(NamedTuple):
    """Windows of one length by hash: window i is words[start[i]:end[i]], and stands in the items of[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    of: np.ndarray


@dataclass
class Windows:
    """All windows of some items, in arrays over their folded words, which one blank separates."""

    words: bytes
    names: list[str]
    tables: dict[int, Table]

    def items(self, k: int, spot: int, sequence: bytes) -> set[int] | None:
        """Items in which the sequence is a window; None where only its hash is. spot: the first window with its hash."""
        t, got = self.tables[k], None
        while True:
            if self.words[t.start[spot] : t.end[spot]] == sequence:
                got = (got or set()).union(t.of[t.first[spot] : t.first[spot + 1]].tolist())
            if spot + 1 == len(t.hashes) or t.hashes[spot + 1] != t.hashes[spot]:
                return got
            spot += 1


def _table(words: bytes, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> Table:
    order = np.lexsort((item, hashes))
    hashes, start, end, item = hashes[order], start[order], end[order], item[order]
    opens = np.ones(len(hashes), dtype=bool)
    for i in (np.flatnonzero(hashes[1:] == hashes[:-1]) + 1).tolist():
        opens[i] = words[start[i] : end[i]] != words[start[i - 1] : end[i - 1]]
    at = np.flatnonzero(opens)
    return Table(hashes[at], start[at].astype(np.uint32), end[at].astype(np.uint32), np.append(at, len(hashes)).astype(np.uint32), item.astype(np.int32))


def windows_of(items: list[tuple[str, str | None]], ngram: int = NGRAM) -> Windows:
    """All windows of the items; one of fewer than ngram words, but not none, is one window."""
    pieces, size, found = [], 0, {}
    for c in chunks(pa.array([text for _, text in items], pa.string()), ALNUM_RUNS, FOLD):
        hashes = _HASHER.words(c.buf, c.start, c.end, FOLD)
        lengths = c.end - c.start
        place = np.concatenate(([0], np.cumsum(lengths + 1)))
        piece = np.full(place[-1], 0x20, dtype=np.uint8)
        skipped = np.cumsum(lengths) - lengths
        inner = np.arange(int(lengths.sum()))
        piece[np.repeat(place[:-1] - skipped, lengths) + inner] = FOLD[c.buf[np.repeat(c.start - skipped, lengths) + inner]]
        n = np.diff(c.first)
        short = [(k, c.first[:-1][n == k], np.flatnonzero(n == k)) for k in range(1, ngram)]
        for k, start, owner in [*short, (ngram, *window_starts(c.first, ngram))]:
            if len(start):
                found.setdefault(k, []).append((_HASHER.windows(hashes, start, k), size + place[start], size + place[start + k] - 1, c.row + owner))
        pieces.append(piece.tobytes())
        size += len(piece)
    words = b"".join(pieces)
    return Windows(words, [name for name, _ in items], {k: _table(words, *map(np.concatenate, zip(*parts))) for k, parts in found.items()})


def _slices(benchmark: DataFrame, limit: int):
    """Rows (item, text) in lists of at most `limit` bytes of text, one row at least."""
    rows, size = [], 0
    for r in benchmark.toLocalIterator():
        more = len(r.text.encode())
        if rows and size + more > limit:
            yield rows
            rows, size = [], 0
        rows.append((r.item, r.text))
        size += more
    yield rows


def _item_windows(ngram: int):
    def run(batches):
        for batch in batches:
            found = windows_of(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), ngram)
            for k, t in found.tables.items():
                owner = np.repeat(np.arange(len(t.hashes)), np.diff(t.first.astype(np.int64)))
                words = [found.words[a:b].decode() for a, b in zip(t.start.tolist(), t.end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.hashes[owner].view(np.int64)), pa.array(np.full(len(owner), k)), pa.array([found.names[i] for i in t.of], pa.string()), pa.array([words[i] for i in owner], pa.string())],
                    names=["hash", "k", "item", "text"],
                )

    return run


def _occurring(docs: DataFrame, items: DataFrame, text_col: str, ngram: int, scratch: Scratch) -> DataFrame:
    """(item, text): the windows of a large benchmark that may occur in the documents, each as an item of its own.

    One scan of the documents against a bitmap of window hashes, of BITMAP bits
    whatever the benchmark's size, and a join of the few hashes that pass with the windows.
    """
    windows = scratch.write(items.mapInArrow(_item_windows(ngram), "hash long, k long, item string, text string"), "windows")
    lengths = [r.k for r in windows.select("k").distinct().collect()]  # ngram at most
    bit = F.pmod(F.col("hash"), F.lit(BITMAP)) + 1  # bitmap functions count from 1
    cells = windows.groupBy(F.bitmap_bucket_number(bit).alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow()  # BITMAP bits at most
    bits = np.zeros(BITMAP // 8 + 4096, dtype=np.uint8)
    for cell, part in zip(cells["cell"].to_pylist(), cells["bits"].to_pylist()):
        bits[(cell - 1) * 4096 : cell * 4096] = np.frombuffer(part, dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known = shared.value
        for batch in batches:
            for c in chunks(batch.column(0), ALNUM_RUNS, FOLD):
                hashes = _HASHER.words(c.buf, c.start, c.end, FOLD)
                found = [_HASHER.windows(hashes, window_starts(c.first, k)[0], k).view(np.int64) for k in lengths]
                keys = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
                at = keys % BITMAP
                yield pa.RecordBatch.from_arrays([pa.array(keys[known[at >> 3] >> (at & 7) & 1 == 1])], names=["hash"])

    hit = scratch.write(docs.select(text_col).mapInArrow(run, "hash long").distinct(), "hit")
    shared.destroy()
    return scratch.write(windows.join(hit, "hash", "left_semi").select("item", "text"), "occurring")


def _merge(ranges: np.ndarray) -> np.ndarray:
    """Sorted disjoint ranges that cover the same words."""
    if len(ranges) < 2:
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    opens = np.concatenate(([True], ranges[1:, 0] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(opens)[1:] - 1, [len(ranges) - 1]))
    return np.stack([ranges[opens, 0], reach[last]], axis=1)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The input's rows and columns, with hit_words (long count of words), hit_ranges and hit_items.

    hit_ranges is a flat array of word positions, start and end of each disjoint
    range in turn; hit_items the distinct items, sorted as strings. A null or
    empty text has no words and no hits, and an empty benchmark hits nothing.
    A nominated window counts only if its words are the item's. No shuffle.
    An empty table gives an empty result, repeated rows each get their hits, texts
    of any length are read whole, and columns of the added names are replaced.
    """
    docs = without(docs, "hit_words", "hit_ranges", "hit_items")
    names = docs.columns
    where = names.index(text_col)
    schema = StructType(list(docs.schema.fields)).add("hit_words", LongType()).add("hit_ranges", ArrayType(IntegerType())).add("hit_items", ArrayType(StringType()))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    with Scratch(docs.sparkSession, "decontaminate") as scratch:
        if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > broadcast_bytes:
            items = _occurring(docs, items, text_col, ngram, scratch)
        out, written, shared = docs, None, None
        for rows in _slices(items, broadcast_bytes):
            first = shared is None
            if not first:
                out = scratch.write(out, "pass")
                shared.destroy()
                if written is not None:
                    scratch.drop(written)
                written = out
            shared = docs.sparkSession.sparkContext.broadcast(windows_of(rows, ngram))
            out = out.mapInArrow(_pass(shared, names, where, first), schema)
        if written is not None:
            scratch.keep(written)
    return out


def _pass(shared, names: list[str], where: int, first: bool):
    def run(batches):
        windows = shared.value
        for batch in batches:
            texts = batch.column(where)
            n = len(texts)
            earlier = None if first else (batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2).to_pylist())
            total, ranges, items = np.zeros(n, dtype=np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            for c in chunks(texts, ALNUM_RUNS, FOLD):
                total[c.row : c.row + c.rows] = np.diff(c.first)
                hashes = _HASHER.words(c.buf, c.start, c.end, FOLD)
                hits: dict[int, tuple[list, set]] = {}
                for k, known in windows.tables.items():
                    start, owner = window_starts(c.first, k)
                    keys = _HASHER.windows(hashes, start, k)
                    spot = np.minimum(np.searchsorted(known.hashes, keys), len(known.hashes) - 1)
                    for i in np.flatnonzero(known.hashes[spot] == keys).tolist():
                        at, row = int(start[i]), int(owner[i])
                        of = windows.items(k, int(spot[i]), b" ".join(c.text(at, at + k)).lower())
                        if of is not None:
                            got = hits.setdefault(row, ([], set()))
                            got[0].append((at - int(c.first[row]), at - int(c.first[row]) + k))
                            got[1].update(of)
                for row, (spans, of) in hits.items():
                    ranges[c.row + row], items[c.row + row] = _merge(np.array(spans)).ravel().tolist(), sorted({windows.names[i] for i in of})
            if earlier:
                for i in range(n):
                    if earlier[0][i]:
                        ranges[i] = _merge(np.array(ranges[i] + earlier[0][i]).reshape(-1, 2)).ravel().tolist()
                        items[i] = sorted({*items[i], *earlier[1][i]})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(total), pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=[*names, "hit_words", "hit_ranges", "hit_items"],
            )

    return run


def n_hit(ranges):
    """Words covered by a hit_ranges column."""
    return F.aggregate(ranges, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("sign")), lambda acc, x: F.struct((acc["n"] + acc["sign"] * x).alias("n"), (-acc["sign"]).alias("sign")), lambda acc: acc["n"].cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """The input's columns; documents with hits are dropped, or in mode "spans" lose the hit words and what lies between them."""
    # Own names, so that columns of docs named like findings stay.
    hidden = {c: f"__sg_{c}" for c in ("hit_words", "hit_ranges", "hit_items")}
    back = {v: k for k, v in hidden.items()}
    found = scan(docs.withColumnsRenamed(hidden), benchmark, text_col, **options)
    if mode == "documents":
        return found.where(F.size("hit_ranges") == 0).drop(*hidden).withColumnsRenamed(back).select(*docs.columns)
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    names = found.columns
    where, ranges_at = names.index(text_col), names.index("hit_ranges")

    def cut(batches):
        for batch in batches:
            texts, ranges = batch.column(where), batch.column(ranges_at).to_pylist()
            out = texts.to_pylist()
            for c in chunks(texts, ALNUM_RUNS, FOLD):
                for row in range(c.rows):
                    spans = ranges[c.row + row]
                    if spans:
                        base, keep, at = int(c.first[row]), [], None
                        raw = out[c.row + row].encode()
                        shift = int(c.start[base]) - _first_word(raw)
                        at = 0
                        for lo, hi in zip(spans[::2], spans[1::2]):
                            keep.append(raw[at : int(c.start[base + lo]) - shift])
                            at = int(c.end[base + hi - 1]) - shift
                        out[c.row + row] = b"".join([*keep, raw[at:]]).decode()
            columns = list(batch.columns[: len(docs_names)])
            columns[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return found.mapInArrow(cut, docs.schema)


def _first_word(raw: bytes) -> int:
    table = ALNUM_RUNS[FOLD]
    return int(np.argmax(table[np.frombuffer(raw, dtype=np.uint8)]))
