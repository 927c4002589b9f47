"""Substring deduplication through a log-structured index of window fingerprints.

A window is 13 consecutive words. Its fingerprint is the least hash of the nine
5-word grams in it, so neighbouring windows mostly share theirs and equal
windows always do. Each batch of documents leaves one immutable run of
(fingerprint, document, windows), sorted within hash buckets; runs are
merge-joined without a shuffle, and compaction folds them into one. Windows
under a fingerprint of two or more documents are then compared by their words.
Fingerprints of very many windows go another way, with partial minima ahead of
the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ._runs import SortedRuns
from ._store import WHILE_WRITING, Scratch, partitions, settings, without
from ._tok import BLANK_SEPARATED, Hasher, chunks, pieces, same_bytes, sliding_min, string_bytes, window_starts

WINDOW, GRAM = 13, 5
#: A fingerprint of so many windows is frequent. Below, its windows are held in one task: some 25 bytes of words and 40 of
#: numbers each, so 13 MB.
FREQUENT = 200_000
#: Windows of one row between tasks at most.
ROW_WINDOWS = 64
#: Least identifiers of frequent windows that may be broadcast (some 200 bytes each).
BROADCAST_ROWS = 100_000
BATCHES = 2
#: Runs from which on an index compacts by itself.
FAN = 8
_GRAMS, _WINDOWS = Hasher(57), Hasher(91)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _least_grams(c, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, row and fingerprint of each window of a chunk."""
    start, owner = window_starts(c.first, WINDOW)
    if not len(start):
        return start, owner, np.zeros(0, dtype=np.uint64)
    at, _ = window_starts(c.first, GRAM)
    grams = np.zeros(len(words), dtype=np.uint64)
    grams[at] = _GRAMS.windows(words, at, GRAM)
    return start, owner, sliding_min(grams, WINDOW - GRAM + 1)[start]


def _fingerprints(batches):
    """Distinct (fingerprint, id), with the number of windows."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for c in chunks(batch.column(1), BLANK_SEPARATED):
            _, owner, print_ = _least_grams(c, _GRAMS.words(c.buf, c.start, c.end, None))
            if not len(print_):
                continue
            order = np.lexsort((print_, owner))
            print_, owner = print_[order], owner[order]
            fresh = np.ones(len(print_), dtype=bool)
            fresh[1:] = (print_[1:] != print_[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(fresh)
            many = np.diff(np.append(first, len(print_)))
            yield pa.RecordBatch.from_arrays([pa.array(print_[first].view(np.int64)), pa.array(ids[c.row + owner[first]]), pa.array(many)], names=["print", "id", "windows"])


class RunIndex(SortedRuns):
    """Sorted runs of (print, id, windows).

    A stored index takes further batches and then answers as one batch of all
    would; it keeps the documents of each batch beside its run. Without a path
    the caller keeps the documents.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        super().__init__(spark, "prints", "print BIGINT, id BIGINT, windows BIGINT", "print", path, buckets)

    def append(self, docs: DataFrame) -> None:
        """Flushes a batch (id, text) as a run."""
        if self.stored:
            with settings(self.spark, WHILE_WRITING):
                docs.select("id", "text").write.mode("append").parquet(f"{self.path}/documents")
        self.flush(docs.select("id", "text").mapInArrow(_fingerprints, "print long, id long, windows long"))
        if self.stored and len(self.runs) >= FAN:
            self.compact()

    def documents(self) -> DataFrame:
        return self.spark.read.schema("id long, text string").parquet(f"{self.path}/documents")

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            rows = reduce(DataFrame.unionByName, self.tables())
            self.replace(rows.groupBy("print", "id").agg(F.max("windows").alias("windows")))

    def counts(self) -> DataFrame:
        """(print, docs, windows) over all runs: each is counted within its buckets, then merge-joined with the history."""
        history = None
        for run in self.tables():
            counts = run.groupBy("print").agg(F.count("*").alias("docs"), F.sum("windows").alias("windows"))
            if history is None:
                history = counts
            else:
                both = history.hint("merge").join(counts.withColumnsRenamed({"docs": "docs2", "windows": "windows2"}), "print", "full_outer")
                add = lambda a: (F.coalesce(a, F.lit(0).cast("long")) + F.coalesce(f"{a}2", F.lit(0).cast("long"))).alias(a)
                history = both.select("print", add("docs"), add("windows"))
        return history

    def hits(self) -> DataFrame:
        """(id, hits): the fingerprints of each document that another has too, and whether they are frequent."""
        if not self.runs:
            return self.spark.createDataFrame([], "id long, hits array<struct<print: bigint, often: boolean>>")
        repeated = self.beside(self.counts().where("docs > 1").select("print", (F.col("windows") >= FREQUENT).alias("often")), "repeated", deal=False)
        parts = [run.select("print", "id").hint("merge").join(repeated, "print").select("id", F.struct("print", "often").alias("hit")) for run in self.tables()]
        return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.collect_set("hit").alias("hits"))


def _candidates(batches):
    """Windows under one repeated fingerprint: (print, id, text print, first window, words one blank apart, frequent)."""
    for batch in batches:
        ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lists = batch.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        prints, often = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        for c in chunks(batch.column(2), BLANK_SEPARATED):
            start, owner, print_ = _least_grams(c, _GRAMS.words(c.buf, c.start, c.end, None))
            lo, hi = bounds[c.row], bounds[c.row + c.rows]
            if not len(start) or lo == hi:
                continue
            # One sorted list for all rows: a row's fingerprints are shifted by a number of its own.
            known = prints[lo:hi] + np.repeat(np.arange(c.rows), sizes[c.row : c.row + c.rows]).astype(np.uint64) * _SPREAD
            order = np.argsort(known)
            sought = print_ + owner.astype(np.uint64) * _SPREAD
            spot = np.minimum(np.searchsorted(known[order], sought), len(known) - 1)
            hit = known[order][spot] == sought
            if not hit.any():
                continue
            s, o, p, f = start[hit], owner[hit], print_[hit], often[lo:hi][order][spot[hit]]
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1] + 1) | (o[1:] != o[:-1]) | (p[1:] != p[:-1])
            run = np.flatnonzero(new)
            new[np.arange(len(s)) - run[np.cumsum(new) - 1] & (ROW_WINDOWS - 1) == 0] = True
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(s)) - 1
            text, begin, end = c.spaced()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p[first].view(np.int64)), pa.array(ids[c.row + o[first]]), pa.array(marks[c.row + o[first]]),
                    pa.array((s[first] - c.first[o[first]]).astype(np.int32)),
                    pa.array([text[a:b] for a, b in zip(begin[s[first]].tolist(), end[s[last] + WINDOW - 1].tolist())], pa.binary()), pa.array(f[first]),
                ],
                names=["print", "id", "mark", "at", "words", "often"],
            )


def _judge(batches):
    """Rows sorted by print: word ranges (id, mark, lo, hi) of windows that also start in a document with a smaller id."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).combine_chunks()
        if held is not None and len(held):
            rows = pa.concat_tables([held, rows]).combine_chunks()
        if not len(rows):
            continue
        prints = rows["print"].to_numpy()
        cut = int(np.searchsorted(prints, prints[-1]))
        held = rows.slice(cut)
        if cut:
            yield from _ranges(rows.slice(0, cut))
    if held is not None and len(held):
        yield from _ranges(held)


def _ranges(rows: pa.Table):
    column = rows["words"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    data, offsets = string_bytes(column)
    parts = []
    for c in chunks(column, BLANK_SEPARATED):
        start, owner = window_starts(c.first, WINDOW)
        hashes = _WINDOWS.windows(_WINDOWS.words(c.buf, c.start, c.end, None), start, WINDOW)
        parts.append((hashes, c.row + owner, start - c.first[owner], offsets[c.row] + c.start[start], offsets[c.row] + c.end[start + WINDOW - 1]))
    hashes, owner, nth, begin, end = (np.concatenate(x) for x in zip(*parts))
    prints, ids, at = rows["print"].to_numpy(), rows["id"].to_numpy(), rows["at"].to_numpy()
    order = np.lexsort((hashes, prints[owner]))
    h, p, b, e = hashes[order], prints[owner][order], begin[order], end[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    again = np.flatnonzero(~new)
    size = e - b
    wide = pieces(data)
    alike = (size[again] == size[again - 1]) & same_bytes(wide, b[again], b[again - 1], np.minimum(size[again], size[again - 1]))
    if alike.all():
        least = np.minimum.reduceat(ids[owner][order], np.flatnonzero(new))
        hit = np.zeros(len(h), dtype=bool)
        hit[order] = ids[owner][order] > least[np.cumsum(new) - 1]
    else:
        # Different words under one hash: they are told apart by the words themselves.
        words = [data[x:y].tobytes() for x, y in zip(begin, end)]
        lowest: dict = {}
        for word, i in zip(words, ids[owner].tolist()):
            lowest[word] = min(lowest.get(word, i), i)
        hit = ids[owner] > np.array([lowest[word] for word in words])
    s, o = (nth + at[owner])[hit], owner[hit]
    if not len(s):
        return
    opens = np.ones(len(s), dtype=bool)
    opens[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(s)) - 1
    marks = rows["mark"].to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array(ids[o[first]]), pa.array(marks[o[first]]), pa.array(s[first].astype(np.int32)), pa.array((s[last] + WINDOW).astype(np.int32))], names=["id", "mark", "lo", "hi"])


def judged(index: RunIndex, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, mark, ranges) of the documents (id, text) of all batches of an index that have words to remove."""
    spark = rows.sparkSession
    hits = scratch.write(index.hits(), "hits")
    index.forget("repeated")
    texts = rows.join(hits, "id").select("id", F.xxhash64("text").alias("mark"), "text", "hits")
    found = scratch.write(texts.mapInArrow(_candidates, "print long, id long, mark long, at int, words binary, often boolean"), "candidates")
    scratch.drop(hits)
    rare = found.where("NOT often").select("print", "id", "mark", "at", "words").repartition(partitions(spark), "print").sortWithinPartitions("print")
    ranges = rare.mapInArrow(_judge, "id long, mark long, lo int, hi int")
    words = F.split(F.col("words").cast("string"), " ")
    frequent = found.where("often").select("id", "mark", "at", words.alias("words"))
    each = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda k: F.array_join(F.slice("words", k, WINDOW), " "))
    frequent = frequent.select("id", "mark", "at", F.posexplode(each).alias("k", "window"))
    least = scratch.write(frequent.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most"), "least")
    later = frequent.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, "window").where("id > least")
    ranges = ranges.unionByName(later.select("id", "mark", (F.col("at") + F.col("k")).alias("lo"), (F.col("at") + F.col("k") + WINDOW).alias("hi")))
    return scratch.write(ranges.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, mark, ranges) of documents with words to remove; mark is xxhash64 of the text, ranges an array of (lo, hi) in words."""
    spark = docs.sparkSession
    rows = _documents(docs, id_col, text_col)
    with Scratch(spark, "substring") as scratch, RunIndex(spark) as index:
        for batch in range(batches):
            index.append(rows.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch))
        return scratch.keep(judged(index, rows, scratch))


def add_batch(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds a batch to the stored index at `path` and returns (id, mark, ranges) over the documents of all batches, as one batch of all would give.

    Documents that come with larger identifiers than those before change none of the earlier answers.
    """
    with Scratch(spark, "substring") as scratch, RunIndex(spark, path) as index:
        index.append(_documents(docs, id_col, text_col))
        return scratch.keep(judged(index, index.documents(), scratch))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """The input's rows and columns, with n_words, n_removed and kept_text (kept words joined by one space).

    A word goes when a window of 13 words over it also starts in a document with
    a smaller identifier (an integer); windows are judged on the input, whole
    texts of any length. A null text has no words and an empty kept_text, as has
    an empty one; rows with a null identifier are kept whole. Rows that repeat
    under one identifier are one document, which never repeats itself. An empty
    table gives an empty result. Further columns stay, but columns of the added
    names are replaced.
    """
    docs = without(docs, "n_words", "n_removed", "kept_text")
    names = docs.columns
    ranges = repeated_ranges(docs, id_col, text_col, batches).withColumnsRenamed({"id": "__sg_id", "mark": "__sg_mark", "ranges": "__sg_ranges"})
    joined = docs.join(ranges, (F.col(id_col).cast("long") == F.col("__sg_id")) & (F.xxhash64(text_col) == F.col("__sg_mark")), "left").select(*[docs[c] for c in names], "__sg_ranges")
    where = names.index(text_col)
    schema = StructType(list(docs.schema.fields)).add("n_words", LongType()).add("n_removed", LongType()).add("kept_text", StringType())

    def cut(batches):
        for batch in batches:
            lists = batch.column(len(names))
            total, gone, kept = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64), []
            for c in chunks(batch.column(where), BLANK_SEPARATED):
                for row in range(c.rows):
                    lo, hi = int(c.first[row]), int(c.first[row + 1])
                    keep = np.ones(hi - lo, dtype=bool)
                    spans = lists[c.row + row].as_py()
                    for span in spans or ():
                        keep[span["lo"] : span["hi"]] = False
                    total[c.row + row], gone[c.row + row] = hi - lo, (~keep).sum()
                    kept.append(_joined(c, lo, keep))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(total), pa.array(gone), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, schema)


def _joined(c, lo: int, keep: np.ndarray) -> str:
    """The kept words joined by one space."""
    out = []
    bounds = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
    for a, b in zip(lo + bounds[::2], lo + bounds[1::2]):
        # bytes.split() knows exactly the separators of the words: blank, and 9 to 13.
        out += c.buf[c.start[a] : c.end[b - 1]].tobytes().split()
    return b" ".join(out).decode()
