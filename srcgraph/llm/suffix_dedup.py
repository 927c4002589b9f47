"""Deduplication of byte strings by prefix doubling over sampled suffixes.

A string of 100 bytes that occurs twice is found as two suffixes that share a
prefix of 100 bytes. Not every suffix is ranked: a string's anchor is the place
of its least hash of 32 bytes, so equal strings have theirs at the same place,
and neighbouring strings mostly share one. The strings of one anchor are a
stretch. Anchors are ranked by their 32 bytes, and Spark sorts out those that
are unique, with all their strings. Equal stretches leave their first one. The
rest are ranked again by pairs (rank so far, bytes at a growing offset), to the
right and to the left, until a side is unique or past the threshold. What each
stretch may still share then bounds the suffixes that are ranked in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from ._hot import with_known
from ._store import Scratch, settings, without
from ._tok import mix64, pieces, row_groups, seeded, sliding_min, string_bytes

#: Bytes of a repeated string, and of those that its anchor is chosen by.
WIDTH, GRAM = 100, 32
#: Bytes of text looked at together, beside those that a string needs beyond.
PIECE = 1 << 18
#: Bits of a place in a piece; the others of 64 are of its hash.
PLACE_BITS = 24
#: Offsets and lengths, in bytes, of what is ranked next to an anchor's first 32: to the right of it, and to the left.
RIGHT, LEFT = ((32, 32), (64, 36)), ((-32, 32), (-64, 32))
#: Of a join with the few keys that repeat, Spark first drops most of the rows that have none, by a filter of bounded size.
FILTERED = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
#: A stretch has fewer strings than 2 to this.
STRING_BITS = 7
_FACTORS = seeded(311, GRAM // 8) | np.uint64(1)


def _hashes(buf: np.ndarray) -> np.ndarray:
    """Of the GRAM bytes from each place."""
    n = len(buf) - GRAM + 1
    with np.errstate(over="ignore"):
        each = mix64(pieces(buf).copy())
        total = each[:n] * _FACTORS[0]
        for j in range(1, GRAM // 8):
            total += each[8 * j : 8 * j + n] * _FACTORS[j]
        return mix64(total)


def _stretches(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, strings, anchor, hash at the anchor) of each stretch in the rows of buf; starts count from buf's first byte."""
    sizes = np.maximum(np.diff(offsets) - WIDTH + 1, 0)
    none = np.zeros(0, dtype=np.int64)
    if not sizes.any():
        return none, none, none, none, none.astype(np.uint64)
    hashes = _hashes(buf)
    place = np.uint64((1 << PLACE_BITS) - 1)
    low = sliding_min((hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), WIDTH - GRAM + 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] + offsets[:-1][row]
    anchor = (low[start] & place).astype(np.int64)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], np.diff(np.append(first, len(row))), anchor[first], hashes[anchor[first]]


def _parts(column: pa.Array):
    """(first row, bytes, row offsets, place of the first byte in its row): several short rows, or a piece of a long one."""
    data, offsets = string_bytes(column)
    for lo, hi in row_groups(offsets, PIECE):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or end - begin <= PIECE:
            yield lo, data[begin:end], offsets[lo : hi + 1] - begin, 0
            continue
        for at in range(0, end - begin, PIECE):
            part = data[begin + at : min(begin + at + PIECE + WIDTH - 1, end)]
            yield lo, part, np.array([0, len(part)]), at


def _anchors(batches):
    """A row for each stretch of (id, mark, text), with its bytes as a digest of 128 bits."""
    for batch in batches:
        ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, buf, offsets, at in _parts(batch.column(2)):
            row, start, n, anchor, hashed = _stretches(buf, offsets)
            if not len(row):
                continue
            raw = buf.tobytes()
            digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + n + (WIDTH - 1)).tolist())])
            halves = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed.view(np.int64)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ids[lo + row]), pa.array(marks[lo + row]), pa.array(start - offsets[row] + at), pa.array(n.astype(np.int32)), pa.array((anchor - start).astype(np.int32))],
                names=["print", "s1", "s2", "id", "mark", "at", "n", "lead"],
            )


_STRETCH = ["print", "s1", "s2", "n", "lead"]


def _cut_out(batches):
    """The bytes of the stretches listed for each text."""
    for batch in batches:
        lists, data, offsets = batch.column(3), *string_bytes(batch.column(2))
        sizes = np.diff(lists.offsets.to_numpy())
        row, flat = np.repeat(np.arange(len(batch)), sizes), lists.flatten()
        at, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        begin = offsets[row] + at
        for lo, hi in row_groups(np.concatenate(([0], np.cumsum(n + (WIDTH - 1)))), 1 << 22):
            texts = [data[a:b].tobytes() for a, b in zip(begin[lo:hi].tolist(), (begin + n + (WIDTH - 1))[lo:hi].tolist())]
            yield pa.RecordBatch.from_arrays(
                [flat.field(3).slice(lo, hi - lo), batch.column(0).take(pa.array(row[lo:hi])), batch.column(1).take(pa.array(row[lo:hi])), *[flat.field(k).slice(lo, hi - lo) for k in (0, 1, 2)], pa.array(texts, pa.binary())],
                names=["print", "id", "mark", "at", "n", "lead", "bytes"],
            )


def _reach(open_: DataFrame, scratch: Scratch) -> DataFrame:
    """(ord, right, left): how far the strings of a stretch may stretch from its anchor, to the right and to the left, and still occur elsewhere.

    By doubling: each round ranks pairs of the rank so far and the bytes at the next offset. A side whose rank is unique
    reaches less far than that; one that is not goes on. Where a stretch ends within the bytes of a round, nothing is said.
    """

    def piece(offset: int, length: int):
        begin = F.col("lead") + offset
        return F.when((begin >= 0) & (begin + length <= F.col("n") + (WIDTH - 1)), F.xxhash64(F.expr(f"substring(bytes, lead + {offset} + 1, {length})")))

    side = lambda right, steps: F.struct(F.lit(right).alias("right"), F.array(*[piece(*s) for s in steps]).alias("next"))
    live = open_.select("ord", F.col("print").alias("rank"), F.explode(F.array(side(True, RIGHT), side(False, LEFT))).alias("s")).select("ord", "rank", "s.right", "s.next")
    ended = None
    for step, ((to, length), (back, _)) in enumerate(zip(RIGHT, LEFT)):
        live = live.where(F.col("next")[step].isNotNull()).withColumn("rank", F.xxhash64("right", "rank", F.col("next")[step]))
        live = scratch.write(live, "ranked")
        counts = scratch.write(live.groupBy("rank").agg(F.count("*").alias("n")), "ranks")
        single = live.join(counts.where("n = 1"), "rank").select("ord", F.when(F.col("right"), to + length - 1).otherwise(-back - 1).alias("reach"), "right")
        ended = single if ended is None else ended.unionByName(single)
        live = with_known(live, scratch.write(counts.where("n > 1"), "shared"), ["rank"]).select("ord", "rank", "right", "next")
    of = lambda right: F.min(F.when(F.col("right") == right, F.col("reach")))
    return ended.groupBy("ord").agg(of(True).alias("right"), of(False).alias("left"))


def repeated_strings(rows: DataFrame, scratch: Scratch, distinct: bool = True) -> DataFrame:
    """(id, mark, lo, hi): byte ranges of texts (id, mark, text) that are covered by a string of 100 bytes with an earlier occurrence.

    Earlier is by id, mark and start. Ranges overlap. `distinct`: no row repeats. No string is compared with
    all others: each step counts keys, from partial counts, and joins them back.
    """
    anchors = scratch.write(rows.mapInArrow(_anchors, "print long, s1 long, s2 long, id long, mark long, at long, n int, lead int"), "anchors")
    alike = (F.min("s1") == F.max("s1")) & (F.min("s2") == F.max("s2"))
    shared = scratch.write(anchors.groupBy("print").agg(F.count("*").alias("many"), alike.alias("alike")).where("many > 1"), "shared")
    with settings(rows.sparkSession, FILTERED):
        found = scratch.write(with_known(anchors, shared.where("many > 1"), ["print"], "many").drop("many"), "found")
    scratch.drop(anchors)
    place = F.struct("id", "mark", "at")
    firsts = scratch.write(found.groupBy(*_STRETCH, "alike").agg(F.min(place).alias("first"), F.count("*").alias("many")), "firsts")
    again = scratch.write(firsts.where("many > 1").select("print", "s1", "s2", "first", "many"), "again")
    whole = with_known(found, again, ["print", "s1", "s2"], "many").where(place > F.col("first")).select("id", "mark", F.col("at").alias("lo"), (F.col("at") + F.col("n") + (WIDTH - 1)).alias("hi"))
    ranges = [scratch.write(whole, "whole")]
    scratch.drop(found)
    # Different stretches under one anchor: what they share is looked for on their bytes.
    listed = firsts.where("NOT alike").select("first.id", "first.mark", F.struct("first.at", "n", "lead", "print").alias("s")).groupBy("id", "mark").agg(F.collect_list("s").alias("stretches"))
    texts = rows.join(listed, ["id", "mark"]).select("id", "mark", "text", "stretches")
    cut = scratch.write(texts.mapInArrow(_cut_out, "print long, id long, mark long, at long, n int, lead int, bytes binary"), "cut")
    if not cut.isEmpty():
        # Numbers in the order of places, so that a number and a string's place in the stretch are one ordered long.
        once = cut if distinct else cut.dropDuplicates(["id", "mark", "at"])
        ordered = scratch.write(once.orderBy("id", "mark", "at").withColumn("ord", F.monotonically_increasing_id()), "ordered")
        scratch.drop(cut)
        reach = scratch.write(_reach(ordered, scratch), "reach")
        back = F.greatest(F.lit(0), F.lit(WIDTH) - F.coalesce("right", F.lit(WIDTH)))
        bounded = ordered.join(reach, "ord", "left").withColumn("least", F.greatest(F.lit(0), F.col("lead") - F.coalesce("left", F.lit(WIDTH)))).withColumn("most", F.least(F.col("n") - 1, F.col("lead") - back))
        bounded = scratch.write(bounded.where("least <= most").select("ord", "id", "mark", "at", "least", "most", "bytes"), "bounded")
        scratch.drop(ordered)
        string = F.unhex(F.left(F.sha2(F.expr(f"substring(bytes, k + 1, {WIDTH})"), 256), F.lit(32)))
        strings = bounded.withColumn("k", F.explode(F.sequence("least", "most"))).select(string.alias("string"), (F.shiftleft("ord", STRING_BITS) + F.col("k")).alias("place"))
        earliest = scratch.write(strings.groupBy("string").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1"), "earliest")
        later = with_known(strings, earliest, ["string"]).where("place > earliest").select("place")
        later = scratch.write(later.groupBy(F.shiftright("place", STRING_BITS).alias("ord")).agg(F.collect_list(F.col("place").bitwiseAND((1 << STRING_BITS) - 1).cast("int")).alias("ks")), "later")
        each = bounded.select("ord", "id", "mark", "at").join(later, "ord").select("id", "mark", "at", F.explode("ks").alias("k")).select("id", "mark", (F.col("at") + F.col("k")).alias("lo"))
        ranges.append(each.select("id", "mark", "lo", (F.col("lo") + WIDTH).alias("hi")))
    out = ranges[0]
    return out.unionByName(ranges[1]) if len(ranges) > 1 else out


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, with n_bytes, n_removed, n_spans (maximal removed runs) and kept_bytes (the rest, as binary).

    Texts are UTF-8 bytes, whole, of any length; matches never cross documents. A
    byte goes if a string of 100 bytes over it also starts earlier: in a document
    with a smaller identifier (an integer) or before it in the same one. Strings
    are judged on the input. A null text counts as empty; texts under 100 bytes
    lose nothing. Rows with a null identifier are kept whole and make no other
    lose bytes. Equal rows under one identifier are one document; different texts
    under one follow each other in the order of a hash of them. An empty table
    gives an empty result. Further columns stay, but columns of the added names
    are replaced.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
    docs = without(docs, *added)
    names = docs.columns
    rows = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) >= WIDTH)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Only if identifiers repeat are texts told apart.
    distinct = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    mark = F.lit(0).cast("long") if distinct else F.xxhash64(text_col)
    rows = rows.select("id", (mark if distinct else F.xxhash64("text")).alias("mark"), "text")
    with Scratch(docs.sparkSession, "suffixes") as scratch:
        ranges = repeated_strings(rows, scratch, distinct)
        lists = ranges.groupBy(F.col("id").alias("__sg_id"), F.col("mark").alias("__sg_mark")).agg(F.collect_list(F.struct(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("__sg_ranges"))
        lists = scratch.keep(scratch.write(lists, "ranges"))
    joined = docs.join(lists, (F.col(id_col).cast("long") == F.col("__sg_id")) & (mark == F.col("__sg_mark")), "left").select(*[docs[c] for c in names], "__sg_ranges")
    where = names.index(text_col)
    schema = StructType(list(docs.schema.fields)).add(added[0], LongType()).add(added[1], LongType()).add(added[2], LongType()).add(added[3], BinaryType())

    def cut(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column(where))
            lists, n = batch.column(len(names)), len(batch)
            sizes = np.diff(offsets)
            gone, spans, kept = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), []
            for row in range(n):
                text = data[offsets[row] : offsets[row + 1]]
                ranges = lists[row].values
                if ranges is None:
                    kept.append(text.tobytes())
                    continue
                change = np.zeros(len(text) + 1, dtype=np.int32)
                np.add.at(change, ranges.field(0).to_numpy(), 1)
                np.add.at(change, ranges.field(1).to_numpy(), -1)
                keep = np.cumsum(change[:-1]) == 0
                gone[row], spans[row] = (~keep).sum(), (np.diff(np.concatenate(([True], keep)).astype(np.int8)) == -1).sum()
                kept.append(text[keep].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes), pa.array(gone), pa.array(spans), pa.array(kept, pa.binary())], names=[*names, *added])

    return joined.mapInArrow(cut, schema)
