"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Documents with one word sequence are one representative from the start. Bands
of its signature put a representative into buckets. Each bucket first proves
its members against one hub. What stays unconnected in a bucket is compared
without exception: as pairs in small buckets. Members of large ones meet
through the rarest shingles of their sets, of which linked sets share one: as
pairs where few hold it, else in blocks that hold one block's sets and stream
the others past it. Sets are compared in full, and a link is confirmed on the
words of the shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._minhash import ShingleSet, bands, common, sequence_digests, shingle_sets, signatures
from ._store import Scratch, partitions
from ._tok import Hasher
from .components import components

BANDS, ROWS = 32, 4
#: Least intersection and union, in the same units: 75 of 100.
NUMERATOR, DENOMINATOR = 75, 100
#: Buckets of more representatives go by their rarest shingles, and what many share of these in blocks of about BLOCK.
SMALL_BUCKET, BLOCK = 64, 256
#: Members that one task compares with a hub.
HUB_SHARE = 256
#: Cells in which shingles are counted (2 MB of counts).
CELLS = 1 << 18
#: Identifiers that may be broadcast (16 bytes each, some 50 MB as a hash table).
BROADCAST_ROWS = 500_000

_HASHER = Hasher(23)


def _sketch(batches):
    for batch in batches:
        n = len(batch)
        size, digest, keys = np.zeros(n, dtype=np.int64), [], [None] * n
        for sets in shingle_sets(batch.column(1), _HASHER):
            counts = np.diff(sets.bounds)
            size[sets.row : sets.row + len(counts)] = sets.sizes
            digest += sequence_digests(sets)
            full = np.flatnonzero(counts)
            if len(full):
                at = np.append(sets.bounds[full], sets.bounds[-1])
                for r, key in zip(sets.row + full, bands(signatures(sets.hashes, at, BANDS * ROWS), ROWS).view(np.int64)):
                    keys[r] = key
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "keys"])


def _linked(shared: int, a: int, b: int) -> bool:
    return DENOMINATOR * shared >= NUMERATOR * (a + b - shared)


def _confirmed(a: ShingleSet, b: ShingleSet) -> bool:
    """By the words of the shingles."""
    n, m, shared = common(a, b)
    return _linked(shared, n, m)


def _nominated(a: np.ndarray, b: np.ndarray) -> bool:
    """By the hashes of the shingles."""
    if DENOMINATOR * min(len(a), len(b)) < NUMERATOR * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    return _linked(int((both[1:] == both[:-1]).sum()), len(a), len(b))


def _each(texts: pa.Array):
    """(chunk's sets, row in it) for every row."""
    for sets in shingle_sets(texts, _HASHER):
        for row in range(sets.chunk.rows):
            yield sets, row


def _against_hub(batches):
    """Rows sorted by (a, salt), the hub's own row first: links of the hub with the members after it."""
    key, hub = None, None
    for batch in batches:
        found = ([], [])
        for a, salt, b, (sets, row) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _each(batch.column(3))):
            if b is None:
                key, hub = (a, salt), sets.one(row)
            elif key == (a, salt) and _nominated(hub.hashes, sets.hashes[sets.bounds[row] : sets.bounds[row + 1]]) and _confirmed(hub, sets.one(row)):
                found[0].append(a)
                found[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def _against_block(batches):
    """Rows sorted by (zone, i, j), the block's own rows first: links of the block with the rows after it."""
    key, own, index = None, [], None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        found = ([], [])
        for zone, i, j, member, rep, comp, (sets, row) in zip(*columns, _each(batch.column(6))):
            if (zone, i, j) != key:
                key, own, index = (zone, i, j), [], None
            if not member:
                own.append((rep, comp, sets.one(row)))
                continue
            if index is None and own:
                values = np.concatenate([s.hashes for _, _, s in own])
                holder = np.repeat(np.arange(len(own)), [len(s.hashes) for _, _, s in own])
                order = np.argsort(values, kind="stable")
                index = values[order], holder[order], np.array([len(s.hashes) for _, _, s in own]), np.array([c for _, c, _ in own])
            if index is None:
                continue
            values, holder, sizes, comps = index
            shingles = sets.hashes[sets.bounds[row] : sets.bounds[row + 1]]
            lo, hi = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
            count = hi - lo
            spots = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            shared = np.bincount(holder[spots], minlength=len(own))
            right = np.flatnonzero((DENOMINATOR * shared >= NUMERATOR * (sizes + len(shingles) - shared)) & (comps != comp))
            this = sets.one(row) if len(right) else None
            for k in right:
                if _confirmed(own[k][2], this):
                    found[0].append(own[k][0])
                    found[1].append(rep)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def _cell_counts(batches):
    """(cell, n): how many shingles of a task's sets fall into each cell.

    Cells with one are left out: how rare a shingle is taken to be decides what
    a comparison costs, never what is compared.
    """
    total = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for sets in shingle_sets(batch.column(0), _HASHER):
            total += np.bincount((sets.hashes % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    used = np.flatnonzero(total > 1)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])


def _rarest(often):
    """(h, rep, comp, n): the first shingles of each set, ordered by how often their cells occur, the rarest first.

    Linked sets of n shingles have 3n/4 in common, so in whatever order they share one of the first n - ceil(3n/4) + 1 of either.
    """

    def run(batches):
        counts = often.value
        for batch in batches:
            reps, comps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = ([], [], [], [])
            for rep, comp, (sets, row) in zip(reps, comps, _each(batch.column(2))):
                own = sets.hashes[sets.bounds[row] : sets.bounds[row + 1]]
                first = len(own) + (-NUMERATOR * len(own)) // DENOMINATOR + 1
                chosen = np.lexsort((own, counts[(own % np.uint64(CELLS)).astype(np.int64)]))[:first]
                for column, values in zip(out, (own[chosen].view(np.int64), np.full(len(chosen), rep), np.full(len(chosen), comp), np.full(len(chosen), len(own)))):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["h", "rep", "comp", "n"])

    return run


def _fits(a: str, b: str):
    """Sets of these sizes can be similar enough."""
    return (F.least(a, b) * DENOMINATOR) >= (F.greatest(a, b) * NUMERATOR)


class _Verifier:
    """Texts of the representatives that share a bucket, and comparisons on their full sets."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, reps: DataFrame, scratch: Scratch):
        self.scratch, self.parts = scratch, partitions(docs.sparkSession)
        texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
        wanted = F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps

        def own(batches):
            # A row that repeats an identifier with another text is not the representative.
            for batch in batches:
                digests = [d for sets in shingle_sets(batch.column(1), _HASHER) for d in sequence_digests(sets)]
                yield batch.filter(pa.array([d == x for d, x in zip(digests, batch.column(2).to_pylist())], pa.bool_()))

        found = texts.join(wanted, "rep").select("rep", "text", "digest").mapInArrow(own, "rep long, text string, digest binary")
        self.texts = scratch.write(found.select("rep", "text"), "texts")

    def pairs(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that are linked."""
        pairs = self.scratch.write(pairs, name)
        spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(HUB_SHARE)).alias("salts"))
        hubs = spread.join(self.texts.withColumnRenamed("rep", "a"), "a")
        hubs = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
        members = pairs.join(spread, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
        members = members.join(self.texts.withColumnRenamed("rep", "b"), "b").select("a", "salt", "b", "text")
        dealt = hubs.unionByName(members).repartition(self.parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return self.scratch.write(dealt.mapInArrow(_against_hub, "a long, b long"), f"{name}-linked")

    def blocks(self, members: DataFrame) -> DataFrame:
        """All links between different comps within a zone. members: (zone, rep, comp), distinct."""
        sizes = members.groupBy("zone", "comp").agg(F.count("*").alias("c"))
        # The largest comp of a zone needs no comparison with itself.
        zones = sizes.groupBy("zone").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("top"))
        zones = zones.select("zone", F.col("top.comp").alias("main"), F.ceil(F.col("all") / F.lit(BLOCK)).alias("cols"), F.ceil((F.col("all") - F.col("top.c")) / F.lit(BLOCK)).alias("rows"))
        rows = members.join(zones, "zone").join(self.texts, "rep").where("rows > 0")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        light = rows.where("comp <> main").select("zone", F.pmod(F.xxhash64("rep"), F.col("rows")).alias("i"), upto("cols").alias("j"), F.lit(False).alias("member"), "rep", "comp", "text")
        every = rows.select("zone", upto("rows").alias("i"), F.pmod(F.xxhash64("rep"), F.col("cols")).alias("j"), F.lit(True).alias("member"), "rep", "comp", "text")
        dealt = light.unionByName(every).repartition(self.parts, "zone", "i", "j").sortWithinPartitions("zone", "i", "j", "member", "rep")
        return self.scratch.write(dealt.mapInArrow(_against_block, "a long, b long"), "block-linked")

    def crowd(self, members: DataFrame) -> DataFrame:
        """All links between different comps among the members (rep, comp), distinct.

        Linked sets share one of the rarest shingles of either. How rare a shingle
        is, is counted in CELLS cells, whose counts are broadcast.
        """
        sets = self.scratch.write(self.texts.join(members, "rep").select("rep", "comp", "text"), "sets")
        cells = sets.select("text").mapInArrow(_cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
        often = np.zeros(CELLS, dtype=np.int64)
        often[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        shared = sets.sparkSession.sparkContext.broadcast(often)
        prefix = self.scratch.write(sets.mapInArrow(_rarest(shared), "h long, rep long, comp long, n long"), "prefix")
        shared.destroy()
        groups = prefix.groupBy("h").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("rep").alias("low")).where("c0 < c1")
        dealt = self.scratch.write(prefix.join(groups.select("h", "m", "low"), "h"), "dealt")
        few = dealt.where(f"m <= {SMALL_BUCKET}")
        links = self.pairs(_crossing(few, "h"), "rare")
        many = dealt.where(f"m > {SMALL_BUCKET}")
        if not many.isEmpty():
            # Groups that share members are one zone, so no pair is compared once per shingle.
            zones = components(many.select(F.col("low").alias("a"), F.col("rep").alias("b")), self.scratch)
            zoned = many.select("rep", "comp").distinct().join(zones.select(F.col("id").alias("rep"), F.col("comp").alias("zone")), "rep")
            links = links.unionByName(self.blocks(self.scratch.write(zoned.select("zone", "rep", "comp"), "zones")))
        return links


def _crossing(rows: DataFrame, key: str) -> DataFrame:
    """Distinct pairs (a, b) of rows (key, rep, comp, n) of one key and different comps whose sizes fit."""
    other = rows.select(key, *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "comp")])
    pairs = rows.join(other, key).where((F.col("rep") < F.col("rep2")) & (F.col("comp") != F.col("comp2")) & _fits("n", "n2"))
    return pairs.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()


def _placed(members: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (key, rep, n, m) of the buckets that are not one component, with their comp."""
    placed = members.select("key", "rep", "n", "m").join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    placed = scratch.write(placed.select("key", "rep", "n", "m", "comp"), "placed")
    split = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    open_ = scratch.write(placed.join(split, "key", "left_semi"), "open")
    scratch.drop(placed)
    return open_


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the identifier (an integer), n_shingles, component_id (the least identifier reachable by links) and kept.

    Documents are linked when at least 75 of 100 shingles of five words of
    their union are common. A text that is null, empty or blank has no
    shingles, and stays alone, as do rows with a null identifier (component_id
    null, kept). Rows that repeat under one identifier share its component. An
    empty table gives an empty result; further columns of the input are not
    read, and texts of any length are read whole. Candidates come from 32 bands
    of four coordinates: a pair of similarity 0.75 is missed by all of them
    with a probability of 5e-6. No bucket is capped.
    """
    with Scratch(docs.sparkSession, "near") as scratch:
        ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        sketch = scratch.write(ids.mapInArrow(_sketch, "id long, n long, digest binary, keys array<long>"), "sketch")
        reps = sketch.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
        reps = scratch.write(reps, "reps")
        rows = reps.select("rep", "n", "digest", F.explode("keys").alias("key"))
        buckets = rows.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("rep", "n")).alias("hub")).where("m > 1")
        members = scratch.write(rows.join(buckets, "key").select("key", "rep", "n", "digest", "m", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "members")
        check = _Verifier(docs, id_col, text_col, scratch.write(members.select("rep", "digest").distinct(), "wanted"), scratch)
        stars = members.where((F.col("rep") != F.col("hub")) & _fits("n", "hub_n")).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
        links = check.pairs(stars, "stars")
        comps = scratch.write(components(links, scratch), "comps")
        open_ = _placed(members, comps, scratch)
        few = open_.where(f"m <= {SMALL_BUCKET}")
        links = links.unionByName(check.pairs(_crossing(few, "key").join(stars, ["a", "b"], "left_anti"), "crossing"))
        many = open_.where(f"m > {SMALL_BUCKET}")
        if not many.isEmpty():
            links = links.unionByName(check.crowd(scratch.write(many.select("rep", "comp").distinct(), "crowd")))
        comps = scratch.write(components(links, scratch), "comps")
        classes = reps.select("digest", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"))
        out = sketch.drop("keys").join(classes, "digest", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
        out = scratch.keep(scratch.write(out.select("id", "n", "component_id"), "groups"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, one document of each group: that with the least identifier."""
    with Scratch(docs.sparkSession, "near-gone") as scratch:
        dropped = near_groups(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("__sg_gone")).distinct()
        dropped = scratch.keep(scratch.write(dropped, "gone"))
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return docs.join(side, F.col(id_col).cast("long") == F.col("__sg_gone"), "left_anti")
