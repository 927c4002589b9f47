"""Exact deduplication through a log-structured merge index of digests, in DataFrame operations only.

A batch of documents is digested into a log. Slices of the log are aggregated
into memtables (digest, winning identifier, copies), and each is flushed as an
immutable run sorted by digest within hash buckets; a stored index adds a
filter to each run. Compaction merge-joins the sorted runs, without a shuffle
of theirs, and keeps, for each digest, the winning identifier and the number of
copies. Every document of a group of two or more is then verified byte for byte.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runs import SortedRuns
from ._store import WHILE_WRITING, Scratch, settings

#: Above so many hits, they are joined by a shuffle instead of a broadcast (an identifier and a digest of 32 bytes, some 100
#: bytes each as a hash table, so 20 MB).
BROADCAST_ROWS = 200_000
#: A group of more rows doesn't go to one task with them.
HOT = 10_000
#: Bits of a filter per digest. One of them is set, so one absent digest of this many passes.
FILTER_BITS = 16
#: Bits of one row of a filter, as Spark's bitmap functions have it.
CELL_BITS = 32768


def normalised(text: Column) -> Column:
    """A-Z to a-z and nothing else; a null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex(SortedRuns):
    """Sorted runs of (digest, keep, n). `smallest` says which identifier of equal texts wins.

    A stored index keeps the log and the texts of its documents, and takes further batches.
    """

    def __init__(self, spark: SparkSession, id_type: str = "bigint", smallest: bool = True, path: str | None = None, buckets: int | None = None, digest=sha256):
        super().__init__(spark, "digests", f"digest BINARY, keep {id_type}, n BIGINT", "digest", path, buckets)
        self.id_type, self.pick, self.digest = id_type, F.min if smallest else F.max, digest
        self.better = F.least if smallest else F.greatest

    def logged(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return docs.select(F.col(id_col).alias("id"), self.digest(normalised(F.col(text_col))).alias("digest"))

    def flush_log(self, log: DataFrame) -> None:
        """Aggregates (id, digest) into a memtable and flushes it."""
        run = self.flush(log.groupBy("digest").agg(self.pick("id").alias("keep"), F.count("*").alias("n")), deal=False)
        if self.stored:
            self._filter(run)

    def append(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Takes a batch into a stored index."""
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), self.digest(normalised(F.col(text_col))).alias("digest"))
        place = f"{self.path}/documents/batch-{1 + max((int(r.split('-')[1]) for r in self.runs), default=0):06d}"
        with settings(self.spark, WHILE_WRITING):
            rows.write.mode("overwrite").parquet(place)
        self.flush_log(self.spark.read.schema(self._documents()).parquet(place).select("id", "digest"))

    def _documents(self) -> str:
        return f"id {self.id_type}, text string, digest binary"

    def documents(self) -> DataFrame:
        """(id, text, digest) of all batches."""
        return self.spark.read.schema(self._documents()).option("recursiveFileLookup", "true").parquet(f"{self.path}/documents")

    def _cells(self, run: str) -> int:
        return int(self.spark.read.parquet(f"{self.path}/filter-{run}/size").first()[0])

    @staticmethod
    def _bit(cells: int) -> Column:
        """The bit of a digest, of CELL_BITS for each cell."""
        return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(cells * CELL_BITS))

    def _filter(self, run: str) -> None:
        rows = self.spark.table(self.runs[run])
        size = rows.select(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") * FILTER_BITS / CELL_BITS)).alias("cells"))
        size.write.parquet(f"{self.path}/filter-{run}/size")
        bit = self._bit(self._cells(run))
        cells = rows.groupBy(F.bitmap_bucket_number(bit).alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        cells.write.parquet(f"{self.path}/filter-{run}/cells")

    def maybe(self, digests: DataFrame, run: str) -> DataFrame:
        """Those of the digests that pass a run's filter."""
        bit = self._bit(self._cells(run))
        cells = self.spark.read.parquet(f"{self.path}/filter-{run}/cells")
        probed = digests.select("*", F.bitmap_bucket_number(bit).alias("cell"), F.bitmap_bit_position(bit).alias("at")).join(cells, "cell")
        probed = probed.withColumn("byte", F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int"))
        return probed.where("shiftright(byte, cast(at % 8 as int)) & 1 = 1").select(*digests.columns)

    def held(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, keep): documents whose text the stored index holds, and the identifier that it keeps, verified byte for byte."""
        asked = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("own"))
        asked = asked.withColumn("digest", self.digest(F.col("own")))
        digests = asked.select("digest").distinct()
        found = reduce(DataFrame.unionByName, [self.maybe(digests, run).join(self.spark.table(table), "digest", "left_semi") for run, table in self.runs.items()]).distinct()
        known = self.documents().join(found, "digest", "left_semi").select("digest", F.col("id").alias("keep"), normalised(F.col("text")).alias("theirs"))
        known = known.groupBy("digest", "theirs").agg(self.pick("keep").alias("keep"))
        return asked.join(known, "digest").where(F.col("own") == F.col("theirs")).select("id", "keep")

    def merged(self) -> DataFrame:
        """(digest, keep, n) of all runs, by merge joins of the sorted runs."""
        first, *others = self.tables()
        for run in others:
            both = first.hint("merge").join(run.withColumnsRenamed({"keep": "keep2", "n": "n2"}), "digest", "full_outer")
            none = F.lit(0).cast("long")
            first = both.select("digest", self.better("keep", "keep2").alias("keep"), (F.coalesce("n", none) + F.coalesce("n2", none)).alias("n"))
        return first

    def compact(self) -> DataFrame:
        """One run instead of all; copies within and between runs fold into one row."""
        if len(self.runs) > 1:
            run = self.replace(self.merged(), deal=False)
            if self.stored:
                self._filter(run)
        return self.tables()[0]


def _type(docs: DataFrame, column: str) -> str:
    return docs.select(F.col(column)).schema[0].dataType.simpleString()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: bool = True, runs: int = 4, digest=sha256) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept.

    Equal texts are those identical after lower-casing A-Z; a null text equals
    an empty one. Rows that repeat under one identifier count as rows of the
    group and share its decision. Identifiers that are null never win against
    others. An empty table gives an empty result; texts of any length are read
    whole, and further columns of the input are not read. Hot groups are
    aggregated before every shuffle, so a text that makes up a third of all
    rows is one small row per map task.
    """
    with Scratch(docs.sparkSession, "exact") as scratch, DigestIndex(docs.sparkSession, _type(docs, id_col), smallest, digest=digest) as index:
        log = scratch.write(index.logged(docs, id_col, text_col), "log")
        for k in range(runs):
            index.flush_log(log.where(F.pmod(F.xxhash64("id"), F.lit(runs)) == k))
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return _decided(scratch.keep(_groups(texts, log, index, scratch)), id_col)


def add_batch(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: bool = True) -> DataFrame:
    """Adds a batch to the stored index at `path`; returns the columns of exact_groups for the documents of all batches, as one batch of all would."""
    with Scratch(spark, "exact") as scratch, DigestIndex(spark, _type(docs, id_col), smallest, path) as index:
        index.append(docs, id_col, text_col)
        known = index.documents()
        return _decided(scratch.keep(_groups(known.select("id", "text"), known.select("id", "digest"), index, scratch)), id_col)


def _with_group(log: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows of the log with the group of their digest, if it repeats. Few groups, or the hot ones of many, are broadcast, so that none meets in one task."""
    if repeated.count() <= BROADCAST_ROWS:
        return log.join(F.broadcast(repeated), "digest", "left")
    hot = repeated.where(F.col("n") > HOT)
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return log.join(repeated, "digest", "left")
    cold = log.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(repeated.where(F.col("n") <= HOT), "digest", "left")
    return cold.unionByName(log.join(F.broadcast(hot), "digest"))


def _groups(texts: DataFrame, log: DataFrame, index: DigestIndex, scratch: Scratch) -> DataFrame:
    """(id, digest, keep, n) of every row of the log, verified on the texts (id, text)."""
    found = _with_group(log, scratch.write(index.compact().where("n > 1"), "repeated"))
    assigned = scratch.write(found.select("id", "digest", F.coalesce("keep", "id").alias("keep"), F.coalesce("n", F.lit(1).cast("long")).alias("n")), "assigned")
    # A group is right when its least and greatest text are the same bytes.
    hits = scratch.write(assigned.where("n > 1").select("id", "digest").distinct(), "hits")
    n_hits = hits.count()
    if n_hits == 0:
        return assigned
    side = F.broadcast(hits) if n_hits <= BROADCAST_ROWS else hits
    side = side.select(F.col("id").alias("hit"), "digest")
    found = texts.join(side, F.col("id").eqNullSafe(F.col("hit"))).withColumn("text", normalised(F.col("text"))).where(index.digest(F.col("text")) == F.col("digest"))
    found = found.select("id", "digest", "text")
    wrong = scratch.write(found.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest"), "wrong")
    if wrong.isEmpty():
        return assigned
    # Different texts under one digest: their groups are formed anew on the texts themselves.
    clashing = found.join(wrong, "digest", "left_semi")
    regrouped = clashing.groupBy("digest", "text").agg(index.pick("id").alias("keep"), F.count("*").alias("n"))
    fixed = clashing.join(regrouped, ["digest", "text"]).select("id", "digest", "keep", "n")
    return scratch.write(assigned.join(wrong, "digest", "left_anti").select(*fixed.columns).unionByName(fixed), "decided")


def _decided(assigned: DataFrame, id_col: str) -> DataFrame:
    return assigned.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("digest"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: bool = True) -> DataFrame:
    """The input's rows and columns, one row of each group of equal texts.

    Rows repeated under one identifier with equal texts leave one row.
    """
    with Scratch(docs.sparkSession, "exact-kept") as scratch:
        groups = exact_groups(docs, id_col, text_col, smallest).select(F.col(id_col).alias("__sg_gid"), F.unhex("digest").alias("__sg_gdigest"), "kept")
        groups = scratch.keep(scratch.write(groups, "groups"))
    same_id = F.col(id_col).eqNullSafe(F.col("__sg_gid"))
    if groups.groupBy("__sg_gid").count().where("count > 1").limit(1).isEmpty():
        # Few rows go, so only their identifiers meet the documents, whose texts stay where they are.
        gone = groups.where(~F.col("kept")).select("__sg_gid")
        side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
        return docs.join(side, same_id, "left_anti")
    # Some identifiers repeat: rows are told apart by their texts too, and equal rows leave one.
    kept = groups.where("kept").select("__sg_gid", "__sg_gdigest").distinct()
    keyed = docs.withColumn("__sg_digest", sha256(normalised(F.col(text_col))))
    keyed = keyed.join(kept, same_id & (F.col("__sg_digest") == F.col("__sg_gdigest")), "left_semi")
    return keyed.withColumn("__sg_same", F.col(id_col)).dropDuplicates(["__sg_same", "__sg_digest"]).drop("__sg_same", "__sg_digest")
