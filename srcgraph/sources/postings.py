"""Inverted indexes as clustered Parquet tables: which rows hold a key, and which rows contain a string.

An index is a folder with three tables. `rows` has the indexed rows, numbered,
in one folder for each block of numbers. `postings` has the numbers within a
block that hold a key, sorted and packed, in one row per key, block and task
that met both; it is ordered by key, in small row groups, so a scan for a few
keys reads their row groups alone. `frequencies` has the number of rows per
key, ordered too. A block bounds every list, so a key that most rows hold is
many rows and never one large one.

Lists are made where the rows are read: a task turns the rows of a block round,
one distinct text after the other, so only packed lists are shuffled and each
distinct text is taken apart once.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .fs import Files

#: Binary digits of a row's number within its block.
BLOCK_BITS = 16
#: Bytes of a row group of postings: what a lookup of one key reads at least.
ROW_GROUP = 1 << 20
#: Candidates that may be broadcast to the rows they are verified on (16 bytes each, some 60 as a hash table).
BROADCAST_ROWS = 200_000
#: Places, and characters of distinct texts, that a task gathers before it gives their lists: some 100 MB.
GATHERED, CHARACTERS = 8_000_000, 8_000_000


def _pack(at: np.ndarray) -> bytes:
    """Sorted distinct numbers of a block as their differences, deflated where that is shorter."""
    at = at.astype("<u2")
    at[1:] -= at[:-1].copy()
    raw = at.tobytes()
    small = zlib.compress(raw, 1) if len(raw) > 64 else raw
    return small if len(small) < len(raw) else raw


def _unpack(rows: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(rows if len(rows) == 2 * n else zlib.decompress(rows), "<u2"), dtype="int32")


def _turned(texts: dict[str, list[np.ndarray]], block: int, block_bits: int, keys_of: Callable[[str], Iterable[str]]) -> Iterator[pa.RecordBatch]:
    """(key, block, n, rows) from the places of each distinct text."""
    held: dict[str, list[np.ndarray]] = {}
    for text, at in texts.items():
        for key in keys_of(text):
            held.setdefault(key, []).extend(at)
    mark, out = np.zeros(1 << block_bits, bool), []
    for key, parts in held.items():
        if len(parts) == 1 and len(parts[0]) == 1:  # most keys of a block
            out.append((key, block, 1, parts[0].tobytes()))
        else:
            at = np.concatenate(parts)
            if len(at) < len(mark) >> 6:
                at = np.array(sorted(set(at.tolist())))
            else:
                mark[:] = False
                mark[at] = True
                at = np.flatnonzero(mark)
            out.append((key, block, len(at), _pack(at)))
        if len(out) == 4096:
            yield _lists(out)
            out = []
    if out:
        yield _lists(out)


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    key, block, n, packed = zip(*rows)
    return pa.record_batch([pa.array(key, pa.string()), pa.array(block, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["key", "block", "n", "rows"])


def _inverter(block_bits: int, keys_of: Callable[[str], Iterable[str]]):
    """For mapInArrow over (block, at, texts): the lists of every block that a task meets."""

    def run(batches):
        texts: dict[str, list[np.ndarray]] = {}
        current, places, characters = None, 0, 0
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                if texts and (blocks[first] != current or places > GATHERED or characters > CHARACTERS):
                    yield from _turned(texts, int(current), block_bits, keys_of)
                    texts, places, characters = {}, 0, 0
                current = blocks[first]
                part = batch.slice(first, last - first)
                found = pc.list_flatten(part.column(2)).dictionary_encode()
                at = part.column(1).to_numpy(zero_copy_only=False).astype("<u2")[pc.list_parent_indices(part.column(2)).to_numpy()]
                codes = found.indices.to_numpy()
                at = at[np.argsort(codes, kind="stable")]
                ends = np.cumsum(np.bincount(codes, minlength=len(found.dictionary)))
                begin = 0
                for text, end in zip(found.dictionary.to_pylist(), ends.tolist()):
                    known = texts.get(text)
                    if known is None:
                        texts[text] = [at[begin:end]]
                        characters += len(text)
                    else:
                        known.append(at[begin:end])
                    begin = end
                places += len(at)
        if texts:
            yield from _turned(texts, int(current), block_bits, keys_of)

    return run


def _places(batches):
    """For mapInArrow over (key, block, n, rows): (key, block, at), a block at a time."""
    for batch in batches:
        for key, block, n, rows in zip(*(c.to_pylist() for c in batch.columns)):
            at = _unpack(rows, n)
            yield pa.record_batch([pa.array([key] * n, pa.string()), pa.array(np.full(n, block, "int64")), pa.array(at)], names=["key", "block", "at"])


def _in_all(keys: int):
    """For applyInPandas by block: the places that hold all of some keys."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        each: dict[str, list[np.ndarray]] = {}
        for key, n, rows in zip(lists["key"], lists["n"], lists["rows"]):
            each.setdefault(key, []).append(_unpack(rows, n))
        sets = sorted((np.unique(np.concatenate(x)) for x in each.values()), key=len)
        at = reduce(np.intersect1d, sets) if len(sets) == keys else np.empty(0, "int32")
        return pd.DataFrame({"block": np.full(len(at), lists["block"].iloc[0], "int64"), "at": at.astype("int32")})

    return run


class Postings:
    """An index below `path`, as build() leaves it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str) -> DataFrame:
        schema = {"postings": "key string, block long, n long, rows binary", "frequencies": "key string, n long"}.get(name)
        return self.spark.read.schema(schema or StructType.fromJson(json.loads(Files(self.spark).read(f"{self.path}/rows.json")))).parquet(f"{self.path}/{name}")

    @property
    def built(self) -> bool:
        """Whether build() has come to its end."""
        return Files(self.spark).exists(f"{self.path}/frequencies/_SUCCESS")

    @staticmethod
    def keys_of(text: str) -> Iterable[str]:
        """The keys under which a row is filed that has the text."""
        return (text,)

    @classmethod
    def build(cls, rows: DataFrame, path: str, texts: Column, block_bits: int = BLOCK_BITS):
        """Indexes rows by the keys of the array `texts`; null texts and a null array hold nothing. Repeated keys of a row count once. Blocks have 16 binary digits at most."""
        spark, files = rows.sparkSession, Files(rows.sparkSession)
        files.remove(path)
        number = F.monotonically_increasing_id()
        numbered = rows.select("*", number.alias("__number")).select(*rows.columns, F.shiftright("__number", block_bits).alias("__block"), F.col("__number").bitwiseAND((1 << block_bits) - 1).cast("int").alias("__at"))
        files.replace(f"{path}/rows.json", numbered.schema.json())
        numbered.write.partitionBy("__block").parquet(f"{path}/rows")
        out = cls(spark, path)
        found = out.rows().select(F.col("__block").cast("long").alias("block"), F.col("__at").alias("at"), F.array_compact(texts).alias("texts"))
        lists = found.mapInArrow(_inverter(block_bits, cls.keys_of), "key string, block long, n long, rows binary")
        # Written before they are dealt into ranges, which samples them: else the rows would be turned round twice.
        lists.write.parquet(f"{path}/lists")
        lists = spark.read.schema(lists.schema).parquet(f"{path}/lists")
        ordered = lists.repartitionByRange(F.col("key"), F.col("block")).sortWithinPartitions("key", "block")
        ordered.write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
        files.remove(f"{path}/lists")
        counts = out._table("postings").groupBy("key").agg(F.sum("n").alias("n"))
        counts.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/frequencies")
        return out

    def frequencies(self, keys: list[str]) -> dict[str, int]:
        """Rows of each of these keys that occur."""
        return {r.key: r.n for r in self._table("frequencies").where(F.col("key").isin(keys)).collect()} if keys else {}

    def postings(self, keys: list[str]) -> DataFrame:
        """(key, block, n, rows) of a few keys: the scan is given the keys, so it reads their row groups."""
        return self._table("postings").where(F.col("key").isin(keys))

    def rows(self) -> DataFrame:
        return self._table("rows")

    def at(self, places: DataFrame) -> DataFrame:
        """The rows at places(block, at), and the other columns of places. Few places are broadcast, and then only their blocks' folders are read."""
        few = places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        side = places.withColumnsRenamed({"block": "__block", "at": "__at"})
        return self.rows().join(F.broadcast(side) if few else side, ["__block", "__at"]).drop("__block", "__at")

    def holding(self, keys: list[str]) -> DataFrame:
        """Rows that hold any of the keys, once for each, with `key`."""
        return self.at(self.places(self.postings(keys)))

    def places(self, lists: DataFrame) -> DataFrame:
        """(key, block, at) of some postings."""
        return lists.mapInArrow(_places, "key string, block long, at int")

    def places_of_all(self, keys: list[str]) -> DataFrame:
        """(block, at) of rows that hold every one of the keys: arrays are intersected block by block before anything is read."""
        if len(keys) == 1:
            return self.places(self.postings(keys)).select("block", "at")
        return self.postings(keys).groupBy("block").applyInPandas(_in_all(len(keys)), "block long, at int")


GRAM = 3
#: Grams of a needle whose postings are read: the rarest; the others are left to the verification.
PROBED = 4
#: Stands between the texts of one row, and after the last, so that each character begins a gram.
END = "\x01"


def lowered(*texts: Column) -> Column:
    """Several texts of a row, or arrays of them, as one to search in; null ones hold nothing."""
    return F.concat(F.lower(F.concat_ws(END, *texts)), F.lit(END * (GRAM - 1)))


class SubstringIndex(Postings):
    """Which rows contain a string, in any case, in any of some texts.

    Candidates are the rows that hold the needle's rarest grams of three
    characters; each is then verified on its text. A needle of one or two
    characters is looked for as the beginning of grams.
    """

    @classmethod
    def of(cls, rows: DataFrame, path: str, *texts: Column, block_bits: int = BLOCK_BITS) -> SubstringIndex:
        keyed = rows.withColumn("__text", lowered(*texts))
        return cls.build(keyed, path, F.split(F.col("__text"), END), block_bits)

    @staticmethod
    def keys_of(text: str) -> Iterable[str]:
        """Its grams, one for each of its characters."""
        text, n = text + END * (GRAM - 1), len(text)
        return {text[i : i + GRAM] for i in range(n)}

    def candidates(self, needle: str) -> DataFrame:
        """(block, at) of rows that may contain a needle, lower-cased and not empty."""
        if len(needle) < GRAM:
            begins = self._table("postings").where(F.col("key").startswith(needle))
            return self.places(begins).select("block", "at").distinct()
        keys = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
        known = self.frequencies(keys)
        if len(known) < len(keys):
            return self._table("postings").where("false").select("block", F.lit(0).alias("at"))
        return self.places_of_all(sorted(keys, key=lambda k: (known[k], k))[:PROBED])

    def containing(self, needle: str) -> DataFrame:
        """Rows of which a text contains the needle; every row for an empty one. A needle with END in it is in no row."""
        low = needle.lower()
        if not low:
            return self.rows().drop("__block", "__at", "__text")
        if END in low:
            return self.rows().where("false").drop("__block", "__at", "__text")
        return self.at(self.candidates(low)).where(F.col("__text").contains(low)).drop("__text")

    def containing_any(self, needles: list[str]) -> DataFrame:
        """Rows for each needle that they contain, with `needle`."""
        parts = [self.containing(n).withColumn("needle", F.lit(n)) for n in dict.fromkeys(needles)]
        return reduce(DataFrame.unionByName, parts)
