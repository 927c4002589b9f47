"""Refresh of a snapshot from what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Snapshot
from ..sources.staging import unstaged
from ..sources.store import Delta
from .extract import extract, with_order_among
from .resolve import resolve_changed, resolve_relations


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) by content hash: unchanged, changed, added or deleted."""
    both = previous.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def diff_counts(changes: DataFrame) -> DataFrame:
    kinds = ("added", "changed", "deleted", "unchanged")
    return changes.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])


def refresh(previous: Snapshot, scanned: DataFrame, force: bool = False, stage=unstaged) -> tuple[Snapshot, DataFrame]:
    """The new snapshot and the changes. scanned holds the accepted files with their text.

    Rows of unchanged files are carried over; only added and changed files are read and parsed. Edges are
    revalidated and bound after both are together, so a carried edge follows a renamed symbol. With `stage` the
    changes, the parsed files and the symbols are written once and read where they are needed again.
    """
    changes = stage(diff(previous.files.where("false") if force else previous.files, scanned), "changes")
    same = changes.where("status = 'unchanged'").select("path")
    todo = scanned.join(changes.where("status IN ('added', 'changed')").select("path"), "path", "left_semi")
    fresh = extract(todo, stage)
    keep = lambda df, key="filePath": df.join(same.withColumnRenamed("path", key), key, "left_semi").select(*df.columns)
    symbols = stage(keep(previous.symbols).unionByName(fresh.symbols), "symbols")
    relations = resolve_relations(keep(previous.relations).unionByName(fresh.relations), symbols)
    chunks = stage(keep(previous.chunks).unionByName(fresh.chunks), "chunks")
    vectors = previous.vectors.join(chunks.select(F.col("id").alias("chunkId"), F.col("hash").alias("chunkHash")), ["chunkId", "chunkHash"], "left_semi").select(*previous.vectors.columns)
    files = keep(previous.files, "path").unionByName(fresh.files)
    return previous.with_(files=files, symbols=symbols, relations=relations, chunks=chunks, vectors=vectors), changes


def refresh_delta(previous: Snapshot, scanned: DataFrame, stage=unstaged) -> tuple[Delta | None, DataFrame]:
    """What a refresh changes, and the changes by path; None instead of a delta if files can't be numbered among the others.

    Rows of unchanged files are neither read again nor written, but for edges that the change binds otherwise: their files'
    edges are replaced. Applied to `previous`, as a refresh has left it, it gives what refresh() gives, but for ord.
    """
    changes = stage(diff(previous.files, scanned), "changes")
    todo = scanned.join(changes.where("status IN ('added', 'changed')").select("path"), "path", "left_semi")
    fresh = with_order_among(extract(todo, stage), previous.files)
    if fresh is None:
        return None, changes
    old = stage(changes.where("status IN ('changed', 'deleted')").select("path"), "old")
    owned = old.withColumnRenamed("path", "filePath")
    of_old = lambda df: df.join(owned, "filePath", "left_semi").select(*df.columns)
    kept = lambda df: df.join(owned, "filePath", "left_anti").select(*df.columns)
    added = stage(fresh.symbols, "added")
    symbols = kept(previous.symbols).unionByName(added)
    carried = kept(previous.relations)
    rebound, bound = resolve_changed(carried, fresh.relations, of_old(previous.symbols), added, symbols, stage)
    rebound = stage(rebound, "rebound")
    touched = rebound.select("filePath").distinct()
    rewritten = upsert(carried.join(touched, "filePath", "left_semi").select(*carried.columns), rebound, "id")
    chunks = stage(fresh.chunks, "fresh-chunks")
    lost = of_old(previous.chunks).select("id", "hash").join(chunks.select("id", "hash"), ["id", "hash"], "left_anti")
    lost = lost.select(F.col("id").alias("chunkId")).join(previous.vectors.select("chunkId"), "chunkId", "left_semi")
    delta = Delta(
        gone={"files": old, "symbols": owned, "relations": owned.unionByName(touched), "chunks": owned, "vectors": lost},
        rows={"files": fresh.files, "symbols": added, "relations": bound.unionByName(rewritten), "chunks": chunks},
    )
    return delta, changes


def missing_vectors(s: Snapshot, provider: str, dimensions: int) -> DataFrame:
    """Chunks without a vector of that provider and size."""
    have = s.vectors.where((F.col("providerId") == provider) & (F.col("dimensions") == dimensions)).select(F.col("chunkId").alias("id"))
    return s.chunks.join(have, "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key it lacks."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def delete_files(s: Snapshot, paths: DataFrame) -> Snapshot:
    """Without the files in paths(path) and all that belongs to them."""
    gone = lambda df, key: df.join(paths.select(F.col("path").alias(key)), key, "left_anti").select(*df.columns)
    chunks = gone(s.chunks, "filePath")
    vectors = s.vectors.join(chunks.select(F.col("id").alias("chunkId")), "chunkId", "left_semi").select(*s.vectors.columns)
    return s.with_(files=gone(s.files, "path"), symbols=gone(s.symbols, "filePath"), relations=gone(s.relations, "filePath"), chunks=chunks, vectors=vectors)
