"""Lookups, search and refreshes over stored indexes, held against the same SQL as the scans and whole runs of `queries` and `coverage`."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import incremental
from ..operators.indexed import TextIndexes, query_terms
from ..schema import Snapshot
from ..sources import store
from ..sources.fs import Files
from ..sources.staging import Staging, shared_root
from . import coverage, queries  # noqa: F401 (they register the SQL that is used here)
from . import testdata as td
from .coverage import _REFRESH
from .queries import _FILES, _SYMBOLS, NEEDLE, QUERY
from .registry import SQL, query

_FOLDERS: dict[tuple[str, str], str] = {}


def folder(spark, d) -> str:
    """A folder for what is stored of a folder's tables in this session; it goes with it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{shared_root(spark)}/indexes-{uuid.uuid4().hex[:12]}"
        place = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[key])
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(place)
        fs.deleteOnExit(place)
    return _FOLDERS[key]


def indexes(spark, d, *parts: str) -> TextIndexes:
    """The indexes of a folder's tables, each built when it is first asked for in a session."""
    path = f"{folder(spark, d)}/text"
    out = TextIndexes(spark, path)
    return TextIndexes.build(td.snapshot(spark, d), path, tuple(p for p in parts if not out.substrings(p).built))


@query(SQL["symbol_substring_lookup"])
def indexed_symbol_lookup(spark, d):
    return indexes(spark, d, "names").find_symbols(NEEDLE).select("id", "name", "filePath")


@query(SQL["language_filter_files"])
def indexed_file_filter(spark, d):
    return indexes(spark, d, "files").filter_files("src1", "fr").select("path", "language", "size")


@query(SQL["symbols_filtered"])
def indexed_symbol_filter(spark, d):
    return indexes(spark, d, "symbols").filter_symbols("Blue", "method").select("id", "name", "kind")


@query(SQL["references_filtered"])
def indexed_reference_filter(spark, d):
    return indexes(spark, d, "relations").filter_references("small", "extends").select("id", "fromName", "toName")


@query(SQL["lexical_search_topk"])
def indexed_search_topk(spark, d):
    return indexes(spark, d, "terms", "paths", "names").search(QUERY, 25)


@query("SELECT term, count(*)::BIGINT AS files, min(path) AS first FROM files JOIN q ON list_contains(terms, term) GROUP BY term", _FILES, f"q AS (SELECT DISTINCT unnest({QUERY.split()}) AS term)")
def indexed_term_files(spark, d):
    """The files of a query's terms, from their postings."""
    rows = indexes(spark, d, "terms").terms().holding(query_terms(spark, QUERY))
    return rows.groupBy(F.col("key").alias("term")).agg(F.count("*").alias("files"), F.min("path").alias("first"))


@query("SELECT id, name FROM symbols WHERE contains(lower(name), 'r#')", _SYMBOLS)
def indexed_short_needle(spark, d):
    """A needle shorter than a gram is the beginning of grams."""
    return indexes(spark, d, "names").substrings("names").containing("R#").select("id", "name")


# Refreshes of a stored index


def refreshed(spark, d) -> Snapshot:
    """The index of all documents, stored; then refreshed by what a scan finds changed: rows are written for these paths alone, and the layers are merged on reading."""
    path = f"{folder(spark, d)}/index"
    if not Files(spark).exists(f"{path}/CURRENT-refreshed"):
        before, scanned = coverage.before_and_after(spark, d)
        before = before.with_(vectors=before.vectors.where("chunkHash <> 'stale'"))
        store.write(before, path, "documents", buckets=8)
        with Staging(spark) as stage:
            delta, _ = incremental.refresh_delta(store.read(spark, path, verify=False), scanned, stage)
            store.commit(spark, path, delta)
        Files(spark).replace(f"{path}/CURRENT-refreshed", "")
    return store.read(spark, path, "documents")


@query("SELECT path, sha256(CASE WHEN k % 3 = 0 THEN text || '!' ELSE text END) AS hash FROM dk WHERE k % 5 <> 0", _REFRESH)
def layered_files(spark, d):
    return refreshed(spark, d).files.select("path", "hash")


@query(SQL["refresh_edges"])
def layered_edges(spark, d):
    """Edges after a refresh that bound only those that a change concerns."""
    return refreshed(spark, d).relations.select("id", "toSymbolId", F.col("confidence").cast("double").alias("confidence"))


@query(SQL["refresh_vectors"])
def layered_vectors(spark, d):
    return refreshed(spark, d).vectors.select("chunkId", "chunkHash")


@query("SELECT t, n::BIGINT AS n FROM (SELECT 'files' AS t, count(*) AS n FROM dk WHERE k % 5 <> 0 UNION ALL SELECT 'symbols', count(*) FROM same UNION ALL SELECT 'relations', count(*) FROM same UNION ALL SELECT 'vectors', count(*) FROM same WHERE k % 11 <> 0)", _REFRESH)
def layered_counts(spark, d):
    """What the manifest says that each table holds, against what its layers give."""
    s = refreshed(spark, d)
    parts = [getattr(s, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("files", "symbols", "relations", "vectors")]
    return reduce(DataFrame.unionByName, parts)
