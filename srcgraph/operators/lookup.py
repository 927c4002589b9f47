"""Filters and joins that answer lookups over one snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Snapshot


def get_file(s: Snapshot, path: str) -> DataFrame:
    return s.files.where(F.col("path") == path)


def find_symbols(s: Snapshot, query: str) -> DataFrame:
    """Symbols whose name contains the query, in any case; all for an empty query."""
    return s.symbols.where(F.lower("name").contains(query.lower())).orderBy("name", "filePath", "startLine")


def find_references(s: Snapshot, query: str) -> DataFrame:
    return s.relations.where(F.lower("targetName") == query.lower()).orderBy("filePath", "line")


def _calls(s: Snapshot, name: str, end: str) -> DataFrame:
    named = s.symbols.where(F.lower("name") == name.lower()).select(F.col("id").alias(end))
    return s.relations.where(F.col("kind") == "calls").join(named, end).select(*s.relations.columns).orderBy("filePath", "line")


def find_callers(s: Snapshot, name: str) -> DataFrame:
    """Calls to symbols of that name."""
    return _calls(s, name, "toSymbolId")


def find_callees(s: Snapshot, name: str) -> DataFrame:
    """Calls from symbols of that name."""
    return _calls(s, name, "fromSymbolId")


def _any_contains(query: str, *columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return out


def get_chunks(s: Snapshot, file_path: str | None = None, query: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = s.chunks
    if file_path is not None:
        rows = rows.where(F.col("filePath") == file_path)
    if query:
        rows = rows.where(_any_contains(query, F.col("text"), F.col("filePath"), F.col("hash")))
    return rows.orderBy("ord").offset(max(0, offset)).limit(min(500, max(1, limit)))


def chunk_page(s: Snapshot, limit: int = 50, offset: int = 0, **where) -> dict:
    """A page of chunks with the total, the next offset (None at the end) and the files that have chunks."""
    limit = min(500, max(1, limit))
    rows = s.chunks
    if where.get("file_path") is not None:
        rows = rows.where(F.col("filePath") == where["file_path"])
    if where.get("query"):
        rows = rows.where(_any_contains(where["query"], F.col("text"), F.col("filePath"), F.col("hash")))
    total = rows.count()
    return {
        "chunks": get_chunks(s, limit=limit, offset=offset, **where), "total": total, "nextOffset": offset + limit if offset + limit < total else None,
        "files": s.chunks.select("filePath").distinct().orderBy("filePath"),
    }


def filter_files(s: Snapshot, query: str = "", language: str | None = None, in_path_only: bool = False) -> DataFrame:
    """By language, and by path, language or term; with in_path_only by path in the query's own case."""
    rows = s.files if language is None else s.files.where(F.col("language") == language)
    if query and in_path_only:
        rows = rows.where(F.col("path").contains(query))
    elif query:
        rows = rows.where(_any_contains(query, F.col("path"), F.col("language")) | F.exists("terms", lambda t: F.lower(t).contains(query.lower())))
    return rows.orderBy("ord")


def filter_symbols(s: Snapshot, query: str = "", kind: str | None = None) -> DataFrame:
    rows = s.symbols if kind is None else s.symbols.where(F.col("kind") == kind)
    return rows.where(_any_contains(query, F.col("name"), F.col("filePath"), F.col("kind"))).orderBy("ord") if query else rows.orderBy("ord")


def named_relations(s: Snapshot) -> DataFrame:
    """Relations with fromName and toName."""
    end = lambda side: s.symbols.select(F.col("id").alias(f"{side}SymbolId"), F.col("name").alias(f"{side}Name"))
    return s.relations.join(end("from"), "fromSymbolId", "left").join(end("to"), "toSymbolId", "left").select(*s.relations.columns, "fromName", "toName")


def filter_references(s: Snapshot, query: str = "", kind: str | None = None) -> DataFrame:
    rows = named_relations(s if kind is None else s.with_(relations=s.relations.where(F.col("kind") == kind)))
    return rows.where(_any_contains(query, *(F.col(c) for c in ("targetName", "filePath", "fromName", "toName")))).orderBy("ord")


def symbol_relations(s: Snapshot, name: str) -> DataFrame:
    """Relations that name a symbol or start or end at one of that name: three semi-joins, each row once."""
    named = s.symbols.where(F.lower("name") == name.lower()).select("id")
    rows = named_relations(s)
    parts = [rows.where(F.lower("targetName") == name.lower())]
    for end in ("fromSymbolId", "toSymbolId"):
        parts.append(rows.join(named.withColumnRenamed("id", end), end, "left_semi").select(*rows.columns))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["id"]).orderBy("ord")


def call_graph(s: Snapshot, query: str) -> DataFrame:
    """Relations at the symbol that the query names exactly, or else the first that contains it; `side` is caller or callee."""
    q = query.lower()
    pick = s.symbols.where(F.lower("name").contains(q)).orderBy((F.lower("name") != q), "ord").limit(1).select(F.col("id").alias("center"))
    calls = s.relations.where(F.col("kind") == "calls")
    into = calls.join(F.broadcast(pick), F.col("toSymbolId") == F.col("center")).select(F.lit("caller").alias("side"), *calls.columns)
    out = calls.join(F.broadcast(pick), F.col("fromSymbolId") == F.col("center")).select(F.lit("callee").alias("side"), *calls.columns)
    return into.unionByName(out).orderBy("side", "ord")
