"""Ranked lexical, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import all_terms, cosine, terms
from ..schema import Snapshot


def lexical_scores(s: Snapshot, query: str, any_symbol: bool = False) -> DataFrame:
    """(path, score) of files with a positive score.

    Per term: 2 for a file that has it, 1 for a path that contains it, 4 for each symbol whose name
    contains it; with any_symbol a symbol counts once, whichever terms it contains. The terms are a
    constant of the plan: files and symbols are read once, and symbols summed before the one shuffle.
    """
    q = terms(F.lit(query))
    held = F.size(F.array_intersect(F.transform("terms", F.lower), q))
    in_path = F.size(F.filter(q, lambda t: F.lower("path").contains(t)))
    in_name = F.size(F.filter(q, lambda t: F.lower("name").contains(t)))
    files = s.files.select("path", (2.0 * held + in_path).alias("own"))
    matched = s.symbols.select(F.col("filePath").alias("path"), (F.least(in_name, F.lit(1)) if any_symbol else in_name).alias("m")).where("m > 0")
    named = matched.groupBy("path").agg((4.0 * F.sum("m")).alias("named"))
    return files.join(named, "path", "left").select("path", (F.col("own") + F.coalesce("named", F.lit(0.0))).alias("score")).where("score > 0")


def search(s: Snapshot, query: str, limit: int = 10, any_symbol: bool = False) -> DataFrame:
    return lexical_scores(s, query, any_symbol).orderBy(F.desc("score"), "path").limit(limit)


def excerpts(s: Snapshot, hits: DataFrame, query: str, length: int = 500) -> DataFrame:
    """Hits with the beginning of the first chunk of the file that contains a term."""
    chunk = s.chunks.where(F.exists(terms(F.lit(query)), lambda t: F.lower("text").contains(t))).join(hits.select(F.col("path").alias("filePath")), "filePath", "left_semi")
    first = chunk.groupBy(F.col("filePath").alias("path")).agg(F.left(F.min_by("text", "ord"), F.lit(length)).alias("excerpt"))
    return hits.join(first, "path", "left").orderBy(F.desc("score"), "path")


def search_all(indexes: dict[str, Snapshot], query: str, limit: int = 50, per_index: bool = False, language: str | None = None, **options) -> DataFrame:
    """Search over several indexes. With per_index each gives its own best `limit` first, and the language is looked at after that."""
    limit = min(100, max(1, limit))
    parts = []
    for uid, s in indexes.items():
        scored = lexical_scores(s, query, **options).join(s.files.select("path", "language"), "path").withColumn("indexUid", F.lit(uid))
        parts.append(scored.orderBy(F.desc("score"), "path").limit(limit) if per_index else scored)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if language is not None:
        out = out.where(F.col("language") == language)
    return out.orderBy(F.desc("score"), "path", "indexUid").limit(limit)


def semantic_search(s: Snapshot, vector: list[float], limit: int = 10, provider: str | None = None) -> DataFrame:
    """Exact cosine over all vectors, joined with their chunks and files; orphans drop out."""
    if not vector or any(x != x or x in (float("inf"), float("-inf")) for x in vector):
        raise ValueError("the query vector must be finite")
    rows = s.vectors if provider is None else s.vectors.where(F.col("providerId") == provider)
    rows = rows.withColumn("score", cosine(F.col("values"), F.array(*[F.lit(float(x)) for x in vector])))
    places = s.chunks.select(F.col("id").alias("chunkId"), "filePath", "startLine", "endLine", "ord").join(s.files.select(F.col("path").alias("filePath")), "filePath", "left_semi")
    best = rows.select("chunkId", "score").join(places, "chunkId").orderBy(F.desc("score"), "ord").limit(limit)
    # Texts are fetched for the best alone.
    out = s.chunks.select(F.col("id").alias("chunkId"), "text").join(F.broadcast(best), "chunkId")
    return out.select("filePath", "chunkId", "startLine", "endLine", "text", "score", "ord").orderBy(F.desc("score"), "ord")


def hybrid_search(s: Snapshot, query: str, vector: list[float] | None = None, limit: int = 10) -> DataFrame:
    """Half the lexical score over the greatest, half the cosine scaled to 0..1; each of the best chunks adds to its file."""
    lexical = search(s, query, 2 * limit)
    if vector is None:
        return lexical.limit(limit)
    top = lexical.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path"))).withColumn("most", F.max("score").over(Window.partitionBy(F.lit(1))))
    words = top.select("path", (0.5 * F.col("score") / F.greatest(F.lit(1.0), F.col("most"))).alias("score"), F.col("rank").cast("long").alias("rank"))
    near = semantic_search(s, vector, 2 * limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord")))
    near = near.select(F.col("filePath").alias("path"), (0.5 * (F.col("score") + 1) / 2).alias("score"), (F.col("rank") + 1_000_000).cast("long").alias("rank"))
    fused = words.unionByName(near).groupBy("path").agg(F.sum("score").alias("score"), F.min("rank").alias("rank"))
    return fused.orderBy(F.desc("score"), "rank").limit(limit).select("path", "score")


def rank_chunks(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks with the number of query terms, repeated ones each time, that they contain."""
    return chunks.withColumn("score", F.size(F.filter(all_terms(F.lit(query)), lambda t: F.lower("text").contains(t))).cast("long"))
