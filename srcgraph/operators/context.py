"""Selection of files, chunks, symbols and relations for a question under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Snapshot
from .graph import _cut
from .search import rank_chunks, search


def related_files(s: Snapshot, seeds: DataFrame, limit: int) -> DataFrame:
    """Files that edges join to the seeds(path), by summed confidence.

    The seeds' symbols are written first, so their size is known; only edges that touch one, or that
    stand in a seed, meet the symbols of all files.
    """
    seeds = _cut(seeds.select("path").distinct())
    own = _cut(s.symbols.join(F.broadcast(seeds.withColumnRenamed("path", "filePath")), "filePath", "left_semi").select("id").distinct())
    touches = lambda end: own.select(F.col("id").alias(f"{end}SymbolId"), F.lit(True).alias(f"_{end}"))
    stands = F.broadcast(seeds.select(F.col("path").alias("filePath"), F.lit(True).alias("_in")))
    near = s.relations.join(touches("from"), "fromSymbolId", "left").join(touches("to"), "toSymbolId", "left").join(stands, "filePath", "left").where("_from OR _to OR _in")
    at = lambda end: s.symbols.select(F.col("id").alias(f"{end}SymbolId"), F.col("filePath").alias(end))
    rows = near.join(at("from"), "fromSymbolId", "left").join(at("to"), "toSymbolId", "left")
    rows = rows.select(F.coalesce("from", "filePath").alias("a"), F.col("to").alias("b"), "confidence").where("b IS NOT NULL AND a <> b")
    both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
    seeded = both.join(F.broadcast(seeds.select(F.col("path").alias("a"))), "a", "left_semi").join(F.broadcast(seeds.select(F.col("path").alias("b"))), "b", "left_anti")
    return seeded.groupBy(F.col("b").alias("path")).agg(F.sum("confidence").alias("weight")).orderBy(F.desc("weight"), "path").limit(max(0, limit))


def pack(ranked: DataFrame, budget: int) -> DataFrame:
    """Chunks taken in order of score while they fit; one that doesn't is passed over. Adds `cost`, a quarter of the characters, rounded up.

    One fold over (order, cost) of the chunks of the selected files.
    """
    rows = ranked.withColumn("cost", F.ceil(F.length("text") / 4).cast("long"))
    order = F.struct((-F.col("score")).alias("s"), "startLine", "ord", "id", "cost")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))
    step = lambda acc, x: F.when(acc["used"] + x["cost"] <= budget, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"))).otherwise(acc)
    taken = rows.agg(F.aggregate(F.array_sort(F.collect_list(order)), start, step).alias("t")).select(F.explode("t.ids").alias("id"))
    return rows.join(F.broadcast(taken), "id", "left_semi")


def choose_files(s: Snapshot, query: str, max_files: int = 8, max_related: int = 4) -> DataFrame:
    """(path) of the best files of a search over all files, and then of files related to them."""
    seeds = _cut(search(s, query, max(1, max_files - min(max_related, max_files - 1))).select("path"))
    n = seeds.count()
    related = related_files(s, seeds, min(max_files - n, max_related)).select("path")
    return seeds.unionByName(related)


def pack_files(s: Snapshot, chosen: DataFrame, query: str, max_tokens: int) -> DataFrame:
    own = s.chunks.join(F.broadcast(chosen.withColumnRenamed("path", "filePath")), "filePath", "left_semi")
    return pack(rank_chunks(own, query), max_tokens)


def get_context(s: Snapshot, query: str, max_files: int = 8, max_tokens: int = 4000, max_related: int = 4) -> dict:
    # What is chosen is small, by its limits, and read many times.
    chosen = _cut(choose_files(s, query, max_files, max_related))
    files = s.files.join(F.broadcast(chosen), "path", "left_semi")
    chunks = _cut(pack_files(s, chosen, query, max_tokens))
    start = chunks.where("symbolId IS NOT NULL").select(F.col("symbolId").alias("id")).distinct()
    hop = lambda a, b: s.relations.join(start.withColumnRenamed("id", a), a, "left_semi").where(F.col(b).isNotNull()).select(F.col(b).alias("id"))
    ids = _cut(start.unionByName(hop("fromSymbolId", "toSymbolId")).unionByName(hop("toSymbolId", "fromSymbolId")).distinct())
    symbols = s.symbols.join(ids, "id", "left_semi")
    parts = [s.relations.join(ids.withColumnRenamed("id", end), end, "left_semi").select(*s.relations.columns) for end in ("fromSymbolId", "toSymbolId")]
    parts.append(s.relations.join(F.broadcast(chosen.withColumnRenamed("path", "filePath")), "filePath", "left_semi").select(*s.relations.columns))
    relations = parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["id"])
    return {"files": files, "chunks": chunks.orderBy(F.desc("score"), "startLine"), "symbols": symbols, "relations": relations, "estimatedTokens": chunks.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("n")).first()[0]}
