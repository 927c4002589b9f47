"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


#: A node with more links is heavy. There are at most 2 / HEAVY as many as links, and up to BROADCAST_ROWS are broadcast (16 bytes each).
HEAVY, BROADCAST_ROWS = 1024, 500_000


def _with_least(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """Rows (u, v) with the m of their u, of so many links. Those of heavy nodes stay where they are."""
    if not HEAVY < links <= BROADCAST_ROWS * HEAVY // 2:
        return rows.join(least.select("u", "m"), "u")
    heavy = F.broadcast(least.where(F.col("c") > HEAVY).select("u", "m"))
    light = rows.join(heavy.select("u"), "u", "left_anti").join(least.where(F.col("c") <= HEAVY).select("u", "m"), "u")
    return light.unionByName(rows.join(heavy, "u"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) of every linked node, comp being the least node it reaches. links: (a, b), long.

    Links stay in shared tables; each round takes one minimum per node, from
    partial minima, so a node with very many links is one partial row per task.
    """
    down = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.write(down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large = _with_least(both, low, mark[0]).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))  # v is the greater
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        fresh = scratch.write(down(small), "links")
        scratch.drop(edges)
        edges, old, mark = fresh, mark, _mark(fresh)
        if old == mark:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
