"""Joins of many rows with what is known of some of their keys, without one task for a frequent key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be broadcast (some 100 bytes each as a hash table, so 20 MB).
BROADCAST_ROWS = 200_000
#: A key of more rows doesn't go to one task with them.
HOT = 10_000


def with_known(rows: DataFrame, known: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join with `known`, a stored table of one row per key; its column n says how many rows have the key.

    Few keys, or the hot ones of many, are broadcast: the rows of a hot key stay where they are.
    """
    if known.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(known), on)
    hot = known.where(F.col(n) > HOT)
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return rows.join(known, on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(known.where(F.col(n) <= HOT), on)
    return cold.unionByName(rows.join(F.broadcast(hot), on))
