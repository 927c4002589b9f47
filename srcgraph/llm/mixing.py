"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in identifier order, form blocks. With weight w, block i
(from 1) is released at slot floor((i-1)/w) and due by slot ceil(i/w). Earliest
deadline first gives each slot to one source, and after any number of slots no
source is a whole block away from its target. Weights are whole shares of a
period, so the schedule repeats and one period of it, bounded by `period`, is
all that is ever simulated; a document's slot follows from its rank by arithmetic.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import Scratch, partitions, without

#: Share of all sources that the weights do not name.
OTHERS = "*"


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares that sum to period, by largest remainder, one at least."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if len(weights) > period:
        raise ValueError("the period must have a slot for each source")
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    out = {s: max(1, floor(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s)):
        if sum(out.values()) >= period:
            break
        out[s] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s] - exact[s], out[s], s))] -= 1
    return out


def schedule(share: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period as (source, i, slot, release, deadline), earliest deadline first among released blocks."""
    period = sum(share.values())
    weight = {s: Fraction(n, period) for s, n in share.items()}
    done = dict.fromkeys(share, 0)
    out = []
    for slot in range(period):
        ready = [(ceil((done[s] + 1) / weight[s]), -n, s) for s, n in share.items() if done[s] < n and floor(done[s] / weight[s]) <= slot]
        deadline, _, s = min(ready)
        release = floor(done[s] / weight[s])
        done[s] += 1
        out.append((s, done[s], slot, release, deadline))
    return out


def mix(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source_col: str = "source", block: int = 64, period: int = 1000, bucket_rows: int = 1_000_000) -> DataFrame:
    """All input rows and columns, with mix_source, mix_block, mix_slot, mix_release, mix_deadline and mix_offset.

    Ordered by (mix_slot, mix_offset) the rows are the mixture. No row is
    dropped or repeated: when a source has no blocks left its slots stay empty,
    and `mix_on_target` is true for the slots before any source ran out of full blocks. Sources
    that the weights do not name, null included, share the weight of "*" (they
    raise an error if there is none). Rows that repeat under one identifier share
    a position; null identifiers come first. Identifiers are integers. An empty table
    gives an empty result, texts are carried whole, and columns of the added names are
    replaced. Ranks follow the identifiers at every
    size. They are counted in two levels, ranges of at most about `bucket_rows`
    identifiers and identifiers within them, so that no task holds a whole source.
    """
    docs = without(docs, "mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_offset", "mix_on_target")
    spark = docs.sparkSession
    share = shares(weights, period)
    plan = schedule(share)
    # The template: at most `period` rows.
    slots = spark.sql(
        "SELECT * FROM VALUES " + ", ".join(f"({_quoted(s)}, {i}L, {slot}L, {release}L, {deadline}L)" for s, i, slot, release, deadline in plan)
        + " AS t(mix_source, __sg_i, __sg_slot, __sg_release, __sg_deadline)"
    )
    named = F.col(source_col).isin(*[s for s in share if s != OTHERS])
    source = F.when(named, F.col(source_col)).otherwise(F.lit(OTHERS) if OTHERS in share else F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce(F.col(source_col).cast("string"), F.lit("null")))))
    rows = docs.withColumn("mix_source", source).withColumn("__sg_id", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    # Ranks are found on identifiers alone; whole rows move once, dealt by identifier.
    with Scratch(spark, "mix") as scratch:
        placed, horizon = _placed(rows, share, plan, slots, block, period, bucket_rows, scratch)
    out = rows.join(placed, ["mix_source", "__sg_id"])
    return out.select(
        *[F.col(c) for c in docs.columns], "mix_source", "mix_block", "mix_slot",
        (F.col("__sg_round") + F.col("__sg_release")).alias("mix_release"), (F.col("__sg_round") + F.col("__sg_deadline")).alias("mix_deadline"),
        F.pmod(F.col("__sg_rank"), F.lit(block)).alias("mix_offset"), (F.col("mix_slot") < F.lit(horizon)).alias("mix_on_target"),
    )


def _placed(rows: DataFrame, share: dict[str, int], plan: list, slots: DataFrame, block: int, period: int, bucket_rows: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Rank, block and slot of each (source, identifier), and the first slot that lacks a full block."""
    spark = rows.sparkSession
    ids = scratch.write(rows.select("mix_source", "__sg_id").distinct(), "ids")
    spread = scratch.write(ids.groupBy("mix_source").agg(F.count("*").alias("__sg_source_n")), "spread")  # as many rows as weights at most
    # Ranges of (source, identifier) in order: a row's number is its range in the upper bits and its place in the range below.
    total = spread.agg(F.coalesce(F.sum("__sg_source_n"), F.lit(0))).first()[0]
    ranges = max(partitions(spark), ceil(total / bucket_rows))
    celled = ids.repartitionByRange(ranges, "mix_source", "__sg_id").sortWithinPartitions("mix_source", "__sg_id").withColumn("__sg_at", F.monotonically_increasing_id())
    celled = scratch.keep(scratch.write(celled, "ranges")).withColumn("__sg_bucket", F.shiftright("__sg_at", 33))
    cells = celled.groupBy("mix_source", "__sg_bucket").agg(F.count("*").alias("__sg_in"), F.min("__sg_at").alias("__sg_first"))  # ranges and weights in number at most
    before = F.sum("__sg_in").over(Window.partitionBy("mix_source").orderBy("__sg_bucket").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("mix_source", "__sg_bucket", "__sg_first", F.coalesce(before, F.lit(0).cast("long")).alias("__sg_before"))
    ranked = celled.join(F.broadcast(cells), ["mix_source", "__sg_bucket"])
    ranked = ranked.select("mix_source", "__sg_id", (F.col("__sg_before") + F.col("__sg_at") - F.col("__sg_first")).alias("__sg_rank"))
    of = F.create_map(*[x for s, n in share.items() for x in (F.lit(s), F.lit(n).cast("long"))])
    ranked = ranked.withColumn("mix_block", F.floor(F.col("__sg_rank") / F.lit(block)) + 1).withColumn("__sg_share", of[F.col("mix_source")])
    ranked = ranked.withColumn("__sg_i", F.pmod(F.col("mix_block") - 1, F.col("__sg_share")) + 1).withColumn("__sg_round", F.floor((F.col("mix_block") - 1) / F.col("__sg_share")) * F.lit(period))
    # Slots before the first full block that some source lacks.
    lacking = spread.withColumn("__sg_b", F.floor(F.col("__sg_source_n") / F.lit(block)) + 1).withColumn("__sg_share", of[F.col("mix_source")])
    lacking = lacking.withColumn("__sg_i", F.pmod(F.col("__sg_b") - 1, F.col("__sg_share")) + 1).join(F.broadcast(slots), ["mix_source", "__sg_i"])
    ends = lacking.select((F.floor((F.col("__sg_b") - 1) / F.col("__sg_share")) * F.lit(period) + F.col("__sg_slot")).alias("__sg_end"))
    seen = {r[0] for r in spread.select("mix_source").collect()}  # no more than the weights
    first_absent = min((slot for s, i, slot, _, _ in plan if i == 1 and s not in seen), default=None)
    horizon = ends.agg(F.min("__sg_end")).first()[0]
    horizon = min(x for x in (horizon, first_absent, 1 << 62) if x is not None)
    placed = ranked.join(F.broadcast(slots), ["mix_source", "__sg_i"]).withColumn("mix_slot", F.col("__sg_round") + F.col("__sg_slot"))
    return placed, horizon


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
