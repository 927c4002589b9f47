"""How filters work together: what each removes at every place of every order of them.

All orders of the filters are the paths of a trie. What is left after a prefix
depends on the set of its filters alone, so prefixes of one set share a state:
the survivors, as a persisted DataFrame, and one table of counts. The trie is
walked depth first. A state's survivors are those of the state before, less
what one more filter removes, and are given back when all that follows from
them is counted. Of n filters 2^n - 1 states are counted instead of n! orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from .exact_dedup import BROADCAST_ROWS, HOT, sha256

#: Words of whole texts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Conditions under which a document of measures() fails.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_upper > 5 * n_chars",
    "D": "has_symbol",
    "E": "is_copy",
}
LOSSES = {"good_lost": "quality = 1", "toxic_lost": "toxic = 1"}


def _copies(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with is_copy: a smaller identifier has the same digest. Few repeated digests, or the hot ones of many, are broadcast."""
    first = scratch.write(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last"), "first")
    if first.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(first), "digest", "left")
    else:
        hot = first.where(F.col("n") > HOT)
        if 0 < hot.count() <= BROADCAST_ROWS:
            cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(first.where(F.col("n") <= HOT), "digest", "left")
            joined = cold.unionByName(rows.join(F.broadcast(hot), "digest"))
        else:
            joined = rows.join(first, "digest", "left")
    return joined.withColumn("is_copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))


def measures(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per document with what FILTERS and LOSSES ask for: part, n_words, n_distinct, n_upper, n_chars, has_symbol, is_copy, quality, toxic.

    Whole texts; a null one is empty. A null part is the empty string. A document
    with several rows of labels has a label if any of them has it; one without
    has none. A null identifier is a document of its own: never a copy, without labels.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.select(
        "id", "part", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"), F.length("text").alias("n_chars"),
        (F.length("text") - F.length(F.translate("text", UPPER, ""))).alias("n_upper"), F.col("text").rlike(r"[#$%&*|]").alias("has_symbol"), sha256(F.col("text")).alias("digest"),
    )
    rows = _copies(scratch.write(rows, "measures"), scratch)
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(quality_col).alias("quality"), F.max(toxic_col).alias("toxic"))
    return rows.join(marks, "id", "left").drop("id", "digest", "first", "n")


def _counted(survivors: DataFrame, left: dict[str, Column], losses: dict[str, Column]) -> DataFrame:
    """Per part: documents, and for each filter that is left those it removes now, in all and of each loss. In one pass."""
    sums = lambda more: F.array(*[F.count_if(c if more is None else c & more) for c in left.values()])
    return survivors.groupBy("part").agg(F.count("*").alias("documents"), sums(None).alias("removed"), *[sums(m).alias(name) for name, m in losses.items()])


def audit(rows: DataFrame, filters: dict[str, str], losses: dict[str, str], scratch: Scratch) -> DataFrame:
    """One row per part, order of all filters (their names joined) and step, zeros included.

    rows has a column part. A filter is the SQL condition under which a row
    fails, a loss one that marks rows to be counted where they are removed; a
    condition that is null doesn't hold. Columns: part, filter_order, step (from
    1), kept, removed, redundant, unique_fails, each loss, shapley. Rows without
    any part give an empty result. The result is as large as the parts times the
    orders; nothing but the names of filters is held by the driver.
    """
    names = list(filters)
    bit = {f: 1 << i for i, f in enumerate(names)}
    condition = {f: F.coalesce(F.expr(c), F.lit(False)) for f, c in filters.items()}
    marks = {m: F.coalesce(F.expr(c), F.lit(False)) for m, c in losses.items()}
    counted: dict[int, DataFrame] = {}

    def visit(state: int, survivors: DataFrame) -> None:
        """Counts what each filter that is left removes from a state's survivors, then goes on with each."""
        left = {f: c for f, c in condition.items() if not state & bit[f]}
        if len(left) > 1:
            survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counted[state] = scratch.write(_counted(survivors, left, marks).withColumn("state", F.lit(state)), "state").select(
                "part", "state", "documents", *[F.map_from_arrays(F.array(*map(F.lit, left)), m).alias(m) for m in ("removed", *marks)]
            )
            for f, fails in left.items():
                if len(left) > 1 and state | bit[f] not in counted:
                    visit(state | bit[f], survivors.where(~fails))
        finally:
            if len(left) > 1:
                survivors.unpersist()

    visit(0, rows)
    states = None
    for one in counted.values():
        states = one if states is None else states.unionByName(one)
    # One row per part: its at most 2^n - 1 states as maps.
    of = lambda c: F.map_from_entries(F.collect_list(F.struct("state", c))).alias(c)
    parts = scratch.write(states.groupBy("part").agg(of("documents"), *[of(m) for m in ("removed", *marks)]), "parts")
    zero = F.lit(0).cast("long")
    at = lambda m, state, f: F.coalesce(F.col(m)[state][f], zero)
    everyone = sum(bit.values())

    def shapley(f: str) -> Column:
        """Removals of f over all orders: a state stands in as many as its filters, and those after f, have orders."""
        others = [s for s in range(everyone) if not s & bit[f]]
        size = lambda s: bin(s).count("1")
        return sum((factorial(size(s)) * factorial(len(names) - 1 - size(s)) * at("removed", F.lit(s), F.lit(f)) for s in others), zero)

    per_filter = F.create_map(*[x for f in names for x in (F.lit(f), F.struct(shapley(f).alias("shapley"), at("removed", F.lit(0), F.lit(f)).alias("fails"), at("removed", F.lit(everyone - bit[f]), F.lit(f)).alias("alone")))])
    steps = [(order, k + 1, sum(bit[g] for g in order[:k]), order[k]) for order in permutations(names) for k in range(len(names))]
    listed = "".join(f',{{"filter_order":"{"".join(o)}","step":{k},"state":{s},"f":"{f}"}}' for o, k, s, f in steps)
    plan = F.from_json(F.lit(f"[{listed[1:]}]"), "array<struct<filter_order:string,step:int,state:int,f:string>>")
    out = parts.withColumn("filters", per_filter).select("*", F.explode(plan).alias("p"))
    here = lambda m: at(m, F.col("p.state"), F.col("p.f"))
    own = F.col("filters")[F.col("p.f")]
    return out.select(
        "part", "p.filter_order", "p.step", (F.coalesce(F.col("documents")[F.col("p.state")], zero) - here("removed")).alias("kept"), here("removed").alias("removed"),
        (own["fails"] - here("removed")).alias("redundant"), own["alone"].alias("unique_fails"), *[here(m).alias(m) for m in marks], own["shapley"].alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, **columns: str) -> DataFrame:
    """audit() of FILTERS, or others on measures(), over documents and their labels. Further columns of both are not read.

    An empty table of documents gives an empty result, an empty table of labels no losses.
    """
    with Scratch(docs.sparkSession, "audit") as scratch:
        rows = scratch.write(measures(docs, labels, scratch, **columns), "rows")
        out = audit(rows, filters or FILTERS, LOSSES, scratch)
        return scratch.keep(scratch.write(out, "audit"))
