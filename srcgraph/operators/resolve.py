"""Binding of relations to the symbols they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, normalize_target

BOUND_KINDS = ["calls", "extends", "implements", "contains"]
#: Files in a folder that are known by their base name too.
SCRIPT_FILE = r"(?i)/[^/]*\.(ts|js)$"


def _base(path: Column) -> Column:
    return F.lower(F.regexp_replace(basename(path), r"(?i)\.(ts|js)$", ""))


def resolve_relations(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Relations with fresh toSymbolId and confidence.

    An edge to a symbol that is gone loses it, and its confidence falls to .5 at
    most. Unbound edges of four kinds then take the first symbol of their name
    in their own file (.9), anywhere (.72), or by normalised name or by the base
    name of a script file (.72). First is by file and position. Each rule is an equi-join
    with one symbol per key, so no key multiplies rows.
    """
    order = F.struct("filePath", "startLine", "startColumn", "id")

    def first(keys: dict, rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.min_by(F.struct(order.alias("at"), F.col("id")), order).alias(name))

    rows = relations.join(symbols.select(F.col("id").alias("toSymbolId"), F.lit(True).alias("_live")), "toSymbolId", "left")
    dangling = F.col("toSymbolId").isNotNull() & F.col("_live").isNull()
    rows = rows.withColumn("confidence", F.when(dangling, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")))
    rows = rows.withColumn("toSymbolId", F.when(~dangling, F.col("toSymbolId"))).withColumn("_norm", normalize_target(F.col("targetName")))
    base = symbols.where(F.col("filePath").rlike(SCRIPT_FILE)).withColumn("_base", _base(F.col("filePath")))
    rows = rows.join(first({"targetName": F.col("name"), "filePath": F.col("filePath")}, symbols, "_local"), ["targetName", "filePath"], "left")
    rows = rows.join(first({"targetName": F.col("name")}, symbols, "_any"), "targetName", "left")
    rows = rows.join(first({"_norm": F.col("name")}, symbols, "_named"), "_norm", "left")
    rows = rows.withColumn("_key", F.lower("_norm")).join(first({"_key": F.col("_base")}, base, "_file"), "_key", "left")
    open_ = F.col("toSymbolId").isNull() & F.col("kind").isin(BOUND_KINDS)
    found = F.coalesce(F.col("_local.id"), F.col("_any.id"), F.least("_named", "_file")["id"])
    confidence = F.when(open_ & F.col("_local").isNotNull(), 0.9).when(open_ & found.isNotNull(), 0.72).otherwise(F.col("confidence"))
    return rows.withColumn("confidence", confidence).withColumn("toSymbolId", F.when(open_, found).otherwise(F.col("toSymbolId"))).select(*relations.columns)


def resolve_changed(carried: DataFrame, fresh: DataFrame, gone: DataFrame, added: DataFrame, symbols: DataFrame, stage) -> tuple[DataFrame, DataFrame]:
    """Binding after a change, by what changed: (edges of `carried` that come out otherwise, `fresh` edges bound).

    `carried` were resolved before; `gone` and `added` are the symbols that went and came, `symbols` all that there are now.
    An edge that is bound to a symbol that stays keeps it, and one that found nothing finds nothing yet unless its name
    came: so only edges to symbols that went, and unbound ones whose target came, are bound anew, against the symbols of
    their names alone. Equals resolve_relations over all edges and symbols.
    """
    lost = gone.select("id").join(symbols.select("id"), "id", "left_anti").select(F.col("id").alias("toSymbolId")).distinct()
    script = added.where(F.col("filePath").rlike(SCRIPT_FILE)).select(_base(F.col("filePath")).alias("key"))
    came = stage(added.select(F.col("name").alias("key")).distinct(), "came")
    bases = stage(script.distinct(), "bases")
    dangling = carried.join(lost, "toSymbolId", "left_semi").select(*carried.columns)
    loose = carried.where(F.col("toSymbolId").isNull() & F.col("kind").isin(BOUND_KINDS)).withColumn("_norm", normalize_target(F.col("targetName")))
    loose = loose.withColumn("_keys", F.array_distinct(F.array("targetName", "_norm"))).withColumn("_low", F.lower("_norm"))
    by_name = loose.select("*", F.explode("_keys").alias("key")).join(came, "key", "left_semi").select(*carried.columns)
    by_base = loose.join(bases.withColumnRenamed("key", "_low"), "_low", "left_semi").select(*carried.columns)
    todo = stage(dangling.unionByName(by_name).unionByName(by_base).dropDuplicates(["id"]).withColumn("_fresh", F.lit(False)).unionByName(fresh.withColumn("_fresh", F.lit(True))), "todo")
    # The symbols that these edges can meet: those they are bound to, and those of their names.
    ids = todo.select(F.col("toSymbolId").alias("id")).where("id IS NOT NULL").distinct()
    norm = normalize_target(F.col("targetName"))
    names = todo.select(F.explode(F.array("targetName", norm)).alias("name")).distinct()
    lows = todo.select(F.lower(norm).alias("_base")).distinct()
    met = symbols.join(ids, "id", "left_semi").select(*symbols.columns).unionByName(symbols.join(names, "name", "left_semi").select(*symbols.columns))
    scripts = symbols.where(F.col("filePath").rlike(SCRIPT_FILE)).withColumn("_base", _base(F.col("filePath"))).join(lows, "_base", "left_semi").select(*symbols.columns)
    met = stage(met.unionByName(scripts).dropDuplicates(["id"]), "met")
    bound = stage(resolve_relations(todo, met), "bound")
    before = todo.where("NOT _fresh").select("id", F.col("toSymbolId").alias("_to"), F.col("confidence").alias("_confidence"))
    other = ~(F.col("toSymbolId").eqNullSafe(F.col("_to")) & F.col("confidence").eqNullSafe(F.col("_confidence")))
    changed = bound.where("NOT _fresh").join(before, "id").where(other).select(*carried.columns)
    return changed, bound.where("_fresh").select(*carried.columns)


def resolution_report(before: DataFrame, after: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: edges that lost their symbol, and edges bound since."""
    live = symbols.select(F.col("id").alias("toSymbolId"))
    gone = before.where("toSymbolId IS NOT NULL").join(live, "toSymbolId", "left_anti").agg(F.count("*").alias("invalidated"))
    unbound = lambda df: df.where(F.col("toSymbolId").isNull() & F.col("kind").isin(BOUND_KINDS)).agg(F.count("*").alias("n"))
    both = gone.crossJoin(unbound(before).withColumnRenamed("n", "b")).crossJoin(unbound(after).withColumnRenamed("n", "a"))  # single rows
    return both.select("invalidated", F.greatest(F.lit(0), F.col("b") + F.col("invalidated") - F.col("a")).cast("long").alias("resolved"))
