"""Line deduplication by overlapping windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, without

WINDOW = 3
#: Repeated windows that may be broadcast (some 150 bytes each as a hash table, so 30 MB).
BROADCAST_ROWS = 200_000
#: A window of so many occurrences doesn't go to one task with them.
HOT = 10_000


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct identifier and text with covered lines: _id, _print, removed (array of line numbers from 0).

    A window is `window` consecutive lines, as they are; windows of blank lines
    only don't count. Its first occurrence, by identifier and then line, stays;
    all lines that a later occurrence covers go. Windows carry a 128-bit digest of their bytes.
    """
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).contains("\n")).select(
        F.col(id_col).alias("__sg_id"), F.xxhash64(F.col(text_col)).alias("__sg_print"), F.split(F.col(text_col), "\n").alias("__sg_lines")
    )
    starts = F.when(F.size("__sg_lines") >= window, F.sequence(F.lit(0), F.size("__sg_lines") - window)).otherwise(F.array().cast("array<int>"))
    rows = base.select("__sg_id", "__sg_print", "__sg_lines", F.explode(starts).alias("__sg_at"))
    content = F.concat_ws("\n", F.slice("__sg_lines", F.col("__sg_at") + 1, window))
    rows = rows.select("__sg_id", "__sg_print", "__sg_at", content.alias("__sg_window")).where(F.length(F.regexp_replace("__sg_window", "\\s", "")) > 0)
    with Scratch(docs.sparkSession, "lines") as scratch:
        windows = scratch.write(rows.select(F.unhex(F.md5(F.col("__sg_window"))).alias("__sg_key"), "__sg_id", "__sg_print", "__sg_at"), "windows")
        # One row per repeated window, from partial minima: frequent windows shrink before the shuffle.
        first = windows.groupBy("__sg_key").agg(F.min(F.struct("__sg_id", "__sg_at", "__sg_print")).alias("__sg_first"), F.count("*").alias("__sg_n")).where("__sg_n > 1")
        first = scratch.write(first, "first")
        later = _with_first(windows, first).where(F.struct("__sg_id", "__sg_at", "__sg_print") > F.col("__sg_first"))
        covered = later.groupBy("__sg_id", "__sg_print").agg(F.collect_set("__sg_at").alias("__sg_starts"))
        steps = F.array(*[F.lit(i) for i in range(window)])
        lines = F.array_sort(F.array_distinct(F.flatten(F.transform("__sg_starts", lambda s: F.transform(steps, lambda i: s + i)))))
        return scratch.keep(scratch.write(covered.select("__sg_id", "__sg_print", lines.alias("removed")), "removed"))


def _with_first(windows: DataFrame, first: DataFrame) -> DataFrame:
    """Windows that repeat, with their first occurrence. Few repeated windows, or the frequent ones of many, are broadcast."""
    if first.count() <= BROADCAST_ROWS:
        return windows.join(F.broadcast(first), "__sg_key")
    hot = first.where(F.col("__sg_n") > HOT)
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return windows.join(first, "__sg_key")
    cold = windows.join(F.broadcast(hot.select("__sg_key")), "__sg_key", "left_anti").join(first.where(F.col("__sg_n") <= HOT), "__sg_key")
    return cold.unionByName(windows.join(F.broadcast(hot), "__sg_key"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The input's rows and columns, with n_lines, n_removed and kept_text.

    A null text has no lines and stays null; a text of fewer lines than a
    window, or empty, is kept whole, as are rows with a null identifier. Rows
    that repeat under one identifier with one text are one document. An empty
    table gives an empty result; texts of any length are read whole. Further
    columns stay, but columns of the added names are replaced.
    """
    docs = without(docs, "n_lines", "n_removed", "kept_text")
    names = docs.columns
    removed = repeated_lines(docs, id_col, text_col, window)
    rows = docs.withColumn("__sg_print", F.xxhash64(F.col(text_col)))
    removed = removed.select(F.col("__sg_id").alias("__sg_rid"), F.col("__sg_print").alias("__sg_rprint"), F.col("removed").alias("__sg_removed"))
    # Merged at every size: were they few enough to broadcast, their lists of lines would pass through the driver up to some size, and the plan would change there.
    out = rows.join(removed.hint("merge"), (F.col(id_col) == F.col("__sg_rid")) & (F.col("__sg_print") == F.col("__sg_rprint")), "left")
    # Columns of their own, so that no line is split or looked for anew for another: the time grows with the lines.
    lines = F.col("__sg_lines")
    out = out.withColumn("__sg_gone", F.coalesce(F.col("__sg_removed"), F.array().cast("array<int>"))).withColumn("__sg_lines", F.split(F.col(text_col), "\n"))
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__sg_gone"))
    kept = F.transform(stays, lambda i: F.get(lines, i))
    return out.select(
        *[F.col(c) for c in names],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.size("__sg_gone").cast("long").alias("n_removed"),
        F.when(F.size("__sg_gone") == 0, F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
