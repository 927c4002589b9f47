"""Watching a workspace: a stateful stream that refreshes the index when changes have come to rest."""

from __future__ import annotations

import hashlib
import time
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..api import Codebase
from ..sources.scan import walk
from ..sources.staging import shared_root


def settling(root: str, patterns: list[str], include: set[str] | None, delay: float):
    """The state function of a workspace: gives the digest of its listing once, when it has stayed the same for `delay` seconds.

    State: the digest last seen, since when it is the same, and the digest last given.
    """

    def step(key, frames, state):
        for _ in frames:
            pass
        rows = [r for r in walk(root, patterns, include) if r[1] == "accepted"]
        now, digest = time.time(), hashlib.sha256(repr(rows).encode()).hexdigest()
        seen, since, given = state.get if state.exists else ("", now, "")
        if digest != seen:
            seen, since = digest, now
        rest = digest != given and now - since >= delay
        state.update((seen, since, digest if rest else given))
        yield pd.DataFrame({"root": [key[0]] * rest, "digest": [digest] * rest})

    return step


class Watcher:
    """Refreshes `codebase` when its listing differs from the last one indexed and has not changed for `debounce_ms`.

    The file source never reports deletions, so every tick lists names, sizes and times; the stream's state knows when they
    last changed, so several writes in short order are one run. Micro-batches never overlap: runs are single-flight, and
    what changes during one is seen after it.
    """

    def __init__(self, codebase: Codebase, debounce_ms: int = 500):
        self.codebase, self.debounce_ms = codebase, min(60_000, max(50, debounce_ms))
        self.query, self.seen, self.runs, self.last_error, self.last_run = None, None, 0, None, None

    def _listing(self) -> tuple:
        return tuple(self.codebase.listing())

    def tick(self) -> bool:
        """Refreshes at once if anything changed; errors are kept in the status and the next tick tries again."""
        try:
            now = self._listing()
            if now == self.seen:
                return False
            self.codebase.index()
            self.seen, self.runs, self.last_error, self.last_run = now, self.runs + 1, None, time.time()
            return True
        except Exception as e:  # a watcher outlives a bad state of the workspace
            self.last_error = str(e)
            return False

    def _settled(self, batch, _batch_id: int) -> None:
        found = batch.count()  # the whole batch is read, so that its state is kept
        if found or self.last_error is not None:
            self.tick()

    def start(self) -> Watcher:
        if self.query is None:
            spark, c = self.codebase.spark, self.codebase
            ticks = spark.readStream.format("rate").option("rowsPerSecond", max(1, 2000 // self.debounce_ms)).load().select(F.lit(c.root).alias("root"))
            step = settling(c.root, c.patterns, c.include, self.debounce_ms / 1000)
            rest = ticks.groupBy("root").applyInPandasWithState(step, "root string, digest string", "seen string, since double, given string", "update", "NoTimeout")
            before = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", "1")  # one key; the stream keeps what holds when it starts
            try:
                place = f"{shared_root(spark)}/watch-{uuid.uuid4().hex[:12]}"
                self.query = rest.writeStream.outputMode("update").option("checkpointLocation", place).trigger(processingTime=f"{self.debounce_ms} milliseconds").foreachBatch(self._settled).start()
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", before)
        return self

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    def status(self) -> dict:
        return {"watching": self.query is not None and self.query.isActive, "debounceMs": self.debounce_ms, "runs": self.runs, "lastRun": self.last_run, "lastError": self.last_error}
