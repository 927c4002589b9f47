"""Sorted immutable runs in a folder, as bucketed tables that Spark merge-joins without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ._store import WHILE_WRITING, Folder, partitions, settings, shared_dir


class SortedRuns:
    """Runs of rows in hash buckets of their key, sorted by it.

    A stored index (`path`) is found again by its path and keeps what it was
    opened with; without a path the runs are in a folder of their own, which
    close() deletes. A run is a folder run-NUMBER-BUCKETS; one that was not
    written to its end doesn't count.
    """

    def __init__(self, spark: SparkSession, name: str, columns: str, key: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.columns, self.key, self.stored = spark, columns, key, path is not None
        self.path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.name = f"{name}_{uuid.uuid4().hex[:12]}"
        whole = lambda run: "_SUCCESS" in Folder(spark, f"{self.path}/{run}").names()
        found = [n for n in Folder(spark, self.path).names() if n.startswith("run-") and whole(n)]
        self.buckets = int(found[0].rsplit("-", 1)[1]) if found else buckets or partitions(spark)
        self.runs: dict[str, str] = {}
        for run in found:
            table = f"{self.name}_{run.split('-')[1]}"
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
            self.runs[run] = table
        self.side: set[str] = set()

    def write(self, rows: DataFrame, table: str, place: str, deal: bool = True) -> DataFrame:
        """Without `deal` the rows of a bucket are known to be in one task already: a shuffle or a merge join by the key has put them there."""
        with settings(self.spark, WHILE_WRITING):
            (rows.repartition(self.buckets, self.key) if deal else rows).write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/{place}").saveAsTable(table)
        return self.spark.table(table)

    def flush(self, rows: DataFrame, deal: bool = True) -> str:
        """Writes rows as a run; returns its name."""
        number = 1 + max((int(r.split("-")[1]) for r in self.runs), default=0)
        run, table = f"run-{number:06d}-{self.buckets}", f"{self.name}_{number:06d}"
        self.write(rows, table, run, deal)
        self.runs[run] = table
        return run

    def beside(self, rows: DataFrame, place: str, deal: bool = True) -> DataFrame:
        """A bucketed table that is no run; forget() drops it."""
        self.side.add(place)
        return self.write(rows, f"{self.name}_{place}", place, deal)

    def forget(self, place: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{place}")
        Folder(self.spark, f"{self.path}/{place}").delete()
        self.side.discard(place)

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(table) for table in self.runs.values()]

    def replace(self, rows: DataFrame, deal: bool = True) -> str:
        """Writes rows as the run that stands for all runs so far, which go."""
        old = dict(self.runs)
        fresh = self.flush(rows, deal)
        for run in old:
            self.drop(run)
        return fresh

    def drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.runs.pop(run)}")
        Folder(self.spark, f"{self.path}/{run}").delete()

    def close(self) -> None:
        for place in list(self.side):
            self.forget(place)
        for table in self.runs.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if not self.stored:
            Folder(self.spark, self.path).delete()

    def __enter__(self):
        return self

    def __exit__(self, *error) -> None:
        self.close()
