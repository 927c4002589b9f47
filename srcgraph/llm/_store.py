"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold while a table is written: small batches of whole texts for Python, so that very long ones don't
#: fill a worker, and no shuffle file outlives the write that needed it.
WHILE_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session may do without: it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="srcgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the time of a block; what was set before comes back."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Folder:
    """A folder of any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def make(self) -> None:
        self._fs.mkdirs(self._at(self.path))

    def names(self) -> list[str]:
        at = self._at(self.path)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def delete(self) -> None:
        self._fs.delete(self._at(self.path), True)

    def delete_at_exit(self) -> None:
        self._fs.deleteOnExit(self._at(self.path))


class Scratch:
    """Named Parquet tables of one operator call; use it in a `with` block.

    Writing a table cuts lineage: a lost executor costs a re-read, not a
    recomputation. The tables are deleted when the block ends, by an error too,
    but for those given to keep(), which the operator's lazy result still reads:
    they go when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        folder = Folder(spark, self.path)
        folder.make()
        folder.delete_at_exit()
        self.count = 0
        self.tables: list[str] = []

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.path}/{self.count:03d}-{name}"
        self.count += 1
        self.tables.append(path)
        with settings(self.spark, WHILE_WRITING):
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.remove(df._scratch_path)
        return df

    def drop(self, df: DataFrame) -> None:
        """Deletes a superseded table."""
        self.tables.remove(df._scratch_path)
        Folder(self.spark, df._scratch_path).delete()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for path in self.tables:
            Folder(self.spark, path).delete()
        self.tables = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add: its own replace them."""
    return df.drop(*names)
