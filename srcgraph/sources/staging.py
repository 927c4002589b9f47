"""Intermediate tables of one run, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may do without: it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="srcgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared file system, by its plain path; it goes when the application ends."""
    root = shared_root(spark)
    if "://" in root and not root.startswith("file://"):
        raise RuntimeError("a workspace needs a mounted folder")
    path = f"{root.removeprefix('file://')}/{name}-{uuid.uuid4().hex[:12]}"
    os.makedirs(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


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


class Staging:
    """Named Parquet tables below spark.checkpoint.dir; they go when the run ends.

    A staged table cuts lineage: what follows reads it as often as it needs, and a
    lost executor costs a re-read instead of another scan of the workspace.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_root(spark)}/run-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *exc) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{self.count:03d}-{name}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame, name: str) -> DataFrame:
    """For callers that stage nothing."""
    return df
