"""The seven tables of a snapshot."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "files": "path string, language string, hash string, size long, modifiedAt double, terms array<string>, ord long",
    "symbols": "id string, filePath string, name string, kind string, startLine int, endLine int, startColumn int, endColumn int, parentId string, ord long",
    "relations": "id string, kind string, filePath string, fromSymbolId string, toSymbolId string, targetName string, line int, confidence double, ord long",
    "chunks": "id string, filePath string, symbolId string, startLine int, endLine int, hash string, text string, ord long",
    "vectors": "chunkId string, chunkHash string, providerId string, dimensions int, values array<double>",
    "metadata": "key string, value string",
}
#: Key of each table.
KEYS = {"files": "path", "symbols": "id", "relations": "id", "chunks": "id", "vectors": "chunkId", "metadata": "key"}


@dataclass(frozen=True)
class Snapshot:
    """One index. Every table may be lazy; `ord` makes the order of records explicit."""

    files: DataFrame
    symbols: DataFrame
    relations: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    metadata: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Snapshot:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @property
    def file_terms(self) -> DataFrame:
        """The inverted index: distinct (filePath, term), lower-cased."""
        return self.files.select(F.col("path").alias("filePath"), F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_(self, **tables: DataFrame) -> Snapshot:
        return replace(self, **tables)

    def counts(self) -> DataFrame:
        """One row with the size of every table."""
        parts = None
        for name, df in self.tables().items():
            if name != "metadata":
                one = df.select(F.lit(name).alias("name"))
                parts = one if parts is None else parts.unionByName(one)
        n = lambda name: F.count_if(F.col("name") == name).alias(f"{name[:-1]}Count")
        return parts.agg(*[n(name) for name in ("files", "symbols", "relations", "chunks", "vectors")])
