"""Lookups and search over stored indexes: the same answers as `lookup` and `search`, from the postings of what is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TERM
from ..schema import Snapshot
from ..sources.postings import Postings, SubstringIndex
from .lookup import named_relations


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct terms of a query, as functions.text.terms() has them."""
    row = spark.range(1).select(F.array_distinct(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(TERM), F.lit(0))).alias("t")).first()
    return list(row.t)


class TextIndexes:
    """The indexes of one snapshot below `path`: of terms, and of substrings of paths, files, symbols and relations.

    build() writes them once; every lookup then reads the postings of its
    needle, verifies the candidates and gives whole rows of the table asked for.
    """

    PARTS = ("terms", "paths", "files", "names", "symbols", "relations")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, s: Snapshot, path: str, parts: tuple[str, ...] = PARTS) -> TextIndexes:
        files = s.files.drop("terms")
        held = F.transform("terms", F.lower)
        if "terms" in parts:
            Postings.build(s.files.select("path", "terms"), f"{path}/terms", held)
        if "paths" in parts:
            SubstringIndex.of(files, f"{path}/paths", F.col("path"))
        if "files" in parts:
            SubstringIndex.of(s.files, f"{path}/files", F.col("path"), F.col("language"), F.col("terms"))
        if "names" in parts:
            known = s.files.select(F.col("path").alias("filePath"), F.lit(True).alias("__filed"))
            SubstringIndex.of(s.symbols.join(known, "filePath", "left").select(*s.symbols.columns, "__filed"), f"{path}/names", F.col("name"))
        if "symbols" in parts:
            SubstringIndex.of(s.symbols, f"{path}/symbols", *(F.col(c) for c in ("name", "filePath", "kind")))
        if "relations" in parts:
            SubstringIndex.of(named_relations(s), f"{path}/relations", *(F.col(c) for c in ("targetName", "filePath", "fromName", "toName")))
        return cls(s.spark, path)

    def substrings(self, part: str) -> SubstringIndex:
        return SubstringIndex(self.spark, f"{self.path}/{part}")

    def terms(self) -> Postings:
        return Postings(self.spark, f"{self.path}/terms")

    def find_symbols(self, query: str) -> DataFrame:
        """As lookup.find_symbols."""
        return self.substrings("names").containing(query).drop("__filed").orderBy("name", "filePath", "startLine")

    def filter_files(self, query: str, language: str | None = None) -> DataFrame:
        """As lookup.filter_files."""
        rows = self.substrings("files").containing(query)
        return (rows if language is None else rows.where(F.col("language") == language)).orderBy("ord")

    def filter_symbols(self, query: str, kind: str | None = None) -> DataFrame:
        """As lookup.filter_symbols."""
        rows = self.substrings("symbols").containing(query)
        return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy("ord")

    def filter_references(self, query: str, kind: str | None = None) -> DataFrame:
        """As lookup.filter_references."""
        rows = self.substrings("relations").containing(query)
        return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy("ord")

    def document_frequencies(self, terms: list[str]) -> dict[str, int]:
        """Files that hold each term; terms that none holds are missing."""
        return self.terms().frequencies([t.lower() for t in terms])

    def lexical_scores(self, query: str) -> DataFrame:
        """As search.lexical_scores: only the files and symbols that match are read."""
        q = query_terms(self.spark, query)
        if not q:
            return self.spark.createDataFrame([], "path string, score double")
        held = self.terms().holding(q).select("path", F.lit(2.0).alias("s"))
        in_path = self.substrings("paths").containing_any(q).select("path", F.lit(1.0).alias("s"))
        named = self.substrings("names").containing_any(q).where("__filed").select(F.col("filePath").alias("path"), F.lit(4.0).alias("s"))
        # A file may hold many symbols of a name: they are summed before the shuffle.
        return held.unionByName(in_path).unionByName(named).groupBy("path").agg(F.sum("s").alias("score"))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        return self.lexical_scores(query).orderBy(F.desc("score"), "path").limit(limit)
