"""A training corpus from raw documents, in five stages.

Each stage takes all rows its predecessor kept, is written as Parquet in the
shared folder and read again, so a lost executor never reaches back past it.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcgraph.llm import decontaminate, exact_dedup, language, mixing, near_dedup
from srcgraph.llm._store import Scratch, table
from srcgraph.llm.queries import MIX_BLOCK, MIX_PERIOD, WEIGHTS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: null, empty or letterless texts, and those no language explains best."""
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one row of each group of texts that are equal but for the case of A-Z, null and empty ones being equal: that with the least identifier."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group that links of 75 in 100 five-word shingles join: that with the least identifier. Texts without words stay."""
    return near_dedup.drop_near_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of ten words of a benchmark item occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's place in the mixture; none is dropped."""
    return mixing.mix(docs, WEIGHTS, block=MIX_BLOCK, period=MIX_PERIOD)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("source_mixing", mix_sources),
]

#: Language identification is not expressible in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. The tables of the stages before it are deleted when it is written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        return scratch.keep(docs)
