"""The synthetic tables seen as a snapshot: documents are files, parts and suppliers symbols, order lines relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sha_prefix, terms
from ..schema import SCHEMAS, Snapshot


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path():
    return F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        doc_path().alias("path"), F.coalesce("lang", F.lit("none")).alias("language"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"), F.col("n_chars").alias("size"),
        F.lit(0.0).alias("modifiedAt"), terms(F.coalesce("text", F.lit(""))).alias("terms"), F.col("doc_id").alias("ord"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier, nation = (read(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    none = F.lit(None).cast("string")
    one = part.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), F.lower("p_type"), F.lit("/m"), (F.col("p_partkey") % 7).cast("string"), F.lit(".ts")).alias("filePath"),
        F.col("p_name").alias("name"), F.lit("method").alias("kind"), F.col("p_size").alias("startLine"), (F.col("p_size") + 5).alias("endLine"), F.lit(0).alias("startColumn"), F.lit(0).alias("endColumn"), none.alias("parentId"), F.col("p_partkey").alias("ord"),
    )
    two = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("nations/"), "n_name", F.lit(".ts")).alias("filePath"), F.col("s_name").alias("name"), F.lit("class").alias("kind"),
        F.lit(1).alias("startLine"), F.lit(9).alias("endLine"), F.lit(0).alias("startColumn"), F.lit(0).alias("endColumn"), none.alias("parentId"), (F.col("s_suppkey") + 100_000_000).alias("ord"),
    )
    return one.unionByName(two)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    supplier = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("nations/"), "n_name", F.lit(".ts")).alias("filePath"))
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "extends").otherwise("references")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), kind.alias("kind"), "filePath", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("fromSymbolId"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("toSymbolId"), F.col("p_name").alias("targetName"), F.col("l_linenumber").alias("line"), (1 - F.col("l_discount")).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for every line of a document."""
    rows = read(spark, sf_dir, "documents").select(doc_path().alias("filePath"), "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    return rows.select(
        sha_prefix(F.concat_ws(":", "filePath", F.col("pos").cast("string"))).alias("id"), "filePath", F.lit(None).cast("string").alias("symbolId"), (F.col("pos") + 1).alias("startLine"), (F.col("pos") + 1).alias("endLine"),
        F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "text", (F.col("doc_id") * 100_000 + F.col("pos")).alias("ord"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunkId"), F.lit("").alias("chunkHash"), F.lit("table").alias("providerId"), F.size("embedding").alias("dimensions"), F.col("embedding").cast("array<double>").alias("values"))


def snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    return Snapshot(files(spark, sf_dir), symbols(spark, sf_dir), relations(spark, sf_dir), chunks(spark, sf_dir), vectors(spark, sf_dir), spark.createDataFrame([], SCHEMAS["metadata"]))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): orders between nations of suppliers and of customers, without those inside one."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    rows = line.join(supplier, "l_suppkey").join(orders, "l_orderkey").join(customer, "o_custkey")
    return rows.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def partners(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """Each nation's k largest partners: a sparse graph of at most 25 k edges."""
    order = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return trade(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "dst", "n")
