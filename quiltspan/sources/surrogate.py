"""Instances, pairs and dimensions derived from the driver's order tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LENGTH = 400


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    rows = lines.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    tool = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "pfam").when(F.col("p_type").isin("MEDIUM", "PROMO"), "smart").otherwise("tmhmm")
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "tool": tool, "start": (1 + (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 41) % 300).cast("int")})
    feature = F.concat_ws("_", "tool", "p_type")
    clan = F.when(F.col("tool") == "pfam", "CL1").when((F.col("tool") == "smart") & (F.col("p_type") == "MEDIUM"), "CL2")
    return rows.select(
        F.col("l_orderkey").alias("protein_id"),
        F.lit(LENGTH).alias("length"),
        "tool",
        F.col("tool").isin("pfam", "smart").alias("linearized"),
        feature.alias("feature"),
        clan.alias("clan"),
        "i",
        "start",
        (F.col("start") + 10 + F.col("l_quantity").cast("int")).alias("stop"),
        F.col("l_discount").alias("evalue"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("protein_id"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.lag("o_orderkey").over(before).alias("seed"), F.col("o_orderkey").alias("query"))
    return rows.where("seed is not null")


def accessions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("pfam_ECONOMY", "IPR000001.3"), ("pfam_SMALL", "IPR000002.1"), ("smart_PROMO", "IPR000003")], "feature string, interpro string")


def profile_lengths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("pfam_ECONOMY", 120), ("smart_MEDIUM", 77)], "feature string, plen int")
