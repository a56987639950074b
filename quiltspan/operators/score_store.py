"""A table of scores in buckets by the unordered pair, of which an update touches only those that it meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut
from .maintenance import unordered, update_scores, without_old

BUCKETS = 1_024


def bucket(buckets: int) -> Column:
    """The bucket of a pair, the same either way round. The number of buckets is fixed when the store is made."""
    return F.pmod(F.xxhash64(*unordered()), F.lit(buckets)).cast("int")


def create(scores: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write ``scores`` (seed, query and others) as a new store: a folder for each bucket, a file or a few in it."""
    rows = scores.withColumn("bucket", bucket(buckets))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def _touched(spark: SparkSession, path: str, pairs: DataFrame, buckets: int) -> tuple[list[int], DataFrame]:
    """The buckets of ``pairs`` (as many numbers as there are buckets at most), and what the store has in them: Spark
    lists the other buckets' files but reads none."""
    met = sorted(r[0] for r in pairs.select(bucket(buckets).alias("b")).distinct().collect())
    return met, spark.read.parquet(path).where(F.col("bucket").isin(met))


def missing(spark: SparkSession, path: str, pairs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The pairs that the store has neither way round."""
    _, old = _touched(spark, path, pairs, buckets)
    return without_old(pairs, old.select("seed", "query"))


def update(spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Put ``new`` in place of the store's scores of the same pairs, either way round, and beside the others; returns
    the buckets that were written. They are put together in the shared folder first, and then replaced one by one: a
    write that fails leaves each bucket as it was or as it should be, and may be run again."""
    met, old = _touched(spark, path, new, buckets)
    if not met:
        return met
    rows = cut(update_scores(old.drop("bucket"), new).withColumn("bucket", bucket(buckets)), "score-buckets")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return met
