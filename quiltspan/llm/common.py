"""What the operators of this subpackage share: reading, batches of texts, and connected components."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, new_path, shared_dir

__all__ = ["WORD", "ascii_lower", "connected_components", "cut", "new_path", "shared_dir", "table", "text_batches", "unused_name"]

#: Words as the contracts define them: maximal runs without space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame, rows: int = 1000, mbytes: int = 8) -> DataFrame:
    """``df``, after bounding the rows and bytes of a batch that goes to a Python worker: whole texts are long, and a
    batch is held several times over (in the JVM, in the pipe and in the worker). These are options of the session;
    Spark has none for a single plan. Tighter ones of the caller's stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mbytes << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < _bytes(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?[0-9]+)\s*([kmgt]?)b?\s*", setting.lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star contraction.

    ``edges``: columns a, b (long). Returns node, root (the smallest node of the component) for every node that has
    an edge to another node. Each half round is one min-aggregation and one equi-join on the node; minima are
    combined before the shuffle, and both join sides are shuffled, so that Spark can split a hub's rows. The edge
    list never grows, and every half round is written to the shared folder.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        """e: a > b. Hang each node's larger (or else smaller) neighbours on its smallest neighbour."""
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return cut(out.where("a > b").distinct(), "edges")

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(e)
    if before[0]:
        for _ in range(rounds):
            e = star(star(e, True), False)
            now = mark(e)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
