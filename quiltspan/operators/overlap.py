"""Overlap statistics of two tools' annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _posted(spans: DataFrame, top: str, own: bool) -> DataFrame:
    """The intervals (start, stop) under bins: an interval of class c is at most 2^c long and lies in two bins of that
    width at most. ``own``: bins of its class alone; otherwise of the wider classes too, up to the column ``top``."""
    c = F.col("class")
    levels = F.array(c) if own else F.sequence(c, F.greatest(c, F.col(top)))
    rows = spans.withColumn("level", F.explode(levels))
    bins = F.sequence(F.call_function("shiftright", F.least("start", "stop"), F.col("level")), F.call_function("shiftright", F.greatest("start", "stop"), F.col("level")))
    return rows.withColumn("bin", F.explode(bins))


def overlapping(instances: DataFrame, tool: str, other: str, threshold: float) -> DataFrame:
    """Instances of ``tool``, each marked by whether one of ``other`` overlaps it by the share ``threshold`` of both.

    The overlap is taken from the later start to the end of the interval that starts first. Two intervals meet in
    bins as wide as the longer one's class: the longer is posted under its own class, the shorter under all that are
    wider as well, so that an interval is compared with those that are near it, not with all of its protein.
    """
    spans = instances.where(F.col("tool").isin(tool, other)).select("protein_id", "tool", "i", "feature", "start", "stop")
    spans = spans.withColumn("class", F.length(F.bin(F.greatest(F.abs(F.col("stop") - F.col("start")), F.lit(1)))))
    spans = spans.withColumn("top", F.max("class").over(Window.partitionBy("protein_id")))
    a = spans.where(F.col("tool") == tool).drop("tool")
    b = spans.where(F.col("tool") == other).select("protein_id", "start", "stop", "class", "top")
    inside = F.when(F.col("start").between(F.col("o_start"), F.col("o_stop")), F.col("o_stop") - F.col("start")).when(F.col("o_start").between(F.col("start"), F.col("stop")), F.col("stop") - F.col("o_start"))
    fits = (inside >= F.lit(threshold) * (F.col("o_stop") - F.col("o_start"))) & (inside >= F.lit(threshold) * (F.col("stop") - F.col("start")))

    def met(a_own: bool) -> DataFrame:
        """Pairs whose longer interval is a's (of equal class, too), or b's."""
        x = _posted(a, "top", a_own).select("protein_id", "level", "bin", "i", "start", "stop", F.col("class").alias("a_class"))
        y = _posted(b, "top", not a_own).select("protein_id", "level", "bin", F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), F.col("class").alias("b_class"))
        longer = F.col("a_class") >= F.col("b_class") if a_own else F.col("a_class") < F.col("b_class")
        return x.join(y, ["protein_id", "level", "bin"]).where(longer & fits).select("protein_id", "i")

    hit = met(True).union(met(False)).distinct().withColumn("hit", F.lit(1))
    return a.select("protein_id", "i", "feature", "start", "stop").join(hit, ["protein_id", "i"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def overlap_statistics(instances: DataFrame, tool: str, other: str, threshold: float) -> DataFrame:
    """One row: the twelve counts of both directions."""
    out = None
    for k, (x, y) in enumerate(((tool, other), (other, tool)), 1):
        by = overlapping(instances, x, y, threshold).groupBy("feature").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
        one = by.agg(
            F.coalesce(F.sum((F.col("hits") > 0).cast("long")), F.lit(0)).alias(f"types_overlapping_{k}"),
            F.count(F.lit(1)).alias(f"types_{k}"),
            F.coalesce(F.sum("hits"), F.lit(0)).alias(f"instances_overlapping_{k}"),
            F.coalesce(F.sum("n"), F.lit(0)).alias(f"instances_{k}"),
            F.coalesce(F.sum(F.when(F.col("hits") > 0, F.col("hits"))), F.lit(0)).alias(f"overlapping_of_types_{k}"),
            F.coalesce(F.sum(F.when(F.col("hits") > 0, F.col("n"))), F.lit(0)).alias(f"instances_of_types_{k}"),
        )
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def overlap_shares(statistics: DataFrame) -> DataFrame:
    """The shares that a report shows, one row per direction and kind."""
    parts = [(k, kind, a, b) for k in (1, 2) for kind, a, b in (("types", "types_overlapping", "types"), ("instances", "instances_overlapping", "instances"), ("within_types", "overlapping_of_types", "instances_of_types"))]
    rows = F.array(*[F.struct(F.lit(k).alias("direction"), F.lit(kind).alias("kind"), F.col(f"{a}_{k}").cast("long").alias("overlapping"), (F.col(f"{b}_{k}") - F.col(f"{a}_{k}")).cast("long").alias("free")) for k, kind, a, b in parts])
    return statistics.select(F.explode(rows).alias("r")).select("r.*")
