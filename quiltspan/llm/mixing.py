"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table


def water_fill(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """``sizes``: source, source_size (one row per source). Adds weight and target.

    Sources by code point, null last, weigh ``weights`` in turn. They share ``share`` of all sizes by weight; a
    source stops at ``max_epochs`` times its size and the excess goes to the others by weight until none is above.
    The level at which that ends is found at once: in order of cap / weight, the capped sources are those whose
    cap / weight is below what the rest would get. One row per source goes through the ordered windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * F.lit(int(max_epochs)))
    by_ratio = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after, all_ = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_left": F.sum("weight").over(after), "total": F.sum("source_size").over(all_) * F.lit(float(share))})
    rows = rows.withColumn("capped", F.col("cap").cast("double") * F.col("w_left") <= (F.col("total") - F.col("cap_before")) * F.col("weight"))
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_), F.lit(0)).cast("double")) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(all_).cast("double")
    rows = rows.withColumn("level", level)
    others = [c for c in sizes.columns if c not in ("source", "source_size")]
    return rows.select(*others, "source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    share: float = 1.0,
    whole_rows: bool = False,
    rows_per_range: int = 50_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken for each row of ``docs``, and the row itself as the
    struct ``row`` if ``whole_rows``.

    size is the number of words of the text. A source's target over its size is the number of epochs: each of its
    documents is taken the whole number of times, and once more if it comes, in the order of MD5(seed, doc_id) and
    size, before the fraction of the source's words is filled: while the words before it and half its own are fewer.
    Those documents are the first ones in that order, so that a source needs no more than the place where they end.
    The order is cut in ranges of the digest, of about ``rows_per_range`` rows of a source that holds all of them;
    sums by source and range tell in which one the place lies, only that range's rows meet in a window, and every
    document is then judged where it stands, against one row for its source: texts are never shuffled.

    taken = size * repeats, at most ``max_epochs`` times size, and a source's taken words miss its target by half a
    document at most. Null text: size 0, taken 0. Null source: a source of its own, the last. A null doc_id is drawn by
    its text. Repeated rows are rows of their own; where rows of one doc_id and size lie at the place, so many of them
    are taken as fit, in order of the contents of ``row`` (equal rows are interchangeable, so that reruns agree). All
    sizes zero: all targets zero. Empty table: empty result. Other columns may have any names.
    """
    text_draw = F.concat(F.lit("null:"), F.coalesce(F.md5("text"), F.lit("")))
    base = docs.select(
        *([F.struct(*docs.columns).alias("row")] if whole_rows else []),
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), text_draw))).alias("draw"),
    )
    ranges, digits = docs.count() / rows_per_range, 1
    while 16**digits < ranges:
        digits += 1
    slim = cut(base.select("source", "key", "size", "draw", F.substring("draw", 1, digits).alias("part")), "mix-sizes")
    parts = slim.groupBy("source", "key", "part").agg(F.sum("size").alias("part_size"))
    by_part = Window.partitionBy("key").orderBy("part")
    parts = cut(parts.withColumn("end", F.sum("part_size").over(by_part.rowsBetween(Window.unboundedPreceding, 0))), "mix-parts")
    targets = water_fill(parts.groupBy("source", "key").agg(F.sum("part_size").alias("source_size")), weights, max_epochs, share)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(epochs)).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = cut(targets.select("key", "source_size", "target", "whole", "quota"), "mix-targets")

    # the first range that fills the quota, and in it the first row that is not taken once more
    fills = parts.join(targets, "key").where("end >= quota")
    first = fills.groupBy("key").agg(F.min(F.struct("part", (F.col("end") - F.col("part_size")).alias("start"), "quota")).alias("f")).select("key", "f.*")
    # rows of one draw and size are one row with their number, so that repeated rows do not meet in the window
    order = Window.partitionBy("key").orderBy("draw", "size")
    rows = slim.join(first, ["key", "part"]).groupBy("key", "start", "quota", "draw", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("done", F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def fits(j: Column) -> Column:
        return (F.col("done") + j * F.col("size")).cast("double") + F.col("size") / F.lit(2.0) < F.col("quota")

    # how many of them are taken once more: about (quota - done) / size, put right by the condition itself
    about = F.ceil((F.col("quota") - F.col("done")) / F.nullif("size", F.lit(0)) - F.lit(0.5)).cast("long")
    near = F.when(fits(about), about + 1).when(fits(about - 1), about).otherwise(about - 1)
    number = F.when(F.col("size") == 0, F.when(fits(F.lit(0)), F.col("n")).otherwise(F.lit(0))).otherwise(F.greatest(F.lit(0), F.least(near, F.col("n"))))
    rows = rows.withColumn("equal", number.cast("long")).where("equal < n")
    place = F.struct("draw", "size")
    stops = rows.groupBy("key").agg(F.min(place).alias("stop"), F.min_by("equal", place).alias("equal"))
    # one row per source; a range without such a row is taken whole, and what follows it is not
    stops = first.select("key", F.col("part").alias("last_part")).join(stops, "key", "left")
    plan = cut(targets.join(stops, "key", "left"), "mix-plan")

    joined = base.join(plan, "key")
    before = F.when(F.col("stop").isNull(), F.substring("draw", 1, digits) <= F.col("last_part")).otherwise(place < F.col("stop"))
    before = F.coalesce(before, F.lit(False))

    def taken(rows: DataFrame, once_more: Column) -> DataFrame:
        out = rows.withColumn("repeats", (F.col("whole") + once_more.cast("int")).cast("int"))
        out = out.withColumn("taken", F.col("size") * F.col("repeats"))
        return out.select(*(["row"] if whole_rows else []), "doc_id", "source", "size", "source_size", "target", "repeats", "taken")

    if not plan.agg(F.max("equal")).first()[0]:
        return taken(joined, before)
    # rows that repeat at the place: so many of them as fit, by their contents, numbered in the tasks that read them
    at = F.coalesce((place == F.col("stop")) & (F.col("equal") > 0), F.lit(False))
    content = F.md5(F.to_json("row")) if whole_rows else F.lit("")
    tied = cut(joined.where(at).withColumns({"content": content, "task": F.spark_partition_id()}), "mix-tied")
    group = ["key", "content", "task"]
    counts = tied.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("key").orderBy("content", "task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    numbered = tied.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy(F.lit(0)))).join(counts, group)
    return taken(joined.where(~at), before).union(taken(numbered, F.col("earlier") + F.col("number") <= F.col("equal")))


def op10_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH base AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(md5(text), ''))) AS draw FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (SELECT source, source_size, source_size * 3 AS cap, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight FROM sizes),
sums AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
         CAST((SELECT sum(source_size) FROM sizes) AS DOUBLE) AS total FROM weighed),
marked AS (SELECT *, CAST(cap AS DOUBLE) * w_left <= (total - cap_before) * weight AS capped FROM sums),
levels AS (SELECT *, (total - CAST(coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS DOUBLE)) / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) AS level FROM marked),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM levels),
plan AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM targets),
ordered AS (SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS quota,
         coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
       FROM base JOIN plan ON base.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN CAST(done AS DOUBLE) + size / 2.0 < quota THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""
