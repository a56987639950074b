"""Positions of rows in the order of their files.

Spark packs splits of files into tasks by size, so that a number counted up task by task does not follow the files.
A row's place is that of its split (file and first byte) and its place within the split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PLACE = ["_file", "_start", "_row"]


def placed(rows: DataFrame) -> DataFrame:
    """``rows``, just read from files, with what tells their order: _file, _start (of the split) and _row. Rows keep
    these through filters and projections; ``with_positions`` makes numbers of them."""
    at = F.col("_metadata")
    return rows.select("*", at["file_path"].alias("_file"), at["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_row"))


def with_positions(rows: DataFrame, name: str = "pos") -> DataFrame:
    """``name``: 0, 1, ... in order of file name, split and row. The rows of each split are counted, the counts summed
    up over the splits (a row for each goes through the ordered window), and rows numbered within their split."""
    splits = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_rows"))
    order = Window.orderBy("_file", "_start")
    before = splits.select("_file", "_start", (F.sum("_rows").over(order) - F.col("_rows")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_row")) - 1
    numbered = rows.withColumn("_within", within).join(before, ["_file", "_start"])
    return numbered.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop(*_PLACE, "_within", "_before")
