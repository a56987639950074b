"""Outputs of sequence predictors as instances: id, feature, start, stop, evalue."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(masked: DataFrame, char: str, feature: str) -> DataFrame:
    """1-based closed intervals of the runs of ``char`` in ``masked`` (id, sequence), by code points: the borders of a
    sequence's runs are found on Arrow batches, linear in the sequence."""
    code = ord(char)

    @F.arrow_udf("array<struct<start:int,stop:int>>")
    def spans(sequence: pa.Array) -> pa.Array:
        starts, stops, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [0]
        for s in sequence:
            here = np.frombuffer((s.as_py() or "").encode("utf-32-le", "surrogatepass"), "<u4") == code
            border = np.flatnonzero(np.diff(here, prepend=False, append=False)).astype(np.int32)
            starts.append(border[::2] + 1)
            stops.append(border[1::2])
            sizes.append(len(border) // 2)
        both = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int32()) for x in (starts, stops)], names=["start", "stop"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), both)

    rows = masked.select("id", F.explode(spans("sequence")).alias("x"))
    return rows.select("id", F.lit(feature).alias("feature"), "x.start", "x.stop", F.lit(None).cast("double").alias("evalue"))


def islands(residues: DataFrame) -> DataFrame:
    """(id, start, stop) half-open and 0-based, from residues (id, pos from 0, mark ``*`` or ``.``).

    A run that reaches the last residue is left out, as the format's readers have it; another mark is an error.
    """
    bad = F.when(F.col("mark").isin("*", "."), F.lit(True)).otherwise(F.raise_error(F.lit("a residue's mark is neither * nor .")).cast("boolean"))
    own = Window.partitionBy("id")
    marked = residues.where(bad).withColumn("last", F.max("pos").over(own)).where("mark = '*'")
    island = F.col("pos") - F.row_number().over(own.orderBy("pos"))
    spans = marked.withColumn("g", island).groupBy("id", "g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.max("last").alias("last"))
    return spans.where("stop <= last").select("id", "start", "stop")


def transmembrane(lines: DataFrame) -> DataFrame:
    """Segments `` M start end`` of ``%pred`` lines (id, value)."""
    parts = lines.where("value like '%\\%pred%'").select("id", F.explode(F.filter(F.split("value", ","), lambda x: x.startswith(" M"))).alias("x"))
    p = F.split(F.trim("x"), r"\s+")
    at = lambda k: F.get(p, F.lit(k)).try_cast("int")
    return parts.select("id", F.lit("tmhmm_transmembrane").alias("feature"), at(1).alias("start"), at(2).alias("stop"), F.lit(None).cast("double").alias("evalue"))


def signal_peptides(lines: DataFrame) -> DataFrame:
    """Tables with the decision in the tenth column and the cleavage site in the fifth."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where("value not like '#%' and value not like '%Temporary files in%' and trim(value) <> ''").withColumn("p", p).where(F.get("p", F.lit(9)) == "Y")
    return rows.select(F.col("p")[0].alias("id"), F.lit("signalp_SIGNALP").alias("feature"), F.lit(1).alias("start"), (F.get("p", F.lit(4)).try_cast("int") - 1).alias("stop"), F.lit(None).cast("double").alias("evalue"))


def low_complexity(lines: DataFrame) -> DataFrame:
    """Lines ``name from-to`` of records (id, value)."""
    rows = lines.select("id", F.regexp_extract("value", r"^\s*\S+\s+(\d+)-(\d+)\s*$", 1).alias("a"), F.regexp_extract("value", r"^\s*\S+\s+(\d+)-(\d+)\s*$", 2).alias("b")).where("a <> ''")
    return rows.select("id", F.lit("seg_low_complexity_regions").alias("feature"), F.expr("try_cast(a as int)").alias("start"), F.expr("try_cast(b as int)").alias("stop"), F.lit(None).cast("double").alias("evalue"))


def biased_regions(lines: DataFrame, threshold: float) -> DataFrame:
    """Tab-separated rows id, [name,] type, rank, start, stop, count, p-value, residues; the feature is named by type
    and residues and holds the threshold as its e-value."""
    p = F.split(F.trim("value"), "\t")
    rows = lines.withColumn("p", p).where(F.size("p") >= 8).withColumn("o", F.when(F.size("p") > 8, F.lit(1)).otherwise(F.lit(0)))
    get = lambda k: F.get("p", F.col("o") + k)
    return rows.select(F.col("p")[0].alias("id"), F.concat_ws("_", F.lit("flps"), get(1), get(7)).alias("feature"), get(3).try_cast("int").alias("start"), get(4).try_cast("int").alias("stop"), get(6).try_cast("double").alias("evalue"), F.lit(float(threshold)).alias("feature_evalue"))


_QUERY = re.compile(r"^Query:\s+(\S+)\s+\[L=(\d+)\]", re.M)


def profile_hits(reports: DataFrame, tool: str, feature_limit: float, instance_limit: float) -> DataFrame:
    """Domain hits from reports of a profile search (``value``: the text between ``//`` lines).

    Features have the full-sequence e-value (at most ``feature_limit``), instances the conditional one (at most
    ``instance_limit``), the bit score, and their place in sequence and profile. The text is parsed record by record
    on Arrow batches.
    """

    def parse(text: str) -> Iterator[tuple]:
        q = _QUERY.search(text)
        if not q:
            return
        head, _, domains = text.partition("Domain annotation for each model")
        features = {}
        for line in head.splitlines():
            cells = line.split()
            if len(cells) > 8 and cells[0][0].isdigit() and float(cells[0]) <= feature_limit:
                features[cells[8]] = float(cells[0])
        current = None
        for line in domains.splitlines():
            cells = line.split()
            if line.startswith(">>"):
                current = cells[1]
            elif len(cells) > 13 and cells[0].isdigit() and current in features and float(cells[4]) <= instance_limit:
                yield q[1], int(q[2]), f"{tool}_{current}", features[current], int(cells[12]), int(cells[13]), float(cells[4]), float(cells[2]), int(cells[6]), int(cells[7])

    names = ["id", "length", "feature", "feature_evalue", "start", "stop", "evalue", "bit_score", "hmm_from", "hmm_to"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(r for t in b.column("value").to_pylist() for r in parse(t or "")), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return reports.select("value").mapInArrow(run, "id string, length int, feature string, feature_evalue double, start int, stop int, evalue double, bit_score double, hmm_from int, hmm_to int")
