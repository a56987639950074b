"""From instances to architectures: filters, positions, numbering and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import passes, position, rounded
from ..options import ScoringOptions

#: Columns of an instance table (``i``: an instance's number within its protein, from 0).
INSTANCE = ["protein_id", "length", "tool", "linearized", "feature", "clan", "i", "start", "stop", "evalue"]


def number_instances(instances: DataFrame) -> DataFrame:
    """``i`` from tool_pos, feat_pos and inst_pos, the order of the annotation file."""
    order = Window.partitionBy("protein_id").orderBy("tool_pos", "feat_pos", "inst_pos")
    return instances.withColumn("i", F.row_number().over(order) - 1)


def pruned(instances: DataFrame, feature_limit: float, instance_limit: float) -> DataFrame:
    """What stays of predicted instances when an annotation is made: those within their limit, of features within
    theirs (feature_evalue is optional). A feature that keeps no instance goes with them."""
    kept = instances.where(passes("evalue", instance_limit))
    return kept.where(passes("feature_evalue", feature_limit)) if "feature_evalue" in instances.columns else kept


def no_linearization(instances: DataFrame) -> DataFrame:
    """Every tool as one whose features may overlap."""
    return instances.withColumn("linearized", F.lit(False))


def architecture(instances: DataFrame, options: ScoringOptions) -> DataFrame:
    """Instances that pass the e-value cuts, with their position. feature_evalue is optional."""
    kept = instances.where(passes("evalue", options.instance_evalue))
    if "feature_evalue" in instances.columns:
        kept = kept.where(passes("feature_evalue", options.feature_evalue))
    if not options.linearize:
        kept = no_linearization(kept)
    return kept.withColumn("position", rounded(position(), options))


def ranked(arch: DataFrame) -> DataFrame:
    """The linearized instances in order of their end, ties in order of ``i``: rank from 0."""
    order = Window.partitionBy("protein_id").orderBy("stop", "i")
    return arch.where("linearized").withColumn("rank", F.row_number().over(order) - 1)


def clan_counts(arch: DataFrame) -> DataFrame:
    """Instances by protein and clan; those without a clan are one group."""
    return arch.groupBy("protein_id", "clan").agg(F.count(F.lit(1)).alias("n"))


def feature_counts(instances: DataFrame) -> DataFrame:
    return instances.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def proteins(universe: DataFrame, instances: DataFrame, options: ScoringOptions) -> DataFrame:
    """One row per protein: ``lin`` (linearized instances by rank), ``normal`` (the others by i), ``mark`` (128 bits of
    all instances before the cuts, by which annotations are compared).

    A protein's instances are few; that a protein is one row makes every later step local to it.
    """
    kept = passes("evalue", options.instance_evalue)
    if "feature_evalue" in instances.columns:
        kept = kept & passes("feature_evalue", options.feature_evalue)
    rows = instances if options.linearize else no_linearization(instances)
    rows = rows.withColumns({"_kept": kept, "position": rounded(position(), options)})
    # one list of a protein's instances, of which the three are made within its row
    every = F.sort_array(F.collect_list(F.struct("i", "tool", "feature", "clan", "linearized", "position", "start", "stop", "evalue", "_kept")))
    fields = lambda x: F.struct(*[x[c].alias(c) for c in ("i", "feature", "clan", "linearized", "position", "start", "stop")])
    of = lambda linearized: F.filter("every", lambda x: x["_kept"] & (x["linearized"] if linearized else ~x["linearized"]))
    lin = F.sort_array(F.transform(of(True), lambda x: F.struct(x["stop"].alias("by"), x["i"].alias("i"), fields(x).alias("e"))))
    whole = F.sort_array(F.transform("every", lambda x: F.struct(*[x[c].alias(c) for c in ("tool", "feature", "start", "stop", "evalue")])))
    grouped = rows.groupBy("protein_id").agg(every.alias("every"))
    grouped = grouped.select("protein_id", F.transform(lin, lambda x: x["e"]).alias("lin"), F.transform(of(False), fields).alias("normal"), whole.alias("whole"))
    empty = F.array().cast(grouped.schema["lin"].dataType)
    none = F.array().cast(grouped.schema["whole"].dataType)
    out = universe.join(grouped, "protein_id", "left").withColumn("whole", F.coalesce("whole", none))
    mark = F.array(F.xxhash64("whole"), F.xxhash64(F.lit(1), "whole"))
    return out.select("protein_id", F.coalesce("lin", empty).alias("lin"), F.coalesce("normal", empty).alias("normal"), mark.alias("mark"))
