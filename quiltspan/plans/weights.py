"""Feature weights: uniform, by inverse frequency in a reference proteome, and under constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import corrected_count, rounded, tool_of
from ..options import ScoringOptions


def _counts(instances: DataFrame, reference: DataFrame, method: str) -> DataFrame:
    """(protein_id, feature, n): every feature of a protein, before any e-value cut; unseen ones count 1."""
    have = instances.select("protein_id", "feature").distinct()
    counts = reference.select("feature", corrected_count(F.col("n"), method).alias("n"))
    return have.join(counts, "feature", "left").withColumn("n", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)))


def frequency_weights(instances: DataFrame, reference: DataFrame, options: ScoringOptions) -> DataFrame:
    """(protein_id, feature, weight): the sum of a protein's counts over the feature's own, scaled to sum to 1."""
    own = Window.partitionBy("protein_id")
    rows = _counts(instances, reference, options.count_correction)
    rows = rows.withColumn("raw", rounded(F.sum("n").over(own).cast("double") / F.col("n"), options))
    return rows.select("protein_id", "feature", rounded(F.col("raw") / F.sum("raw").over(own), options).alias("weight"))


def uniform_weights(instances: DataFrame) -> DataFrame:
    rows = instances.select("protein_id", "feature").distinct()
    return rows.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("protein_id")))


def constrained_weights(instances: DataFrame, reference: DataFrame, options: ScoringOptions) -> DataFrame:
    """Weights that keep ``options.constraints``: of a feature by its name, of a tool by the tool's, shared in inverse
    proportion to counts; the others share what the constraints in force for the protein leave."""
    limits = F.create_map(*[F.lit(x) for kv in options.constraints.items() for x in kv]) if options.constraints else F.create_map().cast("map<string,double>")
    rows = _counts(instances, reference, options.count_correction).withColumn("own", limits[F.col("feature")])
    rows = rows.withColumn("tool_limit", F.when(F.col("own").isNull(), limits[tool_of(F.col("feature"))]))
    group = F.when(F.col("own").isNotNull(), F.concat(F.lit("f:"), "feature")).when(F.col("tool_limit").isNotNull(), F.concat(F.lit("t:"), tool_of(F.col("feature")))).otherwise(F.lit("rest"))
    rows = rows.withColumn("grp", group)
    in_group, in_protein = Window.partitionBy("protein_id", "grp"), Window.partitionBy("protein_id")
    rows = rows.withColumn("raw", rounded(F.sum("n").over(in_group).cast("double") / F.col("n"), options))
    rows = rows.withColumn("share", F.col("raw") / F.sum("raw").over(in_group))
    rows = rows.withColumn("tool_part", F.col("tool_limit") / F.count(F.lit(1)).over(in_group))
    filled = F.sum(F.coalesce("own", "tool_part", F.lit(0.0))).over(in_protein)
    weight = F.coalesce("own", F.col("share") * F.col("tool_limit"), F.col("share") * (F.lit(1.0) - filled))
    return rows.select("protein_id", "feature", rounded(weight, options).alias("weight"))


def rescaled_weights(weights: DataFrame, kept: DataFrame, options: ScoringOptions) -> DataFrame:
    """After linearization: a constrained tool whose surviving features (``kept``: protein_id, feature) sum to less
    than its constraint is scaled back up to it. Features with a constraint of their own stay."""
    limits = F.create_map(*[F.lit(x) for kv in options.constraints.items() for x in kv])
    rows = weights.join(kept.select("protein_id", "feature").distinct(), ["protein_id", "feature"]).withColumn("tool", tool_of(F.col("feature")))
    limit = F.when(limits[F.col("feature")].isNull(), limits[F.col("tool")])
    rows = rows.withColumn("lim", limit)
    total = F.sum(F.when(F.col("lim").isNotNull(), F.col("weight"))).over(Window.partitionBy("protein_id", "tool"))
    factor = F.when((total > 0) & (total < F.col("lim")), F.col("lim") / total).otherwise(F.lit(1.0))
    return rows.select("protein_id", "feature", (F.col("weight") * factor).alias("weight"))
