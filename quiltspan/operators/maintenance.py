"""Merging, updating and checking annotations and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def unordered(a: str = "seed", b: str = "query"):
    """The two ids of a pair in one order."""
    return F.least(a, b), F.greatest(a, b)


def without_old(pairs: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs that were scored neither way round."""
    lo, hi = unordered()
    done = old.select(lo.alias("lo"), hi.alias("hi")).distinct()
    return pairs.withColumns({"lo": lo, "hi": hi}).join(done, ["lo", "hi"], "left_anti").drop("lo", "hi")


def merge_scores(scores: DataFrame) -> DataFrame:
    """Score tables united (file_pos tells the files' order): the first file that has a pair wins, either way round."""
    lo, hi = unordered()
    first = Window.partitionBy("lo", "hi").orderBy("file_pos", "seed", "query")
    return scores.withColumns({"lo": lo, "hi": hi}).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("lo", "hi", "_n")


def update_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """New scores replace old ones of the same pair, either way round."""
    return without_old(old, new).unionByName(new)


def merge_annotations(instances: DataFrame) -> DataFrame:
    """Instances by protein of several proteomes; a protein in more than one of them is an error where it is read."""
    twice = instances.select("protein_id", "proteome").distinct().groupBy("protein_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    message = F.concat(F.lit("protein in more than one proteome: "), F.col("protein_id").cast("string"))
    return instances.join(twice.withColumn("_twice", F.lit(True)), "protein_id", "left").where(F.when(F.col("_twice"), F.raise_error(message)).otherwise(F.lit(True)).cast("boolean")).drop("_n", "_twice")


def merged_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(F.sum("n").alias("n"))


def last_wins(tables: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows that share ``keys`` those of the last table (rows with the largest ``order``)."""
    last = F.max(order).over(Window.partitionBy(*keys))
    return tables.withColumn("_last", last).where(F.col(order) == F.col("_last")).drop("_last")


def replace_tool(old: DataFrame, new: DataFrame, tool: str) -> DataFrame:
    return old.where(F.col("tool") != tool).unionByName(new.where(F.col("tool") == tool))


def missing_ids(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Wanted protein_ids without annotation."""
    return wanted.join(have.select("protein_id").distinct(), "protein_id", "left_anti")


def missing_by_taxon(pairs: DataFrame, have: DataFrame) -> DataFrame:
    """Of four-column pairs (id1, tax1, id2, tax2) the ids without annotation, by taxon."""
    ids = pairs.select(F.col("tax1").alias("taxon"), F.col("id1").alias("protein_id")).union(pairs.select("tax2", "id2")).distinct()
    return missing_ids(ids, have).groupBy("taxon").agg(F.count(F.lit(1)).alias("n_missing"), F.array_sort(F.collect_list("protein_id")).alias("missing"))


def sub_proteome(instances: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances of the ids, their feature counts)."""
    kept = instances.join(ids.select("protein_id").distinct(), "protein_id", "left_semi")
    return kept, kept.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def refreshed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old instances and those of proteins that they miss, with counts made anew."""
    both = old.unionByName(new.join(old.select("protein_id").distinct(), "protein_id", "left_anti"))
    return both, both.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def version_mismatches(versions: DataFrame) -> DataFrame:
    """Tools whose versions differ between proteomes (proteome, tool, value)."""
    return versions.groupBy("tool").agg(F.count_distinct("value").alias("n_versions")).where("n_versions > 1")


def proteins_with(instances: DataFrame, patterns: list[str], every: bool) -> DataFrame:
    """Proteins one of whose tools has features that end in any (or: all) of the patterns, case ignored."""
    names = instances.groupBy("protein_id", "tool").agg(F.concat(F.array_join(F.array_sort(F.collect_set("feature")), ";"), F.lit(";")).alias("names"))
    hits = [F.col("names").rlike(f"(?i){p};") for p in patterns]
    test = hits[0]
    for h in hits[1:]:
        test = test & h if every else test | h
    return names.where(test).select("protein_id").distinct()


def identical_pairs(pairs: DataFrame, instances: DataFrame) -> DataFrame:
    """Pairs of different proteins whose annotations are equal, e-values included, as scoring compares them. They are
    met by a fingerprint of 64 bits, which goes through the joins, and then by what it stands for."""
    content = F.array_sort(F.collect_list(F.struct("tool", "feature", "start", "stop", "evalue")))
    whole = instances.groupBy("protein_id").agg(content.alias("content"))
    whole = cut(whole.select("protein_id", F.xxhash64("content").alias("h"), "content"), "annotations")
    s, q = whole.select(F.col("protein_id").alias("seed"), "h"), whole.select(F.col("protein_id").alias("query"), F.col("h").alias("q_h"))
    met = pairs.where("seed <> query").select("seed", "query").join(s, "seed").join(q, "query").where("h = q_h").select("seed", "query")
    s, q = whole.select(F.col("protein_id").alias("seed"), "content"), whole.select(F.col("protein_id").alias("query"), F.col("content").alias("q_content"))
    # not as an equation, which Spark would make a key of the join and sort the rows by
    equal = F.array_contains(F.array("content"), F.col("q_content"))
    return met.join(s, "seed").join(q, "query").where(equal).select("seed", "query")


def ortholog_groups(members: DataFrame, one_seed_taxon: bool = False, names: DataFrame | None = None) -> DataFrame:
    """(grp, taxon, protein_id, pos): each group's first row is its seed; the others are its members. With
    ``one_seed_taxon``, seeds of more than one taxon are an error. ``names`` (grp) restricts the groups."""
    if names is not None:
        members = members.join(names.select("grp").distinct(), "grp", "left_semi")
    first = Window.partitionBy("grp")
    rows = members.withColumn("seed", F.min_by("protein_id", "pos").over(first)).withColumn("seed_taxon", F.min_by("taxon", "pos").over(first)).withColumn("first_pos", F.min("pos").over(first))
    if one_seed_taxon:
        taxa = rows.agg(F.count_distinct("seed_taxon").alias("_taxa"))  # one row
        bad = F.when(F.col("_taxa") > 1, F.raise_error(F.lit("the groups' seeds are of more than one taxon"))).otherwise(F.lit(True))
        rows = rows.crossJoin(taxa).where(bad.cast("boolean"))
    return rows.where("pos > first_pos").select("grp", "seed", "seed_taxon", F.col("protein_id").alias("query"), F.col("taxon").alias("query_taxon"))


def taxon_pairs(pairs: DataFrame) -> DataFrame:
    """How many pairs each two taxa have; partition by (tax1, tax2) to keep them apart."""
    return pairs.groupBy("tax1", "tax2").agg(F.count(F.lit(1)).alias("n_pairs"))


def sample_pairs(pairs: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """A random sample of n pairs, the same for the same seed."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("seed").cast("string"), F.col("query").cast("string")))
    return pairs.orderBy(draw, "seed", "query").limit(n)


def union_results(results: Sequence[DataFrame]) -> DataFrame:
    """Result tables of several runs as one, in order of the runs: ``run`` is a table's number."""
    out = None
    for k, r in enumerate(results):
        r = r.withColumn("run", F.lit(k))
        out = r if out is None else out.unionByName(r)
    return out


def extract_for_sequences(instances: DataFrame, sequences: DataFrame) -> DataFrame:
    """The annotation of the sequences (id) of a FASTA table; one without annotation is an error."""
    ids = check_ids(sequences.select(F.col("id").alias("protein_id")), instances)
    return instances.join(ids.distinct(), "protein_id", "left_semi")


def check_ids(ids: DataFrame, have: DataFrame) -> DataFrame:
    """``ids``, or an error where one of them is unknown."""
    known = ids.join(have.select("protein_id", F.lit(True).alias("_ok")).distinct(), "protein_id", "left")
    return known.where(F.when(F.col("_ok").isNull(), F.raise_error(F.concat(F.lit("unknown protein: "), F.col("protein_id").cast("string")))).otherwise(F.lit(True)).cast("boolean")).drop("_ok")
