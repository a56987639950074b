"""Annotation JSON documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut
from . import document_parts

_TOP = "feature map<string,map<string,string>>, clan map<string,string>, interproID map<string,string>, length map<string,string>, count map<string,string>, version map<string,map<string,string>>"
_TOOL = "map<string,struct<evalue:string,instance:array<array<string>>>>"


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per document: proteome (the file's name without suffix and shard) and its parsed top level. Key order is
    kept, since it numbers the instances. A document is read whole, 2 GB at most: ``documents.write`` splits larger
    ones into shards, ``read_in_parts`` takes any."""
    text = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(-[0-9]{5})?(\.json)?$", 1).alias("proteome"))
    return text.select("proteome", F.from_json("value", _TOP).alias("doc")).select("proteome", "doc.*")


def _entries(documents: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """proteome and the entries of a map. The outer form is that for which Spark adds no filters on the map, each of which
    parses the text once more."""
    return documents.select("proteome", F.explode_outer(column).alias(key, value)).where(F.col(key).isNotNull())


def instances(documents: DataFrame) -> DataFrame:
    """proteome, protein_id, length, tool, tool_pos, feature, feat_pos, feature_evalue, inst_pos, start, stop, evalue,
    bit_score, hmm_from, hmm_to. Values that are no numbers become null, which passes every cut."""
    p = _entries(documents, "feature", "protein_id", "tools")
    p = p.select("proteome", "protein_id", F.expr("try_cast(tools['length'] as int)").alias("length"), F.posexplode("tools").alias("tool_pos", "tool", "body")).where("tool <> 'length'")
    f = p.withColumn("m", F.from_json("body", _TOOL)).select("proteome", "protein_id", "length", "tool", "tool_pos", F.posexplode_outer("m").alias("feat_pos", "feature", "f")).where("feature is not null")
    i = f.select("*", F.expr("try_cast(f.evalue as double)").alias("feature_evalue"), F.posexplode("f.instance").alias("inst_pos", "x"))
    at = lambda k, t: F.expr(f"try_cast(get(x, {k}) as {t})")
    return i.select("proteome", "protein_id", "length", "tool", "tool_pos", "feature", "feat_pos", "feature_evalue", "inst_pos", at(0, "int").alias("start"), at(1, "int").alias("stop"), at(2, "double").alias("evalue"), at(3, "double").alias("bit_score"), at(4, "int").alias("hmm_from"), at(5, "int").alias("hmm_to"))


def proteins(documents: DataFrame) -> DataFrame:
    """proteome, protein_id, length of every protein, those without features included."""
    p = _entries(documents, "feature", "protein_id", "tools")
    return p.select("proteome", "protein_id", F.expr("try_cast(tools['length'] as int)").alias("length"))


def dimension(documents: DataFrame, column: str, value: str) -> DataFrame:
    """(feature, value) of one of the maps clan, interproID, length."""
    return dimension_rows(documents, column, value).distinct()


def dimension_rows(documents: DataFrame, column: str, value: str) -> DataFrame:
    """(feature, value) of a map, a row for each document that has the entry."""
    return _entries(documents, column, "feature", value).drop("proteome")


def versions(documents: DataFrame) -> DataFrame:
    """proteome, tool, info (map)."""
    return _entries(documents, "version", "tool", "info")


def read_in_parts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The columns of ``read_documents`` with a row for each protein, tool version and other map, from documents of any
    size: a document is cut at its closing braces, so that several tasks read it, and no row holds more than a protein
    or one of the other maps.

    Whether a brace stands in a string, and how deep it is, follows from quotes and braces before it: a first reading
    counts them by split, the splits' counts are summed up (a row for each split goes through the ordered window), and a
    second one cuts each split into its entries. These are written; no text is sent but that of entries that lie in
    several splits. Key order within a protein is kept. What is no JSON object gives no rows.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = pieces.mapInArrow(document_parts.counts, document_parts.COUNTS)
    splits = splits.withColumn("inside", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    chosen = lambda c: F.when(F.col("inside") == 0, F.col(f"{c}_0")).otherwise(F.col(f"{c}_1"))
    splits = splits.withColumn("depth", F.coalesce(F.sum(chosen("change")).over(before), F.lit(0)).cast("int"))
    # the section that a split begins in is the last one that an earlier split opens
    splits = splits.withColumn("key", F.last(F.try_element_at(chosen("open"), 2 - F.col("depth")), ignorenulls=True).over(before))
    name = F.regexp_extract(F.element_at(F.split("_file", "/"), -1), r"^(.*?)(-[0-9]{5})?(\.json)?$", 1)
    splits = cut(splits.select("_file", "_start", name.alias("proteome"), "inside", "depth", "key"), "document-splits")
    rows = pieces.join(F.broadcast(splits), ["_file", "_start"])
    rows = cut(rows.mapInArrow(document_parts.entries, document_parts.ENTRIES), "document-entries")
    # parts of one entry: from one that begins to one that ends
    to_here = Window.partitionBy("_file").orderBy("_start", "part").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.where("part is not null").withColumn("entry", F.sum("part").over(to_here))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "part", "text"))), lambda x: x["text"]), "")
    joined = parts.groupBy("_file", "entry").agg(F.first("proteome").alias("proteome"), F.max_by("section", "part").alias("section"), text.alias("text"), F.max("ends").alias("ends"), F.max("part").alias("begins"))
    joined = joined.where("ends and begins = 1").select("proteome", "section", F.regexp_replace("text", r"^[\s,]+|[\s,]+$", "").alias("text")).where("text <> ''")
    every = rows.where("part is null").select("proteome", "section", "text").union(joined)
    whole = F.concat(F.lit('{"'), F.col("section"), F.lit('":{'), F.col("text"), F.lit("}}"))
    return every.select("proteome", F.from_json(whole, _TOP).alias("doc")).select("proteome", "doc.*")
