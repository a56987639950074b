"""Annotation documents as tables: built from predictors' outputs, merged, updated, checked, and written as JSON."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import annotation, predictors
from ..storage import cut, drop_shuffles, rename_files
from . import maintenance as M

INSTANCE = ["protein_id", "tool", "feature", "feature_evalue", "i", "start", "stop", "evalue", "bit_score", "hmm_from", "hmm_to"]
#: Columns that only some predictors give.
OPTIONAL = {"feature_evalue": "double", "evalue": "double", "bit_score": "double", "hmm_from": "int", "hmm_to": "int"}


@dataclass(frozen=True)
class Document:
    """One document, or several read as one. instances: INSTANCE columns; proteins: protein_id, length; clans,
    accessions and lengths: feature and clan, interpro, plen; versions: tool, info (map); counts: feature, n."""

    instances: DataFrame
    proteins: DataFrame
    clans: DataFrame
    accessions: DataFrame
    lengths: DataFrame
    versions: DataFrame
    counts: DataFrame


def counted(instances: DataFrame) -> DataFrame:
    return instances.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def completed(instances: DataFrame) -> DataFrame:
    """INSTANCE columns, with nulls for those that the predictor does not give, numbered by protein in order of tool,
    feature and place where there is no number."""
    out = instances.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in instances.columns})
    if "i" not in out.columns:
        order = Window.partitionBy("protein_id").orderBy("tool", "feature", "start", "stop", "evalue")
        out = out.withColumn("i", F.row_number().over(order) - 1)
    return out.select(*INSTANCE)


def read(spark: SparkSession, paths: str | Sequence[str], in_parts: bool = False) -> Document:
    """The documents in ``paths`` as one: shards of a document are read together. ``in_parts``: several tasks read a
    document, which may have any size."""
    reader = annotation.read_in_parts if in_parts else annotation.read_documents
    docs = reader(spark, [paths] if isinstance(paths, str) else list(paths))
    rows = annotation.instances(docs)
    number = F.row_number().over(Window.partitionBy("protein_id").orderBy("tool_pos", "feat_pos", "inst_pos")) - 1
    dims = {v: annotation.dimension(docs, c, v).dropDuplicates(["feature"]) for c, v in (("clan", "clan"), ("interproID", "interpro"), ("length", "plen"))}
    lengths = dims["plen"].select("feature", F.expr("try_cast(plen as int)").alias("plen"))
    versions = annotation.versions(docs).groupBy("tool").agg(F.min_by("info", "proteome").alias("info"))
    counts = annotation.dimension_rows(docs, "count", "n").groupBy("feature").agg(F.sum(F.expr("try_cast(n as bigint)")).alias("n"))
    proteins = annotation.proteins(docs).select("protein_id", "length")
    return Document(rows.withColumn("i", number).select(*INSTANCE), proteins, dims["clan"], dims["interpro"], lengths, versions, counts)


def looked_up(instances: DataFrame, families: DataFrame, profile_lengths: DataFrame) -> dict[str, DataFrame]:
    """clans, accessions and lengths of the features that occur. ``families``: id, accession, clan (NA: none) of the
    records that domain features of the tool pfam are named by; ``profile_lengths``: feature, plen."""
    features = instances.select("feature").distinct()
    named = families.select(F.concat(F.lit("pfam_"), "id").alias("feature"), "accession", "clan")
    met = features.join(named, "feature")
    return {
        "clans": met.where("clan <> 'NA'").select("feature", "clan"),
        "accessions": met.select("feature", F.col("accession").alias("interpro")),
        "lengths": features.join(profile_lengths.select("feature", "plen"), "feature").select("feature", "plen"),
    }


def build(parts: Sequence[DataFrame], sequences: DataFrame, families: DataFrame, profile_lengths: DataFrame, versions: DataFrame) -> Document:
    """From predictors' outputs (each: id or protein_id, feature, start, stop and what else it gives) to a document.

    ``sequences``: id, length of all proteins, those without features included. A feature's tool is the text before
    its first underscore; domain features get their clan, accession and profile length.
    """
    rows = None
    for part in parts:
        x = part.withColumnRenamed("id", "protein_id").drop("length", "i")
        x = x.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in x.columns})
        x = x.select("protein_id", F.substring_index("feature", "_", 1).alias("tool"), "feature", *OPTIONAL, "start", "stop")
        rows = x if rows is None else rows.unionByName(x)
    rows = cut(completed(rows), "annotated")
    proteins = sequences.select(F.col("id").alias("protein_id"), "length")
    return Document(rows, proteins, **looked_up(rows, families, profile_lengths), versions=versions, counts=counted(rows))


def merge(documents: Sequence[Document]) -> Document:
    """Documents of different proteins: the dimension maps' last entries and the version maps' first ones win, counts
    add up, and a protein in more than one document is an error where it is read."""

    def all_of(name: str) -> DataFrame:
        out = None
        for k, d in enumerate(documents):
            x = getattr(d, name).withColumn("_doc", F.lit(k))
            out = x if out is None else out.unionByName(x)
        return out

    twice = M.merge_annotations(all_of("proteins").withColumnRenamed("_doc", "proteome")).drop("proteome")
    last = {n: M.last_wins(all_of(n), ["feature"], "_doc") for n in ("clans", "accessions", "lengths")}
    first = all_of("versions").withColumn("_doc", -F.col("_doc"))
    counts = M.merged_counts(all_of("counts").drop("_doc"))
    return Document(all_of("instances").drop("_doc"), twice, **{n: x.drop("_doc") for n, x in last.items()}, versions=M.last_wins(first, ["tool"], "_doc").drop("_doc"), counts=counts)


def update(old: Document, new: Document) -> Document:
    """New entries of every map overwrite the old ones: whole proteins, dimensions, versions and counts."""

    def over(name: str, key: str) -> DataFrame:
        both = getattr(old, name).withColumn("_doc", F.lit(0)).unionByName(getattr(new, name).withColumn("_doc", F.lit(1)))
        return M.last_wins(both, [key], "_doc").drop("_doc")

    kept = old.instances.join(new.proteins.select("protein_id"), "protein_id", "left_anti")
    maps = {n: over(n, "feature") for n in ("clans", "accessions", "lengths", "counts")}
    return Document(kept.unionByName(new.instances), over("proteins", "protein_id"), **maps, versions=over("versions", "tool"))


def redo(old: Document, new: Document, tool: str) -> Document:
    """The old document with one tool's annotation, of every protein that it has, from the new one; the dimension maps
    and that tool's version take the new entries, counts are made anew."""

    def over(name: str, key: str, more: DataFrame) -> DataFrame:
        both = getattr(old, name).withColumn("_doc", F.lit(0)).unionByName(more.withColumn("_doc", F.lit(1)))
        return M.last_wins(both, [key], "_doc").drop("_doc")

    own = new.instances.join(old.proteins.select("protein_id"), "protein_id", "left_semi")
    rows = cut(M.replace_tool(old.instances, own, tool), "redone")
    maps = {n: over(n, "feature", getattr(new, n)) for n in ("clans", "accessions", "lengths")}
    return Document(rows, old.proteins, **maps, versions=over("versions", "tool", new.versions.where(F.col("tool") == tool)), counts=counted(rows))


def add_information(doc: Document, families: DataFrame, profile_lengths: DataFrame, versions: DataFrame) -> Document:
    """What an old document lacks altogether: accessions, versions, profile lengths. What it has stays."""
    found = looked_up(doc.instances, families, profile_lengths)
    more = {n: found[n] for n in ("accessions", "lengths") if getattr(doc, n).isEmpty()}
    if doc.versions.isEmpty():
        more["versions"] = versions
    return replace(doc, **more)


def lacking(doc: Document) -> list[str]:
    """Which of accessions, versions and lengths a document lacks altogether."""
    return [n for n in ("accessions", "versions", "lengths") if getattr(doc, n).isEmpty()]


def check_versions(doc: Document, installed: DataFrame) -> DataFrame:
    """tool, key, value, installed: what differs from the installed versions (tool, key, value)."""
    stored = doc.versions.select("tool", F.explode("info").alias("key", "value"))
    now = installed.select("tool", "key", F.col("value").alias("installed"))
    return stored.join(now, ["tool", "key"]).where("value <> installed")


def fill(doc: Document, new: Document) -> Document:
    """The proteins of ``new`` that ``doc`` misses, its counts and clans made anew."""
    instances, counts = M.refreshed(doc.instances, new.instances.join(doc.proteins.select("protein_id"), "protein_id", "left_anti"))
    more = new.proteins.join(doc.proteins.select("protein_id"), "protein_id", "left_anti")
    clans = doc.clans.unionByName(new.clans).dropDuplicates(["feature"])
    return replace(doc, instances=instances, proteins=doc.proteins.unionByName(more), clans=clans, counts=counts)


def extract(doc: Document, ids: DataFrame) -> Document:
    """The proteins of ``ids`` that the document has, their counts made anew."""
    instances, counts = M.sub_proteome(doc.instances, ids)
    proteins = doc.proteins.join(ids.select("protein_id").distinct(), "protein_id", "left_semi")
    return replace(doc, instances=instances, proteins=proteins, counts=counts)


def disorder(residues: DataFrame) -> tuple[Document, DataFrame]:
    """The document of disordered regions from residues (id, pos from 0, mark), with the tool's one feature, and the
    ids of sequences whose residues have no mark at all."""
    spark = residues.sparkSession
    whole = residues.groupBy("id").agg((F.max("pos") + 1).alias("length"), F.max(F.col("mark").isNotNull()).alias("ok"))
    regions = predictors.islands(residues.where("mark is not null")).withColumn("feature", F.lit("aucpred_disordered_region"))
    empty = spark.createDataFrame([], "id string, accession string, clan string")
    lengths = spark.createDataFrame([], "feature string, plen int")
    versions = spark.createDataFrame([], "tool string, info map<string,string>")
    return build([regions], whole.where("ok").select("id", "length"), empty, lengths, versions), whole.where("not ok").select("id")


def require_tools(doc: Document, tools: Sequence[str]) -> DataFrame:
    """The tools that no protein of the document has a feature of, nor a version of: asked for, but not annotated."""
    spark = doc.instances.sparkSession
    wanted = spark.createDataFrame([(t,) for t in tools], "tool string")
    have = doc.instances.select("tool").union(doc.versions.select("tool")).distinct()
    return wanted.join(have, "tool", "left_anti")


# JSON


def _quoted(c: Column) -> Column:
    """A string as JSON has it."""
    listed = F.to_json(F.array(c.cast("string")))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit('"NA"'))


def _joined(order: Column, text: Column, before: str, after: str) -> Column:
    """The texts of a group in an order, between two brackets."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.concat(F.lit(before), F.array_join(F.transform(rows, lambda x: x["t"]), ","), F.lit(after))


def protein_lines(doc: Document, tools: Sequence[str] = ()) -> DataFrame:
    """protein_id, value: each protein's entry, ``"id":{"length":n,"tool":{"feature":{"evalue":x,"instance":[...]}}}``.
    Tools in ``tools`` are there even without a feature. Instances are dealt out by protein once, for all groupings."""
    short = F.concat_ws(",", F.col("start").cast("string"), F.col("stop").cast("string"), _number("evalue"))
    long = F.concat_ws(",", short, _number("bit_score"), _number("hmm_from"), _number("hmm_to"))
    instance = F.concat(F.lit("["), F.when(F.col("bit_score").isNull() & F.col("hmm_from").isNull(), short).otherwise(long), F.lit("]"))
    rows = doc.instances.select("protein_id", "tool", "feature", "feature_evalue", "i", instance.alias("t")).repartition("protein_id")
    by_feature = rows.groupBy("protein_id", "tool", "feature").agg(_joined(F.col("i"), F.col("t"), "[", "]").alias("t"), F.min("i").alias("i"), F.first("feature_evalue").alias("feature_evalue"))
    feature = F.concat(_quoted(F.col("feature")), F.lit(':{"evalue":'), _number("feature_evalue"), F.lit(',"instance":'), F.col("t"), F.lit("}"))
    whole = by_feature.groupBy("protein_id").agg(F.array_sort(F.collect_list(F.struct("i", "tool", feature.alias("t")))).alias("features"))
    have = F.coalesce("features", F.array().cast(whole.schema["features"].dataType))
    # tools in the order of their first instances; those without a feature come last, by name
    every = F.array_distinct(F.concat(F.transform(have, lambda x: x["tool"]), F.array(*map(F.lit, sorted(tools))).cast("array<string>")))
    own = lambda tool: F.transform(F.filter(have, lambda x: x["tool"] == tool), lambda x: x["t"])
    listed = F.transform(every, lambda x: F.concat(F.lit(","), _quoted(x), F.lit(":{"), F.array_join(own(x), ","), F.lit("}")))
    head = F.concat(_quoted(F.col("protein_id")), F.lit(':{"length":'), F.coalesce(F.col("length").cast("string"), F.lit("null")))
    return doc.proteins.join(whole, "protein_id", "left").select("protein_id", F.concat(head, F.array_join(listed, ""), F.lit("}")).alias("value"))


#: The sections of a document after its proteins, in order.
_MAPS = ("clan", "interproID", "length", "count", "version")


def document_lines(doc: Document, tools: Sequence[str] = (), documents: int = 1) -> DataFrame:
    """shard, value: the lines of so many JSON texts, in order within a partition for each text. Every text is a
    document: with the dimensions of its own features, its own counts, and all versions. An entry of a map is a line,
    so that no row holds more than a protein."""
    spark = doc.proteins.sparkSession
    shard = F.pmod(F.xxhash64(F.col("protein_id").cast("string")), F.lit(documents)).cast("int").alias("shard")
    # written, so that the features' maps do not count them anew
    counts = cut(counted_by(doc, shard) if documents > 1 else doc.counts.withColumn("shard", F.lit(0)), "feature-counts")
    features = counts.select("shard", "feature")
    every = spark.range(documents).select(F.col("id").cast("int").alias("shard"))
    maps = [
        (features.join(doc.clans, "feature"), "feature", _quoted(F.col("clan"))),
        (features.join(doc.accessions, "feature"), "feature", _quoted(F.col("interpro"))),
        (features.join(doc.lengths, "feature"), "feature", F.col("plen").cast("string")),
        (counts, "feature", F.col("n").cast("string")),
        (every.crossJoin(doc.versions), "tool", F.to_json("info")),
    ]
    out = protein_lines(doc, tools).select(shard, F.lit(0).alias("section"), F.lit(False).alias("opens"), F.col("protein_id").cast("string").alias("key"), "value")
    for k, (rows, key, value) in enumerate(maps, 1):
        out = out.union(rows.select("shard", F.lit(k), F.lit(False), key, F.concat(_quoted(F.col(key)), F.lit(":"), value)))
    opening = ['{"feature":{', *[f'}},"{name}":{{' for name in _MAPS], "}}"]
    heads = F.posexplode(F.array(*map(F.lit, opening))).alias("section", "value")
    out = out.union(every.select("shard", heads).select("shard", "section", F.lit(True), F.lit(""), "value"))
    order = Window.partitionBy("shard").orderBy("section", F.col("opens").desc(), "key")
    comma = F.when(~F.col("opens") & ~F.lag("opens").over(order), F.lit(",")).otherwise(F.lit(""))
    # a text's lines go by in its own partition, which the window takes as it is
    return out.repartitionById(documents, "shard").select("shard", F.concat(comma, "value").alias("value"))


def counted_by(doc: Document, shard: Column) -> DataFrame:
    return doc.instances.groupBy(shard, "feature").agg(F.count(F.lit(1)).alias("n"))


def write(doc: Document, path: str, name: str, tools: Sequence[str] = (), proteins_per_document: int = 20_000) -> None:
    """``name.json``, or ``name-00000.json`` and so on, of about so many proteins each, in ``path``. A reader takes a
    text whole (2 GB at most) unless it reads in parts, so that a large proteome had better not be one."""
    n = max(1, -(-doc.proteins.count() // proteins_per_document))
    document_lines(doc, tools, n).select("value").write.text(path)
    drop_shuffles(doc.proteins.sparkSession)
    rename_files(doc.proteins.sparkSession, path, ".txt", lambda k, n: f"{name}.json" if n == 1 else f"{name}-{k:05d}.json")
