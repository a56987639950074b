"""Text formats: sequences, tool lists, constraints, tables of the domain databases, pair lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .positions import placed, with_positions


def parse_tool_list(text: str) -> list[tuple[str, bool, int]]:
    """(tool, linearized, pos) from the sections ``#linearized`` and ``#normal``; a ``#checked`` mark is skipped."""
    out: list[tuple[str, bool, int]] = []
    section: bool | None = None
    for line in map(str.strip, text.splitlines()):
        if line.startswith("#"):
            name = line[1:].strip().lower()
            if name in ("linearized", "normal"):
                section = name == "linearized"
        elif line:
            if section is None:
                raise ValueError(f"tool {line!r} stands before any section")
            out.append((line.lower(), section, len(out)))
    return out


def read_tool_list(spark: SparkSession, path: str) -> DataFrame:
    """The tool list of a configuration file (a few lines) as tool, linearized, pos."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(parse_tool_list(text), "tool string, linearized boolean, pos int")


def annotation_tools(text: str) -> list[str]:
    """The tools of a flat list that installation has marked as ``#checked``."""
    lines = [x.strip() for x in text.splitlines()]
    if "#checked" not in lines:
        raise ValueError("the tool list has not been checked")
    return [x.lower() for x in lines if x and not x.startswith("#")]


def parse_constraints(text: str) -> dict[str, float]:
    """Weights by tool (first section; ``N``: none) and by feature (second section)."""
    out: dict[str, float] = {}
    sections = 0
    for line in map(str.strip, text.splitlines()):
        if line.startswith("#"):
            sections += 1
        elif line:
            if not sections:
                raise ValueError("constraints must begin with a # line")
            name, _, value = line.partition("\t")
            if value.strip() != "N" or sections > 1:
                out[name.lower() if sections == 1 else name] = float(value)
    return out


def read_fasta(spark: SparkSession, path: str, positions: bool = False) -> DataFrame:
    """id, header, sequence, length of every record, with ``positions`` also pos, from 0 in order of the files."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    if positions:
        rows = with_positions(placed(rows).where("trim(value) not in ('', '>')"))
    body = F.regexp_replace("value", r"\A>", "")
    header = F.trim(F.regexp_replace(F.regexp_extract(body, r"\A([^\n]*)", 1), "\r", ""))
    sequence = F.regexp_replace(F.regexp_replace(body, r"\A[^\n]*", ""), r"\s", "")
    pos = ["pos"] if positions else []
    out = rows.select(header.alias("header"), sequence.alias("sequence"), *pos).where("header <> ''")
    return out.select(F.regexp_extract("header", r"^(\S+)", 1).alias("id"), "header", "sequence", F.length("sequence").alias("length"), *pos)


def unique_ids(fasta: DataFrame) -> DataFrame:
    """The records, or an error where an id comes twice."""
    twice = fasta.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    bad = F.when(F.col("_n").isNotNull(), F.raise_error(F.concat(F.lit("sequence id comes twice: "), F.col("id")))).otherwise(F.lit(True))
    return fasta.join(twice, "id", "left").where(bad.cast("boolean")).drop("_n")


def extended_headers(fasta: DataFrame) -> DataFrame:
    """grp, taxon, protein_id, flag, sequence, pos from headers ``group|taxon|protein|flag`` of records that were read
    with their positions."""
    parts = F.split("header", r"\|")
    return fasta.withColumn("p", parts).where(F.size("p") >= 3).select(F.col("p")[0].alias("grp"), F.col("p")[1].alias("taxon"), F.col("p")[2].alias("protein_id"), F.get("p", F.lit(3)).alias("flag"), "sequence", "pos")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="seed string, query string")


def four_columns(lines: DataFrame) -> DataFrame:
    """id1, tax1, id2, tax2 from white-space separated lines; lines of another width are passed over."""
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 4)
    return parts.select(*[F.col("p")[k].alias(n) for k, n in enumerate(("id1", "tax1", "id2", "tax2"))])


def id_list(lines: DataFrame) -> DataFrame:
    return lines.select(F.regexp_replace(F.trim("value"), r"^>+", "").alias("protein_id")).where("protein_id <> ''")


def two_columns(lines: DataFrame, key: str, value: str) -> DataFrame:
    """A white-space separated table of two columns."""
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 2)
    return parts.select(F.col("p")[0].alias(key), F.col("p")[1].alias(value))


def read_mapping(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A table of two columns, in which the last line of a key counts, in order of the files."""
    lines = placed(spark.read.text(path)).withColumn("_p", F.split(F.trim("value"), r"\s+")).where(F.size("_p") >= 2)
    at = F.struct("_file", "_start", "_row")
    return last_per_key(lines.select(F.col("_p")[0].alias(key), F.col("_p")[1].alias(value), at.alias("_at")), key, "_at")


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in rows.columns if c not in (key, order)])


def domain_family_blocks(spark: SparkSession, path: str) -> DataFrame:
    """id, accession, accession_base, clan (NA where none), length of the family records, which ``//`` ends."""
    rows = spark.read.option("lineSep", "//\n").text(path)
    field = lambda name: F.regexp_extract("value", rf"(?m)^#=GF {name}\s+(\S+)", 1)
    out = rows.select(field("ID").alias("id"), field("AC").alias("accession"), field("CL").alias("clan"), F.expr("try_cast(regexp_extract(value, '(?m)^#=GF ML +([0-9]+)', 1) as int)").alias("length")).where("id <> ''")
    return out.withColumns({"clan": F.when(F.col("clan") == "", F.lit("NA")).otherwise(F.col("clan")), "accession_base": F.substring_index("accession", ".", 1)})


def profile_lengths(lines: DataFrame) -> DataFrame:
    """(feature, plen) from NAME and LENG lines of profile files: lines with file and pos."""
    from pyspark.sql import Window

    name = F.when(F.col("value").startswith("NAME"), F.regexp_extract("value", r"^NAME\s+(\S+)", 1))
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("feature", F.last(name, ignorenulls=True).over(order))
    return named.where(F.col("value").startswith("LENG")).select("feature", F.expr("try_cast(regexp_extract(value, '^LENG +([0-9]+)', 1) as int)").alias("plen"))


def clustal_to_sequences(lines: DataFrame) -> DataFrame:
    """Alignment blocks (lines with file and pos) as one sequence per id; dots in ids become underscores."""
    parts = lines.where("value not like 'CLUSTAL%'").withColumn("p", F.split(F.rtrim("value"), r"\s+")).where((F.size("p") >= 2) & F.col("value").rlike(r"^\S"))
    rows = parts.select("file", F.replace(F.col("p")[0], F.lit("."), F.lit("_")).alias("id"), "pos", F.col("p")[1].alias("s"))
    return rows.groupBy("file", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("sequence"))


def interpro_table(rows: DataFrame, families: DataFrame, lengths: DataFrame, tools: list[str]) -> DataFrame:
    """Instances from an InterProScan table (protein_id, length, accession, start, stop, evalue, tool, interpro).

    Accessions of family records become names, with their clan (none: null) and profile length; a minus sign is no
    e-value; a tool that is not in ``tools`` is an error.
    """
    known = F.when(F.lower("tool").isin(tools), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown tool: "), F.col("tool"))).cast("boolean"))
    named = rows.where(known).withColumn("tool", F.lower("tool")).join(families.select(F.col("accession_base").alias("accession"), "id", F.nullif("clan", F.lit("NA")).alias("clan")), "accession", "left")
    named = named.withColumn("name", F.when(F.col("tool") == "pfam", F.coalesce("id", "accession")).otherwise(F.col("accession")))
    named = named.withColumn("feature", F.concat_ws("_", "tool", "name")).join(lengths.select("feature", "plen"), "feature", "left")
    return named.select("protein_id", "length", "tool", "feature", F.when(F.col("tool") == "pfam", F.col("clan")).alias("clan"), "start", "stop", F.expr("try_cast(evalue as double)").alias("evalue"), F.nullif("interpro", F.lit("-")).alias("interpro"), "plen")


def with_featureless(instances: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every sequence, those without instances as one row of nulls."""
    have = instances.select("protein_id").distinct()
    rest = sequences.select(F.col("id").alias("protein_id"), "length").join(have, "protein_id", "left_anti")
    return instances.unionByName(rest, allowMissingColumns=True)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a domain table with header, as text."""
    return spark.read.csv(path, sep="\t", header=True)


def read_score_table(spark: SparkSession, path: str) -> DataFrame:
    """seed, query, fwd_final, rev_final from a score table; NA is null."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col("Seed").alias("seed"), F.col("Query").alias("query"), F.expr("try_cast(split(Score, '/')[0] as double)").alias("fwd_final"), F.expr("try_cast(get(split(Score, '/'), 1) as double)").alias("rev_final"))


def read_score_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seed, query, fwd_final, rev_final, pos from score objects ``{"seed_query": ["fwd", "rev"], ...}``; NA is null.

    An object may be of any size: it is cut where its values end, so that several tasks read it. An id with ``]``,
    and a key that is not two ids around one underscore, are errors.
    """
    parts = with_positions(placed(spark.read.option("lineSep", "]").text(path)).where(r"value not rlike '^[\\s{},\\[]*$'"))
    pattern = r'^[\s{},]*"((?:[^"\\]|\\.)*)"\s*:\s*\[\s*"?([^",\s]*)"?\s*,\s*"?([^",\s]*)"?\s*$'
    found = [F.regexp_extract("value", pattern, k) for k in (1, 2, 3)]
    key = F.from_json(F.concat(F.lit('["'), found[0], F.lit('"]')), "array<string>")[0]
    rows = parts.select("value", "pos", key.alias("key"), found[1].alias("fwd"), found[2].alias("rev"))
    fits = F.coalesce(F.length(F.regexp_replace("key", "[^_]", "")) == 1, F.lit(False))
    rows = rows.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no score of a pair: "), F.col("value")))).cast("boolean"))
    ids = F.split("key", "_")
    return rows.select(ids[0].alias("seed"), ids[1].alias("query"), F.expr("try_cast(fwd as double)").alias("fwd_final"), F.expr("try_cast(rev as double)").alias("rev_final"), "pos")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores of a Parquet table or, of files that end in .json, of score objects."""
    return read_score_json(spark, path).drop("pos") if path.endswith(".json") else spark.read.parquet(path)
