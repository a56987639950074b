"""Registered queries of the file formats and annotation documents: texts of the whole tables are written to files in
the shared folder and read by the parser, with the SQL that gives the same rows from the tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import _FOUR, _GROUPS, INST, PAIRS, UNLIN, _members, _unlinearized, query
from .operators import documents as D
from .operators import maintenance as M
from .operators import reports
from .options import ScoringOptions
from .plans import architecture as A
from .plans import weights
from .sources import predictors, text
from .sources import surrogate as S
from .storage import new_path


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _file(lines: DataFrame, name: str, order: str | None = None, line_sep: str = "\n") -> str:
    """The path of files of the lines in ``value``, by name and line in order of ``order`` where order matters."""
    path = new_path(lines.sparkSession, name)
    if order:
        lines = lines.orderBy(order)
    lines.select("value").write.option("lineSep", line_sep).text(path)
    return path


def _text(spark, lines: DataFrame, name: str, order: str) -> str:
    """The text of a small file, as the readers of configuration files take it."""
    return "\n".join(r["value"] for r in spark.read.text(_file(lines, name, order), wholetext=True).collect())


# configuration files


@query("tool_list", "SELECT lower(n_name) AS tool, n_nationkey % 2 = 0 AS linearized, CAST(row_number() OVER (ORDER BY n_nationkey % 2, n_nationkey) - 1 AS INTEGER) AS pos FROM nation")
def tool_list(spark, d):
    n = S.read(spark, d, "nation").select((F.col("n_nationkey") % 2 * 1000 + F.col("n_nationkey") + 1).alias("k"), F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("value"))
    marks = spark.createDataFrame([(0, "#linearized"), (1000, "#Normal"), (3000, "#checked")], "k long, value string")
    return text.read_tool_list(spark, _file(n.union(marks), "tool-list", "k"))


@query("annotation_tool_list", "SELECT lower(r_name) AS tool FROM region")
def annotation_tool_list(spark, d):
    r = S.read(spark, d, "region").select("r_regionkey", F.concat("r_name", F.lit(" ")).alias("value"))
    tools = text.annotation_tools(_text(spark, r.union(spark.createDataFrame([(-1, "#checked")], "k long, value string")), "tools", "r_regionkey"))
    return spark.createDataFrame([(t,) for t in tools], "tool string")


@query("constraints_file", "SELECT lower(r_name) AS name, r_regionkey / 20.0::DOUBLE AS weight FROM region WHERE r_regionkey > 0 UNION ALL SELECT n_name, n_nationkey / 1000.0::DOUBLE FROM nation")
def constraints_file(spark, d):
    tools = S.read(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.concat_ws("\t", "r_name", F.when(F.col("r_regionkey") == 0, F.lit("N")).otherwise(_s(F.col("r_regionkey") / 20))).alias("value"))
    features = S.read(spark, d, "nation").select((F.col("n_nationkey") + 1000).alias("k"), F.concat_ws("\t", "n_name", _s(F.col("n_nationkey") / 1000)).alias("value"))
    marks = spark.createDataFrame([(-1, "#tools"), (999, "#features")], "k long, value string")
    found = text.parse_constraints(_text(spark, tools.union(features).union(marks), "constraints", "k"))
    return spark.createDataFrame(list(found.items()), "name string, weight double")


@query("weight_file", "SELECT n_name AS feature, n_nationkey / 100.0::DOUBLE AS weight FROM nation UNION ALL SELECT 'default', 0.25::DOUBLE")
def weight_file(spark, d):
    n = S.read(spark, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey") / 100))).alias("weights"))
    found, default = reports.parse_weight_file(_text(spark, n.select(F.to_json(F.struct("weights", F.lit(0.25).alias("default"))).alias("value")), "weights", "value"))
    return spark.createDataFrame([*found.items(), ("default", default)], "feature string, weight double")


@query("run_record", "SELECT unnest(['command: score', 'version: 1', 'a: 2', 'pairs: ' || CAST((SELECT count(*) FROM orders) AS VARCHAR)]) AS value")
def run_record(spark, d):
    path = new_path(spark, "run-record")
    reports.write_run_record(spark, path, {"pairs": S.universe(spark, d).count(), "a": 2}, "score", "1")
    return spark.read.text(path).select("value")


# tables


@query("pair_file", f"WITH {INST}{PAIRS} SELECT CAST(seed AS VARCHAR) AS seed, CAST(query AS VARCHAR) AS query FROM pairs")
def pair_file(spark, d):
    return text.read_pairs(spark, _file(S.pairs(spark, d).select(F.concat_ws("\t", "seed", "query").alias("value")), "pairs"))


@query("mapping_file", "SELECT 'p' || CAST(c_custkey AS VARCHAR) AS protein_id, 'ncbi' || CAST(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS VARCHAR) AS ncbi_id FROM customer")
def mapping_file(spark, d):
    """Ids to taxa; a third of the ids come twice, and the last line has it."""
    c = S.read(spark, d, "customer")
    line = lambda add: F.concat_ws("\t", F.concat(F.lit("p"), _s("c_custkey")), F.concat(F.lit("ncbi"), _s(F.col("c_nationkey") + add))).alias("value")
    lines = c.select(F.lit(0).alias("k"), line(0)).union(c.where("c_custkey % 3 = 0").select(F.lit(1), line(100)))
    return text.read_mapping(spark, _file(lines, "mapping", "k"), "protein_id", "ncbi_id")


@query("two_column_file", "SELECT 'f' || CAST(p_partkey AS VARCHAR) AS feature, CAST(p_size AS VARCHAR) AS plen FROM part")
def two_column_file(spark, d):
    lines = S.read(spark, d, "part").select(F.concat(F.lit("  f"), _s("p_partkey"), F.lit(" \t "), _s("p_size")).alias("value"))
    return text.two_columns(spark.read.text(_file(lines, "two-columns")), "feature", "plen")


@query("id_list_file", "SELECT 'p' || CAST(o_orderkey AS VARCHAR) AS protein_id FROM orders")
def id_list_file(spark, d):
    ids = S.universe(spark, d).select(F.concat(F.when(F.col("protein_id") % 2 == 0, F.lit(">")).otherwise(F.lit(" ")), F.lit("p"), _s("protein_id"), F.lit("\n")).alias("value"))
    return text.id_list(spark.read.text(_file(ids, "ids")))


@query("domain_table_file", f"WITH {INST} SELECT CAST(protein_id AS VARCHAR) AS ortholog, feature, CAST(start AS VARCHAR) AS start, CAST(stop AS VARCHAR) AS stop, 'IPR' || CAST(i AS VARCHAR) AS interpro FROM inst")
def domain_table_file(spark, d):
    rows = S.instances(spark, d).select(F.concat_ws("#", "protein_id", "protein_id").alias("pair_id"), F.col("protein_id").alias("ortholog"), "feature", "start", "stop", F.concat(F.lit("IPR"), _s("i")).alias("interpro"))
    path = new_path(spark, "domain-table")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return text.read_domains(spark, path).select("ortholog", "feature", "start", "stop", "interpro")


@query("score_table_file", f"WITH {UNLIN[5:]} SELECT CAST(seed AS VARCHAR) AS \"Seed\", CAST(query AS VARCHAR) AS \"Query\", {_FOUR.format('ms')} || '/NA' AS \"Score\", {_FOUR.format('ms')} || '/NA' AS \"MS\", 'x' AS \"Method\" FROM u")
def score_table_file(spark, d):
    """The eight columns of a score file, written and read."""
    keys = ("final", "ms", "ps", "cs", "ls")
    u = _unlinearized(spark, d).select("seed", "query", F.lit("x").alias("mode"), *[F.col("ms").alias(f"fwd_{k}") for k in keys], *[F.lit(None).cast("double").alias(f"rev_{k}") for k in keys])
    path = new_path(spark, "score-table")
    reports.write_score_table(u, path)
    return spark.read.csv(path, sep="\t", header=True).select("Seed", "Query", "Score", "MS", "Method")


@query("score_table_read", f"WITH {UNLIN[5:]} SELECT CAST(seed AS VARCHAR) AS seed, CAST(query AS VARCHAR) AS query, CAST({_FOUR.format('ms')} AS DOUBLE) AS fwd_final, CASE WHEN seed % 2 = 0 THEN CAST({_FOUR.format('ms')} AS DOUBLE) END AS rev_final FROM u")
def score_table_read(spark, d):
    keys = ("final", "ms", "ps", "cs", "ls")
    back = F.when(F.col("seed") % 2 == 0, F.col("ms"))
    u = _unlinearized(spark, d).select("seed", "query", F.lit("x").alias("mode"), *[F.col("ms").alias(f"fwd_{k}") for k in keys], *[back.alias(f"rev_{k}") for k in keys])
    path = new_path(spark, "score-table")
    reports.write_score_table(u, path)
    return text.read_score_table(spark, path)


# sequences and domain databases

_SEQUENCE = "upper(md5(CAST(p_partkey AS VARCHAR)))"


def _fasta(spark, d) -> str:
    p = S.read(spark, d, "part")
    sequence = F.upper(F.md5(_s("p_partkey")))
    record = F.concat(F.lit(">s"), _s("p_partkey"), F.lit(" "), F.col("p_name"), F.lit("\n"), F.substring(sequence, 1, 20), F.lit("\n"), F.substring(sequence, 21, 20))
    return _file(p.select(record.alias("value")), "fasta")


@query("fasta_records", f"SELECT 's' || CAST(p_partkey AS VARCHAR) AS id, 's' || CAST(p_partkey AS VARCHAR) || ' ' || p_name AS header, {_SEQUENCE} AS sequence, 32 AS length FROM part")
def fasta_records(spark, d):
    return text.read_fasta(spark, _fasta(spark, d))


@query("fasta_lengths", "SELECT 's' || CAST(p_partkey AS VARCHAR) AS id, 32 AS length FROM part")
def fasta_lengths(spark, d):
    return text.read_fasta(spark, _fasta(spark, d)).select("id", "length")


@query("fasta_unique_ids", "SELECT 's' || CAST(p_partkey AS VARCHAR) AS id FROM part")
def fasta_unique_ids(spark, d):
    return text.unique_ids(text.read_fasta(spark, _fasta(spark, d))).select("id")


@query("extract_for_fasta", f"WITH {INST} SELECT protein_id, i, feature, start, stop FROM inst WHERE protein_id % 4 = 1")
def extract_for_fasta(spark, d):
    """The annotation of a FASTA file's sequences: every fourth protein that is annotated."""
    rows = S.instances(spark, d)
    ids = rows.where("protein_id % 4 = 1").select("protein_id").distinct().select(F.concat(F.lit(">"), _s("protein_id"), F.lit("\nMKV")).alias("value"))
    fasta = text.read_fasta(spark, _file(ids, "fasta")).select(F.col("id").cast("long").alias("id"))
    return M.extract_for_sequences(rows, fasta).select("protein_id", "i", "feature", "start", "stop")


@query("ortholog_headers", "SELECT 'g' || CAST(o_custkey AS VARCHAR) AS grp, 't' || CAST(c_nationkey AS VARCHAR) AS taxon, 'p' || CAST(o_orderkey AS VARCHAR) AS protein_id, CAST(o_orderkey % 2 AS VARCHAR) AS flag, 'MKV' AS sequence, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders JOIN customer ON c_custkey = o_custkey")
def ortholog_headers(spark, d):
    m = _members(spark, d)
    header = F.concat_ws("|", F.concat(F.lit(">g"), _s("grp")), F.concat(F.lit("t"), _s("taxon")), F.concat(F.lit("p"), _s("protein_id")), _s(F.col("protein_id") % 2))
    path = _file(m.select("protein_id", F.concat(header, F.lit("\nMK\nV")).alias("value")), "groups", "protein_id")
    return text.extended_headers(text.read_fasta(spark, path, positions=True))


@query("score_json_read", f"{UNLIN} SELECT CAST(seed AS VARCHAR) AS seed, CAST(query AS VARCHAR) AS query, round(ms, 12) AS fwd_final, CASE WHEN query % 2 = 0 THEN round(ps, 12) END AS rev_final, row_number() OVER (ORDER BY seed, query) - 1 AS pos FROM u")
def score_json_read(spark, d):
    """One score object of all pairs, over several files, read in parts."""
    scores = _unlinearized(spark, d).select("seed", "query", F.round("ms", 12).alias("f"), F.when(F.col("query") % 2 == 0, F.round("ps", 12)).alias("r"))
    lines = scores.select("seed", "query", F.format_string('"%s_%s": ["%s", "%s"],', _s("seed"), _s("query"), _s("f"), F.coalesce(_s("r"), F.lit("NA"))).alias("value"))
    path = new_path(spark, "score-json")
    lines.orderBy("seed", "query").select("value").write.text(path)
    return text.read_score_json(spark, path)


def _families(spark, d) -> DataFrame:
    p = S.read(spark, d, "part")
    clan = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("#=GF CL   CL"), _s("p_size"), F.lit("\n"))).otherwise(F.lit(""))
    record = F.concat(F.lit("# STOCKHOLM 1.0\n#=GF ID   F"), _s("p_partkey"), F.lit("\n#=GF AC   PF"), _s("p_partkey"), F.lit("."), _s("p_size"), F.lit("\n"), clan, F.lit("#=GF ML   "), _s("p_size"), F.lit("\n"))
    return text.domain_family_blocks(spark, _file(p.select(record.alias("value")), "families", line_sep="//\n"))


@query("domain_families", "SELECT 'F' || CAST(p_partkey AS VARCHAR) AS id, 'PF' || CAST(p_partkey AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) AS accession, CASE WHEN p_size % 2 = 0 THEN 'CL' || CAST(p_size AS VARCHAR) ELSE 'NA' END AS clan, CAST(p_size AS INTEGER) AS length FROM part")
def domain_families(spark, d):
    return _families(spark, d).select("id", "accession", "clan", "length")


@query("domain_families_by_accession", "SELECT 'PF' || CAST(p_partkey AS VARCHAR) AS accession_base, 'F' || CAST(p_partkey AS VARCHAR) AS id FROM part")
def domain_families_by_accession(spark, d):
    return _families(spark, d).select("accession_base", "id")


@query("clustal_sequences", "SELECT 'b' || CAST(c_nationkey AS VARCHAR) AS file, 'c_' || CAST(c_custkey AS VARCHAR) AS id, 'ACD' || CAST(c_custkey % 10 AS VARCHAR) || 'EF' || 'GHI' AS sequence FROM customer")
def clustal_sequences(spark, d):
    """An alignment for each nation, in two blocks."""
    c = S.read(spark, d, "customer").select(F.concat(F.lit("b"), _s("c_nationkey")).alias("file"), "c_custkey")
    id_ = F.concat(F.lit("c."), _s("c_custkey"))
    one = c.select("file", F.col("c_custkey").alias("pos"), F.concat(id_, F.lit("    ACD"), _s(F.col("c_custkey") % 10), F.lit("EF")).alias("value"))
    two = c.select("file", F.col("c_custkey") + (1 << 40), F.concat(id_, F.lit("    GHI")))
    head = c.select("file").distinct().select("file", F.lit(-1).cast("long"), F.lit("CLUSTAL W (1.8)"))
    stars = c.select("file").distinct().select("file", F.lit(1 << 39).cast("long"), F.lit("        ***"))
    return text.clustal_to_sequences(one.union(two).union(head).union(stars))


# predictors


@query("flps_regions", "SELECT 'p' || CAST(l_orderkey AS VARCHAR) AS id, 'flps_' || l_returnflag || '_{' || l_linestatus || '}' AS feature, CAST(l_linenumber * 10 AS INTEGER) AS start, CAST(l_linenumber * 10 + l_suppkey AS INTEGER) AS stop, l_discount AS evalue, 0.001::DOUBLE AS feature_evalue FROM lineitem")
def flps_regions(spark, d):
    start = F.col("l_linenumber") * 10
    cells = [F.concat(F.lit("p"), _s("l_orderkey")), F.col("l_returnflag"), F.lit("1"), _s(start), _s(start + F.col("l_suppkey")), F.lit("8"), _s("l_discount"), F.concat(F.lit("{"), "l_linestatus", F.lit("}"))]
    lines = S.read(spark, d, "lineitem").select(F.concat_ws("\t", *cells).alias("value"))
    return predictors.biased_regions(spark.read.text(_file(lines, "flps")), 0.001)


@query("tmhmm_segments", "WITH s AS (SELECT 'p' || CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 100 + 1 AS a FROM orders) SELECT id, 'tmhmm_transmembrane' AS feature, CAST(a AS INTEGER) AS start, CAST(a + 20 AS INTEGER) AS stop FROM s UNION ALL SELECT id, 'tmhmm_transmembrane', CAST(a + 50 AS INTEGER), CAST(a + 70 AS INTEGER) FROM s")
def tmhmm_segments(spark, d):
    a = F.col("protein_id") % 100 + 1
    value = F.concat(F.lit("%pred NB(0): o 1 "), _s(a - 1), F.lit(", M "), _s(a), F.lit(" "), _s(a + 20), F.lit(", i "), _s(a + 21), F.lit(" "), _s(a + 49), F.lit(", M "), _s(a + 50), F.lit(" "), _s(a + 70))
    lines = S.universe(spark, d).select(F.concat(F.lit("p"), _s("protein_id")).alias("id"), value.alias("value"))
    lines = lines.union(lines.select("id", F.lit("%score BG 1 2")))
    return predictors.transmembrane(lines).drop("evalue")


@query("signalp_peptides", "SELECT 'p' || CAST(c_custkey AS VARCHAR) AS id, 'signalp_SIGNALP' AS feature, 1 AS start, CAST(c_custkey % 40 + 1 AS INTEGER) AS stop FROM customer WHERE c_acctbal > 0")
def signalp_peptides(spark, d):
    cells = [F.concat(F.lit("p"), _s("c_custkey")), *map(F.lit, ("0.1", "20", "0.1")), _s(F.col("c_custkey") % 40 + 2), *map(F.lit, ("0.1", "1", "0.1", "0.4")), F.when(F.col("c_acctbal") > 0, "Y").otherwise("N"), F.lit("0.45"), F.lit("net")]
    lines = S.read(spark, d, "customer").select(F.concat_ws("   ", *cells).alias("value")).union(spark.createDataFrame([("# name Cmax pos",), ("Temporary files in x",)], "value string"))
    return predictors.signal_peptides(spark.read.text(_file(lines, "signalp"))).drop("evalue")


@query("seg_regions", "SELECT 'p' || CAST(l_orderkey AS VARCHAR) AS id, 'seg_low_complexity_regions' AS feature, CAST(l_linenumber AS INTEGER) AS start, CAST(l_linenumber + l_suppkey AS INTEGER) AS stop FROM lineitem")
def seg_regions(spark, d):
    value = F.concat(F.lit(" abcabc  "), _s("l_linenumber"), F.lit("-"), _s(F.col("l_linenumber") + F.col("l_suppkey")))
    lines = S.read(spark, d, "lineitem").select(F.concat(F.lit("p"), _s("l_orderkey")).alias("id"), value.alias("value"))
    return predictors.low_complexity(lines.union(lines.select("id", F.lit("MKLV")))).drop("evalue")


@query("hmmscan_hits", f"WITH {INST}, f AS (SELECT protein_id, feature, min(evalue) AS feature_evalue FROM inst GROUP BY 1, 2) SELECT 'p' || CAST(protein_id AS VARCHAR) AS id, 400 AS length, 'x_' || feature AS feature, feature_evalue, start, stop, evalue, CAST(i AS DOUBLE) AS bit_score, CAST(3 AS INTEGER) AS hmm_from, CAST(i + 4 AS INTEGER) AS hmm_to FROM inst JOIN f USING (protein_id, feature) WHERE feature_evalue <= 0.05 AND evalue <= 0.04")
def hmmscan_hits(spark, d):
    """A report of a profile search for each protein, with a score line for each feature and a line for each domain."""
    domain = F.concat_ws("  ", F.lit(" 1 !"), _s(F.col("i").cast("double")), F.lit("0.1"), _s("evalue"), F.lit("0.5"), F.lit("3"), _s(F.col("i") + 4), F.lit(".. 5 44 .."), _s("start"), _s("stop"), F.lit(".. 0.95"))
    lines = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    features = S.instances(spark, d).groupBy("protein_id", "feature").agg(F.min("evalue").alias("e"), lines(domain).alias("domains"))
    hit = F.concat_ws("  ", _s("e"), F.lit("100.1 0.1 2e-20 90.0 0.1 1.2 1"), "feature", F.lit("text"))
    block = F.concat(F.lit(">> "), "feature", F.lit(" text\n"), "domains")
    whole = features.groupBy("protein_id").agg(lines(hit).alias("hits"), lines(block).alias("blocks"))
    report = F.concat(F.lit("Query:       p"), _s("protein_id"), F.lit("  [L=400]\n"), "hits", F.lit("\nDomain annotation for each model:\n"), "blocks", F.lit("\n"))
    path = _file(whole.select(report.alias("value")), "reports", line_sep="//\n")
    return predictors.profile_hits(spark.read.option("lineSep", "//\n").text(path), "x", 0.05, 0.04)


# annotation documents

_EVERY = "doc AS (SELECT CAST(protein_id AS VARCHAR) AS protein_id, tool, feature, i, start, stop, evalue FROM inst)"


def _document(spark, d, where: str = "true", shift: int = 0) -> D.Document:
    rows = S.instances(spark, d).where(where).withColumn("protein_id", _s("protein_id")).withColumns({"start": F.col("start") + shift, "stop": F.col("stop") + shift})
    proteins = S.universe(spark, d).where(where).select(_s("protein_id").alias("protein_id"), F.lit(S.LENGTH).alias("length"))
    rows = D.completed(rows)
    clans = S.instances(spark, d).where(where).where("clan is not null").select("feature", "clan").distinct()
    versions = spark.createDataFrame([("pfam", {"version": str(35 + shift)}), (f"tool{shift}", {"version": "1"})], "tool string, info map<string,string>")
    return D.Document(rows, proteins, clans, S.accessions(spark), S.profile_lengths(spark), versions, D.counted(rows))


def _rows(doc: D.Document) -> DataFrame:
    return doc.instances.select("protein_id", "tool", "feature", "start", "stop", "evalue")


def _pairs_of(doc: D.Document) -> DataFrame:
    """kind, key, value of every map of a document, and its proteins."""
    parts = [(doc.clans, "clan", "feature", F.col("clan")), (doc.accessions, "interproID", "feature", F.col("interpro")), (doc.lengths, "length", "feature", _s("plen")), (doc.counts, "count", "feature", _s("n")), (doc.versions, "version", "tool", F.to_json("info"))]
    out = doc.proteins.select(F.lit("protein").alias("kind"), F.col("protein_id").alias("key"), _s("length").alias("value"))
    for rows, kind, key, value in parts:
        out = out.union(rows.select(F.lit(kind), key, value))
    return out


_DOCUMENT = f"WITH {INST} SELECT CAST(protein_id AS VARCHAR) AS protein_id, tool, feature, CAST(row_number() OVER (PARTITION BY protein_id ORDER BY t, f, i) - 1 AS INTEGER) AS i, start, stop, evalue FROM (SELECT *, min(i) OVER (PARTITION BY protein_id, tool) AS t, min(i) OVER (PARTITION BY protein_id, tool, feature) AS f FROM inst)"


@query("annotation_document", _DOCUMENT)
def annotation_document(spark, d):
    """A proteome written as documents of some thousand proteins each, and read: instances are numbered in the order of
    the documents' keys."""
    path = new_path(spark, "annotation")
    D.write(_document(spark, d), path, "tax", ["pfam", "smart"], 5_000)
    return D.read(spark, f"{path}/*.json").instances.select("protein_id", "tool", "feature", "i", "start", "stop", "evalue")


@query("annotation_document_parts", _DOCUMENT)
def annotation_document_parts(spark, d):
    """The same from documents that are cut at their closing braces, so that several tasks read one."""
    path = new_path(spark, "annotation")
    D.write(_document(spark, d), path, "tax", ["pfam", "smart"], 1_000_000)
    doc = D.read(spark, f"{path}/*.json", in_parts=True)
    return doc.instances.select("protein_id", "tool", "feature", "i", "start", "stop", "evalue")


_MAPS = """SELECT 'clan' AS kind, feature AS key, clan AS value FROM (SELECT DISTINCT feature, clan FROM inst WHERE clan IS NOT NULL)
UNION ALL SELECT 'interproID', feature, x FROM (VALUES ('pfam_ECONOMY', 'IPR000001.3'), ('pfam_SMALL', 'IPR000002.1'), ('smart_PROMO', 'IPR000003')) t(feature, x)
UNION ALL SELECT 'length', feature, CAST(x AS VARCHAR) FROM (VALUES ('pfam_ECONOMY', 120), ('smart_MEDIUM', 77)) t(feature, x)"""
_PROTEINS = "SELECT 'protein' AS kind, CAST(o_orderkey AS VARCHAR) AS key, '400' AS value FROM orders"
_VERSIONS = "SELECT 'version' AS kind, x AS key, '{{\"version\":\"' || v || '\"}}' AS value FROM (VALUES {0}) t(x, v)"


@query("annotation_document_maps", f"WITH {INST} {_PROTEINS} UNION ALL {_MAPS} UNION ALL SELECT 'count', feature, CAST(count(*) AS VARCHAR) FROM inst GROUP BY feature UNION ALL " + _VERSIONS.format("('pfam', '35'), ('tool0', '1')"))
def annotation_document_maps(spark, d):
    path = new_path(spark, "annotation")
    D.write(_document(spark, d), path, "tax", ["pfam", "smart"], 5_000)
    return _pairs_of(D.read(spark, f"{path}/*.json"))


@query("annotation_build", f"WITH {INST}, {_EVERY} SELECT protein_id, tool, feature, start, stop, evalue FROM doc")
def annotation_build(spark, d):
    """A document from the outputs of three predictors."""
    rows = S.instances(spark, d).select(_s("protein_id").alias("id"), "tool", "feature", "start", "stop", "evalue")
    sequences = S.universe(spark, d).select(_s("protein_id").alias("id"), F.lit(S.LENGTH).alias("length"))
    families = spark.createDataFrame([("ECONOMY", "PF1.3", "CL1")], "id string, accession string, clan string")
    doc = D.build([rows.where(f"tool = '{t}'").drop("tool") for t in ("pfam", "smart", "tmhmm")], sequences, families, S.profile_lengths(spark), spark.createDataFrame([], "tool string, info map<string,string>"))
    return _rows(doc)


@query("annotation_merge_rows", f"WITH {INST}, {_EVERY} SELECT protein_id, tool, feature, start, stop, evalue FROM doc")
def annotation_merge_rows(spark, d):
    return _rows(D.merge([_document(spark, d, f"protein_id % 3 = {k}") for k in range(3)]))


@query("annotation_merge_maps", f"WITH {INST} {_PROTEINS} UNION ALL {_MAPS} UNION ALL SELECT 'count', feature, CAST(count(*) AS VARCHAR) FROM inst GROUP BY feature UNION ALL " + _VERSIONS.format("('pfam', '35'), ('tool0', '1'), ('tool7', '1')"))
def annotation_merge_maps(spark, d):
    """Of two documents: the first one's version, both ones' tools, the sum of their counts."""
    return _pairs_of(D.merge([_document(spark, d, "protein_id % 2 = 0"), _document(spark, d, "protein_id % 2 = 1", 7)]))


@query("annotation_update_rows", f"WITH {INST}, {_EVERY} SELECT protein_id, tool, feature, CASE WHEN CAST(protein_id AS BIGINT) % 3 = 0 THEN start + 7 ELSE start END AS start, CASE WHEN CAST(protein_id AS BIGINT) % 3 = 0 THEN stop + 7 ELSE stop END AS stop, evalue FROM doc")
def annotation_update_rows(spark, d):
    return _rows(D.update(_document(spark, d), _document(spark, d, "protein_id % 3 = 0", 7)))


@query("annotation_update_maps", f"WITH {INST} {_PROTEINS} UNION ALL {_MAPS} UNION ALL SELECT 'count', feature, CAST(coalesce(new.n, old.n) AS VARCHAR) FROM (SELECT feature, count(*) AS n FROM inst GROUP BY 1) old LEFT JOIN (SELECT feature, count(*) AS n FROM inst WHERE protein_id % 3 = 0 GROUP BY 1) new USING (feature) UNION ALL " + _VERSIONS.format("('pfam', '42'), ('tool0', '1'), ('tool7', '1')"))
def annotation_update_maps(spark, d):
    """The new document's versions and counts stand in place of the old ones."""
    return _pairs_of(D.update(_document(spark, d), _document(spark, d, "protein_id % 3 = 0", 7)))


@query("annotation_add_information", f"WITH {INST} SELECT 'interproID' AS kind, feature AS key, x AS value FROM (SELECT DISTINCT feature FROM inst) JOIN (VALUES ('pfam_ECONOMY', 'PF1.3'), ('pfam_SMALL', 'PF2.1')) t(feature, x) USING (feature) UNION ALL SELECT 'length', feature, CAST(x AS VARCHAR) FROM (SELECT DISTINCT feature FROM inst) JOIN (VALUES ('pfam_ECONOMY', 120), ('smart_MEDIUM', 77)) t(feature, x) USING (feature) UNION ALL " + _VERSIONS.format("('pfam', '35'), ('tool0', '1')"))
def annotation_add_information(spark, d):
    """Accessions and lengths for a document that has none; its versions stay."""
    doc = _document(spark, d)
    bare = replace(doc, accessions=doc.accessions.where("false"), lengths=doc.lengths.where("false"))
    families = spark.createDataFrame([("ECONOMY", "PF1.3", "CL1"), ("SMALL", "PF2.1", "NA"), ("NONE", "PF9.1", "NA")], "id string, accession string, clan string")
    full = D.add_information(bare, families, S.profile_lengths(spark), spark.createDataFrame([("x", {"version": "9"})], "tool string, info map<string,string>"))
    return _pairs_of(full).where("kind in ('interproID', 'length', 'version')")


@query("annotation_fill", f"WITH {INST}, {_EVERY} SELECT protein_id, tool, feature, CASE WHEN CAST(protein_id AS BIGINT) % 5 = 0 THEN start + 7 ELSE start END AS start, CASE WHEN CAST(protein_id AS BIGINT) % 5 = 0 THEN stop + 7 ELSE stop END AS stop, evalue FROM doc")
def annotation_fill(spark, d):
    """Proteins that a document misses come from another one; those that it has stay."""
    return _rows(D.fill(_document(spark, d, "protein_id % 5 <> 0"), _document(spark, d, "protein_id % 5 < 2", 7)))


@query("annotation_extract", f"WITH {INST} SELECT 'protein' AS kind, CAST(o_orderkey AS VARCHAR) AS key, '400' AS value FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'count', feature, CAST(count(*) AS VARCHAR) FROM inst WHERE protein_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY feature")
def annotation_extract(spark, d):
    ids = S.read(spark, d, "orders").where("o_orderstatus = 'O'").select(_s("o_orderkey").alias("protein_id"))
    return _pairs_of(D.extract(_document(spark, d), ids)).where("kind in ('protein', 'count')")


@query("annotation_outdated", "SELECT event_type AS tool, CAST(user_id AS VARCHAR) AS key, CAST(k AS VARCHAR) AS value, '5' AS installed FROM (SELECT event_type, user_id, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1, 2) WHERE k <> 5")
def annotation_outdated(spark, d):
    e = S.read(spark, d, "events").groupBy("event_type", "user_id").agg(F.max(F.get_json_object("props", "$.k").cast("long")).alias("k"))
    info = F.map_from_entries(F.collect_list(F.struct(_s("user_id"), _s("k"))))
    versions = e.groupBy(F.col("event_type").alias("tool")).agg(info.alias("info"))
    installed = e.select(F.col("event_type").alias("tool"), _s("user_id").alias("key"), F.lit("5").alias("value"))
    return D.check_versions(replace(_document(spark, d, "false"), versions=versions), installed)


@query("annotation_tools_missing", "SELECT unnest(['other', 'signalp']) AS tool")
def annotation_tools_missing(spark, d):
    """Of five tools those that no protein has features of, nor the document a version of."""
    return D.require_tools(_document(spark, d), ["pfam", "signalp", "smart", "tool0", "other"])


@query("disorder_document", "WITH m AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_totalprice > 150000 AS hit FROM orders), l AS (SELECT *, max(pos) OVER (PARTITION BY id) AS last FROM m), g AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM l WHERE hit) SELECT CAST(id AS VARCHAR) AS protein_id, 'aucpred' AS tool, 'aucpred_disordered_region' AS feature, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS stop, CAST(NULL AS DOUBLE) AS evalue FROM g GROUP BY id, g HAVING max(pos) < max(last)")
def disorder_document(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    residues = S.read(spark, d, "orders").select(_s("o_custkey").alias("id"), (F.row_number().over(w) - 1).alias("pos"), F.when(F.col("o_totalprice") > 150000, "*").otherwise(".").alias("mark"))
    doc, _ = D.disorder(residues)
    path = new_path(spark, "disorder")
    D.write(doc, path, "d", proteins_per_document=500)
    return _rows(D.read(spark, f"{path}/*.json"))


@query("feature_evalue_cut", f"WITH {INST}, f AS (SELECT protein_id, feature, min(evalue) AS fe FROM inst GROUP BY 1, 2) SELECT protein_id, i, feature, evalue FROM inst JOIN f USING (protein_id, feature) WHERE fe <= 0.02 AND evalue <= 0.05")
def feature_evalue_cut(spark, d):
    rows = S.instances(spark, d)
    named = rows.withColumn("feature_evalue", F.min("evalue").over(Window.partitionBy("protein_id", "feature")))
    return A.architecture(named, ScoringOptions(feature_evalue=0.02, instance_evalue=0.05)).select("protein_id", "i", "feature", "evalue")


@query("weights_rounded", f"WITH {INST}, c AS (SELECT feature, round_even(ln(CAST(count(*) AS DOUBLE)), 0) + 1 AS n FROM inst GROUP BY 1), r AS (SELECT protein_id, feature, round(sum(n) OVER (PARTITION BY protein_id) / n, 4) AS raw FROM (SELECT DISTINCT protein_id, feature FROM inst) JOIN c USING (feature)) SELECT protein_id, feature, round(raw / sum(raw) OVER (PARTITION BY protein_id), 4) AS weight FROM r")
def weights_rounded(spark, d):
    """Weights as result files have them, rounded to four decimals at each step."""
    rows = S.instances(spark, d)
    return weights.frequency_weights(rows, A.feature_counts(rows), ScoringOptions(digits=4))


@query("group_profile", f"WITH {_GROUPS}, {UNLIN[5:]} SELECT CAST(grp AS VARCHAR) AS \"geneID\", 'ncbi' || CAST(query_taxon AS VARCHAR) AS \"ncbiID\", concat_ws('|', CAST(grp AS VARCHAR), 'x@' || CAST(query_taxon AS VARCHAR) || '@1', CAST(groups.query AS VARCHAR), '1') AS \"orthoID\", round(u.ms, 3) AS \"FAS_F\", 0.0::DOUBLE AS \"FAS_B\" FROM groups JOIN u ON u.seed = groups.seed AND u.query = groups.query")
def group_profile(spark, d):
    g = M.ortholog_groups(_members(spark, d)).withColumn("query_taxon", F.concat(F.lit("x@"), _s("query_taxon"), F.lit("@1")))
    pairs = g.select("seed", "query").distinct()
    scores = _unlinearized(spark, d).join(pairs, ["seed", "query"], "left_semi").select("seed", "query", F.col("ms").alias("fwd_final"), F.lit(None).cast("double").alias("rev_final"))
    return reports.group_profile(scores, g)

