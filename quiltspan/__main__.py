"""Commands, for spark-submit or ``python -m quiltspan``: each reads files, runs one plan and writes a folder."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import maintenance as M
from .operators import documents as D
from .operators import overlap, reports
from .options import ScoringOptions
from .plans import linearise
from .sources import annotation, predictors, text
from .streaming import incremental

COMMANDS: dict[str, tuple[Callable, list[str]]] = {}


def command(*arguments: str):
    def add(f: Callable) -> Callable:
        COMMANDS[f.__name__.replace("_", "-")] = (f, list(arguments))
        return f

    return add


def _options(a) -> ScoringOptions:
    w = [float(x) for x in a.weights.split(",")]
    constraints = text.parse_constraints(_read(a.constraints)) if a.constraints else {}
    return ScoringOptions(a.feature_evalue, a.instance_evalue, a.max_overlap, a.max_overlap_share, a.max_features, a.max_paths, a.paths_limit, *w, a.count_correction, a.reference is None, a.empty_as_1, not a.no_linearization, a.digits, False, constraints)


def _read(path: str) -> str:
    spark = SparkSession.getActiveSession()
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def _load(spark, a, paths: str) -> api.Annotations:
    return api.load(spark, paths.split(","), _read(a.tools), a.extra.split(",") if a.extra else ())


def _write_scores(scores: DataFrame, a) -> None:
    table = scores.cache()
    reports.write_score_table(table, f"{a.out}/scores_tsv")
    reports.score_json(table).write.text(f"{a.out}/scores_json")
    table.write.parquet(f"{a.out}/scores")


def _counts(spark, a, annotations: api.Annotations) -> DataFrame | None:
    return None if a.reference is None else _load(spark, a, a.reference).feature_counts()


@command("--seeds", "--queries", "--pairs")
def score(spark, a, distance: bool = False) -> None:
    seeds, queries, o = _load(spark, a, a.seeds), _load(spark, a, a.queries), _options(a)
    for side in (seeds, queries):
        api.require_tools(side, [t for t, linearized, _ in text.parse_tool_list(_read(a.tools)) if linearized])
    pairs = text.read_pairs(spark, a.pairs) if a.pairs else None
    old = text.read_scores(spark, a.old).select("seed", "query") if a.old else None
    ref, w = _counts(spark, a, seeds), None
    if distance and a.weight_file:
        named, default = reports.parse_weight_file(_read(a.weight_file))
        o = replace(o, distance_default=default)
        w = spark.createDataFrame(list(named.items()), "feature string, weight double")
    out = api.score(seeds, queries, o, pairs, ref, bidirectional=not a.one_way, old=old, distance=distance, distance_weights=w)
    _write_scores(out, a)
    if not a.no_domains:
        out = spark.read.parquet(f"{a.out}/scores")
        far = {"distance": distance, "distance_weights": w}
        api.domains(out, seeds, queries, o, ref, **far).write.option("sep", "\t").option("header", True).csv(f"{a.out}/domains_forward")
        if not a.one_way:
            api.domains(out, seeds, queries, o, ref, True, **far).write.option("sep", "\t").option("header", True).csv(f"{a.out}/domains_reverse")
    if a.mapping:
        reports.phylogenetic_profile(out, text.read_mapping(spark, a.mapping, "protein_id", "ncbi_id")).write.option("sep", "\t").option("header", True).csv(f"{a.out}/phylogenetic_profile")
    reports.write_run_record(spark, f"{a.out}/run", {k: v for k, v in vars(a).items() if k != "command"}, a.command, "1")


@command("--seeds", "--queries", "--pairs")
def distance(spark, a) -> None:
    score(spark, a, True)


@command("--annotations", "--pairs")
def taxa(spark, a) -> None:
    annotations = _load(spark, a, a.annotations)
    four = text.four_columns(spark.read.text(a.pairs))
    M.missing_by_taxon(four, annotations.proteins).write.json(f"{a.out}/missing")
    _write_scores(api.score_taxa(annotations, four, _options(a), text.read_scores(spark, a.old).select("seed", "query") if a.old else None, not a.one_way), a)


@command("--annotations", "--fasta")
def groups(spark, a) -> None:
    members = text.extended_headers(text.read_fasta(spark, a.fasta, positions=True)).drop("sequence")
    if a.names:
        members = members.where(F.col("grp").isin(a.names.split(",")))
    rows, o = _load(spark, a, a.annotations), _options(a)
    found, scores = api.score_groups(rows, members, o, not a.one_way)
    found = found.join(members.select("grp", F.col("protein_id").alias("query"), "flag").dropDuplicates(["grp", "query"]), ["grp", "query"])
    found.write.parquet(f"{a.out}/groups")
    _write_scores(scores, a)
    out = spark.read.parquet(f"{a.out}/scores")
    reports.group_profile(out, found).write.option("sep", "\t").option("header", True).csv(f"{a.out}/phylogenetic_profile")
    if not a.no_domains:
        ref = None if o.uniform_weights else rows.feature_counts()
        for way in (False, True)[: 1 if a.one_way else 2]:
            d = api.domains(out, rows, rows, o, ref, way).withColumns({k: F.get(F.split("pair_id", "#"), F.lit(n)) for n, k in enumerate(("seed", "query"))})
            reports.group_domains(d, found).drop("seed", "query", "grp", "query_taxon").write.option("sep", "\t").option("header", True).csv(f"{a.out}/domains_{'reverse' if way else 'forward'}")


def _documents(spark, paths: str) -> list[D.Document]:
    return [D.read(spark, p) for p in paths.split(",")]


def _write_document(doc: D.Document, a) -> None:
    tools = [t for t, _, _ in text.parse_tool_list(_read(a.tools))] if a.tools else []
    D.write(doc, f"{a.out}/annotation", a.name, tools)


def _known(spark, a) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Family records, profile lengths and versions (JSON: tool to key to value), empty where no file is given."""
    families = text.domain_family_blocks(spark, a.families) if a.families else spark.createDataFrame([], "id string, accession string, clan string, length int")
    lengths = text.two_columns(spark.read.text(a.lengths), "feature", "plen").withColumn("plen", F.expr("try_cast(plen as int)")) if a.lengths else families.select(F.concat(F.lit("pfam_"), "id").alias("feature"), F.col("length").alias("plen"))
    stored = json.loads(_read(a.versions)) if a.versions else {}
    versions = spark.createDataFrame([(t, {k: str(v) for k, v in x.items()}) for t, x in stored.items()], "tool string, info map<string,string>")
    return families, lengths, versions


def _labelled(spark, path: str) -> DataFrame:
    """Lines ``id``, tab, ``value``."""
    return spark.read.csv(path, sep="\t", schema="id string, value string", quote="")


@command("--fasta", "--hits", "--name")
def annotate(spark, a) -> None:
    """From predictors' outputs (tool=path,...) to an annotation document."""
    parts = []
    for hit in a.hits.split(","):
        tool, _, path = hit.partition("=")
        if tool in ("pfam", "smart"):
            reports_ = spark.read.option("lineSep", "//\n").text(path)
            parts.append(predictors.profile_hits(reports_, tool, a.feature_evalue, a.instance_evalue))
        elif tool == "coils":
            parts.append(predictors.runs(text.read_fasta(spark, path), "x", "coils_coiled_coil"))
        elif tool == "flps":
            parts.append(predictors.biased_regions(spark.read.text(path), a.flps_threshold))
        elif tool == "signalp":
            parts.append(predictors.signal_peptides(spark.read.text(path)))
        elif tool in ("tmhmm", "seg"):
            parts.append((predictors.transmembrane if tool == "tmhmm" else predictors.low_complexity)(_labelled(spark, path)))
        else:
            raise ValueError(f"unknown predictor: {tool}")
    families, lengths, versions = _known(spark, a)
    _write_document(D.build(parts, text.unique_ids(text.read_fasta(spark, a.fasta)), families, lengths, versions), a)


@command("--annotations", "--new", "--tool", "--name")
def redo(spark, a) -> None:
    """One tool's annotation of every protein replaced by that of a new document; dimensions and counts follow."""
    (old,), (new,) = _documents(spark, a.annotations), _documents(spark, a.new)
    _write_document(D.redo(old, new, a.tool), a)


@command("--annotations", "--fasta", "--name")
def extract_sequences(spark, a) -> None:
    """The annotation of the sequences of a FASTA file; one without annotation is an error."""
    (doc,) = _documents(spark, a.annotations)
    ids = text.read_fasta(spark, a.fasta).select(F.col("id").alias("protein_id"))
    _write_document(D.extract(doc, M.check_ids(ids, doc.proteins)), a)


@command("--annotations", "--ids", "--name")
def extract(spark, a) -> None:
    (doc,), ids = _documents(spark, a.annotations), text.id_list(spark.read.text(a.ids))
    _write_document(D.extract(doc, ids), a)
    M.missing_ids(ids, doc.proteins).write.csv(f"{a.out}/missing")


@command("--annotations", "--name")
def merge(spark, a) -> None:
    _write_document(D.merge(_documents(spark, a.annotations)), a)


@command("--annotations", "--new", "--name")
def update(spark, a) -> None:
    (old,), (new,) = _documents(spark, a.annotations), _documents(spark, a.new)
    _write_document(D.update(old, new), a)


@command("--annotations", "--name")
def add_information(spark, a) -> None:
    (doc,) = _documents(spark, a.annotations)
    _write_document(D.add_information(doc, *_known(spark, a)), a)


@command("--annotations", "--features")
def find(spark, a) -> None:
    M.proteins_with(_load(spark, a, a.annotations).instances, a.features.split(","), a.every).write.csv(f"{a.out}/proteins")


@command("--annotations")
def complexity(spark, a) -> None:
    linearise.complexity(api.prepare(_load(spark, a, a.annotations), _options(a))).write.csv(f"{a.out}/complexity", header=True)


@command("--annotations", "--ids", "--group")
def domains(spark, a) -> None:
    rows = _load(spark, a, a.annotations)
    reports.unscored_domains(rows.instances, text.id_list(spark.read.text(a.ids)), rows.accessions, rows.profile_lengths, a.group).write.csv(f"{a.out}/domains", sep="\t", header=True)


@command("--domains")
def split_domains(spark, a) -> None:
    reports.write_split_domains(text.read_domains(spark, a.domains), a.out)


@command("--scores")
def merge_scores(spark, a) -> None:
    files = [text.read_scores(spark, p).withColumn("file_pos", F.lit(k)) for k, p in enumerate(a.scores.split(","))]
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    M.merge_scores(out).drop("file_pos").write.parquet(a.out)


@command("--scores", "--new")
def update_scores(spark, a) -> None:
    M.update_scores(text.read_scores(spark, a.scores), text.read_scores(spark, a.new)).write.parquet(a.out)


@command("--scores")
def scores_to_json(spark, a) -> None:
    reports.score_json(text.read_score_table(spark, a.scores)).write.text(a.out)


@command("--annotations")
def versions(spark, a) -> None:
    annotation.versions(annotation.read_documents(spark, a.annotations.split(","))).select("proteome", "tool", F.explode("info").alias("key", "value")).write.csv(f"{a.out}/versions", header=True)


@command("--annotations", "--pair-of-tools")
def overlaps(spark, a) -> None:
    one, two = a.pair_of_tools.split(",")
    overlap.overlap_statistics(_load(spark, a, a.annotations).instances, one, two, a.threshold).write.json(f"{a.out}/overlaps")


@command("--annotations", "--fasta", "--name")
def check(spark, a) -> None:
    """Sequences without annotation, maps that lack and versions that differ; with --new, a document with its proteins
    filled in."""
    (doc,), fasta = _documents(spark, a.annotations), text.read_fasta(spark, a.fasta)
    M.missing_ids(fasta.select(F.col("id").alias("protein_id")), doc.proteins).write.csv(f"{a.out}/missing")
    spark.createDataFrame([(x,) for x in D.lacking(doc)], "map string").write.csv(f"{a.out}/lacking")
    if a.versions:
        installed = _known(spark, a)[2].select("tool", F.explode("info").alias("key", "value"))
        D.check_versions(doc, installed).write.csv(f"{a.out}/outdated", header=True)
    if a.new:
        _write_document(D.fill(doc, _documents(spark, a.new)[0]), a)


@command("--table", "--fasta", "--name")
def parse_interpro(spark, a) -> None:
    cols = json.loads(a.columns)
    raw = spark.read.csv(a.table, sep="\t")
    rows = raw.select(*[F.col(f"_c{k}").cast("int" if n in ("length", "start", "stop") else "string").alias(n) for n, k in cols.items()])
    families, lengths, versions = _known(spark, a)
    parsed = text.interpro_table(rows, families.withColumn("accession_base", F.substring_index("accession", ".", 1)), lengths, [t for t, _, _ in text.parse_tool_list(_read(a.tools))])
    doc = D.build([parsed.drop("clan")], text.read_fasta(spark, a.fasta), families, lengths, versions)
    accessions = parsed.where("interpro is not null").groupBy("feature").agg(F.max("interpro").alias("interpro"))
    _write_document(replace(doc, accessions=accessions), a)


@command("--residues", "--name")
def disorder(spark, a) -> None:
    """Residue tables (id, pos, mark, separated by tabs) as a document of disordered regions; sequences without a
    result are listed."""
    residues = spark.read.csv(a.residues, sep="\t", schema="id string, pos int, mark string")
    doc, failed = D.disorder(residues)
    _write_document(doc, a)
    failed.write.csv(f"{a.out}/failed")


@command("--annotations", "--pairs")
def stream(spark, a) -> None:
    o = _options(a)
    incremental.score_new_pairs(spark, a.pairs, f"{a.out}/scores", f"{a.out}/checkpoint", api.prepare(_load(spark, a, a.annotations), o), o)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quiltspan", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    d = ScoringOptions()
    for name, (f, arguments) in COMMANDS.items():
        p = sub.add_parser(name, help=f.__doc__)
        for x in arguments:
            p.add_argument(x, required=x != "--pairs" or name in ("taxa", "stream"))
        p.add_argument("--out", required=True)
        for x in ("--tools", "--extra", "--reference", "--old", "--mapping", "--constraints", "--weight-file", "--families", "--lengths", "--versions", "--new", "--names"):
            if x not in arguments:
                p.add_argument(x)
        for x, v in (("feature-evalue", d.feature_evalue), ("instance-evalue", d.instance_evalue), ("max-overlap-share", d.max_overlap_share), ("threshold", 0.5), ("flps-threshold", 1e-7)):
            p.add_argument(f"--{x}", type=float, default=v)
        for x, v in (("max-overlap", d.max_overlap), ("max-features", d.max_features), ("max-paths", d.max_paths), ("paths-limit", d.paths_limit), ("digits", 4)):
            p.add_argument(f"--{x}", type=int, default=v)
        p.add_argument("--weights", default="0.7,0.0,0.3", help="of multiplicity, clan and position")
        p.add_argument("--count-correction", default=d.count_correction)
        p.add_argument("--columns", default='{"protein_id": 0, "length": 2, "tool": 3, "accession": 4, "start": 6, "stop": 7, "evalue": 8, "interpro": 11}')
        for x in ("one-way", "no-domains", "no-linearization", "empty-as-1", "every"):
            p.add_argument(f"--{x}", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quiltspan").getOrCreate()
    COMMANDS[a.command][0](spark, a)


if __name__ == "__main__":
    main()
