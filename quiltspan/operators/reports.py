"""Reports and sinks: domain tables, profiles, score files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import four_significant, let, unversioned
from ..storage import cut

DOMAIN_COLUMNS = ["pair_id", "ortholog", "seq_length", "feature", "start", "stop", "weight", "path", "interpro", "evalue", "bit_score", "hmm_from", "hmm_to", "phmm_length"]


def _details(instances: DataFrame, accessions: DataFrame, phmm: DataFrame) -> DataFrame:
    for c, t in (("bit_score", "double"), ("hmm_from", "int"), ("hmm_to", "int")):
        if c not in instances.columns:
            instances = instances.withColumn(c, F.lit(None).cast(t))
    rows = instances.join(accessions.select("feature", "interpro"), "feature", "left").join(phmm.select("feature", F.col("plen").alias("phmm_length")), "feature", "left")
    return rows.withColumn("interpro", unversioned(F.col("interpro")))


def _carried(proteins: DataFrame, instances: DataFrame, accessions: DataFrame, phmm: DataFrame, name: str) -> DataFrame:
    """A row per protein, under the id ``name``: ``all`` (its instances as the report shows them), lin and normal."""
    fields = ["i", F.col("length").alias("seq_length"), *[c for c in DOMAIN_COLUMNS[3:] if c not in ("weight", "path")]]
    rows = _details(instances, accessions, phmm).groupBy("protein_id").agg(F.collect_list(F.struct(*fields)).alias("all"))
    both = proteins.select("protein_id", "lin", "normal").join(rows, "protein_id")
    return both.select(F.col("protein_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("all", "lin", "normal")])


def _on_path(side: str) -> Column:
    """The instances on the best path, those of tools without linearization included."""
    path = F.coalesce(f"{side}_path", F.array().cast("array<int>"))
    return F.concat(F.transform(path, lambda k: F.element_at(f"{side}_lin", k + 1)), F.col(f"{side}_normal"))


def path_weights(features: Column, w_map: Column | None, distance: bool = False, default: float = 0.5, digits: int | None = 4) -> Column:
    """map feature -> weight of the features on a seed's path: those of ``w_map`` scaled to sum to 1, or uniform; for the
    distance variant those of ``w_map`` or ``default``, scaled to sum to 1 where they sum to more."""

    def of(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.coalesce(w, F.lit(0.0)))

        def scaled(t: Column) -> Column:
            scale = F.lit(1.0) / t
            scale = F.when(t > 1, scale).otherwise(F.lit(1.0)) if distance else scale
            share = lambda w: w * scale if digits is None else F.round(w * scale, digits)
            return F.map_from_arrays(features, F.transform(weights, share))

        return let(total, scaled)

    if w_map is None:
        raw = F.transform(features, lambda f: F.lit(default if distance else 1.0))
    elif distance:
        raw = F.transform(features, lambda f: F.coalesce(w_map[f], F.lit(float(default))))
    else:
        raw = F.transform(features, lambda f: w_map[f])
    return let(raw, of)


def domain_report(
    scores: DataFrame,
    seeds: tuple[DataFrame, DataFrame],
    queries: tuple[DataFrame, DataFrame],
    accessions: DataFrame,
    phmm: DataFrame,
    weights: DataFrame | None = None,
    distance: bool = False,
    default: float = 0.5,
    reverse: bool = False,
) -> DataFrame:
    """A row per instance of each pair's seed, and of its query where that is another protein.

    ``scores``: seed, query, seed_path, query_path. ``seeds`` and ``queries``: (proteins with lin and normal, instances)
    of each side. A pair meets its two proteins in two equi-joins, with the weights of the features on the seed's path
    made on the way, and its own row then gives all of its report. ``weights``: (protein_id, feature, weight) of the
    seeds, for the distance variant (feature, weight) for all. An instance of a feature that is not on the seed's path
    has no weight. ``reverse`` swaps the pair's label.
    """
    label = F.concat_ws("#", "query", "seed") if reverse else F.concat_ws("#", "seed", "query")
    rows = scores.select("seed", "query", "seed_path", "query_path").join(_carried(*seeds, accessions, phmm, "seed"), "seed", "left")
    w_map = None
    if weights is not None and distance:
        # one map for all seeds: as many entries as the weight file has
        rows = rows.crossJoin(F.broadcast(weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("w_map"))))
        w_map = F.col("w_map")
    elif weights is not None:
        rows = rows.join(weights.groupBy(F.col("protein_id").alias("seed")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("w_map")), "seed", "left")
        w_map = F.coalesce("w_map", F.create_map().cast("map<string,double>"))
    on = F.coalesce(_on_path("seed"), F.array().cast(rows.schema["seed_normal"].dataType))
    share = let(F.array_distinct(F.transform(on, lambda e: e["feature"])), lambda f: path_weights(f, w_map, distance, default))
    rows = rows.select("seed", "query", "query_path", "seed_all", F.transform(on, lambda e: e["i"]).alias("seed_on"), share.alias("share"))
    rows = rows.join(_carried(*queries, accessions, phmm, "query"), "query", "left")

    def side(name: str, on: Column) -> Column:
        every = F.coalesce(f"{name}_all", F.array().cast(rows.schema["seed_all"].dataType))
        return let(on, lambda ids: F.transform(every, lambda x: F.struct(F.col(name).alias("ortholog"), x.alias("x"), F.when(F.array_contains(ids, x["i"]), "Y").otherwise("N").alias("path"))))

    own = side("seed", F.col("seed_on"))
    other = F.when(F.col("seed") != F.col("query"), side("query", F.transform(_on_path("query"), lambda e: e["i"])))
    both = F.concat(own, F.coalesce(other, F.filter(own, lambda x: F.lit(False))))
    out = rows.select(label.alias("pair_id"), "share", F.explode(both).alias("r")).select("pair_id", "r.ortholog", "r.path", "r.x.*", "share")
    return out.withColumn("weight", F.col("share")[F.col("feature")]).select(*DOMAIN_COLUMNS)


def unscored_domains(instances: DataFrame, ids: DataFrame, accessions: DataFrame, phmm: DataFrame, group: str) -> DataFrame:
    """Domain rows without a comparison: no weight, no path, accessions with their version."""
    rows = instances.join(ids.select("protein_id").distinct(), "protein_id", "left_semi").join(accessions.select("feature", "interpro"), "feature", "left").join(phmm.select("feature", "plen"), "feature", "left")
    return rows.select(F.concat(F.lit(f"{group}#"), F.col("protein_id").cast("string")).alias("pair_id"), F.col("protein_id").alias("ortholog"), F.col("length").alias("seq_length"), "feature", "start", "stop", F.coalesce("interpro", F.lit("NA")).alias("interpro"), F.col("plen").alias("phmm_length"))


def phylogenetic_profile(scores: DataFrame, mapping: DataFrame) -> DataFrame:
    """gene, taxon, ortholog and both scores (missing reverse: 0). An ortholog without taxon is an error."""
    rows = scores.join(mapping.select(F.col("protein_id").alias("query"), "ncbi_id"), "query", "left")
    ok = F.when(F.col("ncbi_id").isNull(), F.raise_error(F.concat(F.lit("no taxon for "), F.col("query").cast("string")))).otherwise(F.lit(True))
    return rows.where(ok.cast("boolean")).select(F.col("seed").alias("gene_id"), "ncbi_id", F.col("query").alias("ortho_id"), F.col("fwd_final").alias("forward_score"), F.coalesce("rev_final", F.lit(0.0)).alias("reverse_score"))


def group_domains(domains: DataFrame, groups: DataFrame) -> DataFrame:
    """Domain rows (seed, query, ...) for every group that has the pair, ids as group|taxon|protein."""
    rows = domains.join(groups.select("grp", "seed", "query", "query_taxon"), ["seed", "query"])
    return rows.withColumn("pair_id", F.concat(F.col("grp").cast("string"), F.lit("#"), F.concat_ws("|", F.col("grp").cast("string"), F.col("query_taxon").cast("string"), F.col("query").cast("string"))))


def group_profile(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each group that has a scored pair: the group, the taxon's number (of names like ``x@9606@1``), the
    member as ``group|taxon|protein|flag``, and both scores to three decimals (missing reverse: 0)."""
    rows = scores.join(groups.select("grp", "seed", "query", "query_taxon", *(["flag"] if "flag" in groups.columns else [])), ["seed", "query"])
    taxon = F.col("query_taxon").cast("string")
    flag = F.coalesce(F.col("flag").cast("string"), F.lit("1")) if "flag" in groups.columns else F.lit("1")
    return rows.select(
        F.col("grp").cast("string").alias("geneID"),
        F.concat(F.lit("ncbi"), F.coalesce(F.get(F.split(taxon, "@"), F.lit(1)), taxon)).alias("ncbiID"),
        F.concat_ws("|", F.col("grp").cast("string"), taxon, F.col("query").cast("string"), flag).alias("orthoID"),
        F.round("fwd_final", 3).alias("FAS_F"),
        F.round(F.coalesce("rev_final", F.lit(0.0)), 3).alias("FAS_B"),
    )


def score_table(scores: DataFrame) -> DataFrame:
    """The eight text columns of a score file: forward and reverse joined by a slash, four significant digits.

    ``scores``: seed, query, mode and fwd_/rev_ final, ms, ps, cs, ls; missing values read NA.
    """
    both = {k.upper() if k != "final" else "Score": F.concat_ws("/", *[F.coalesce(four_significant(f"{d}_{k}"), F.lit("NA")) for d in ("fwd", "rev")]) for k in ("final", "ms", "ps", "cs", "ls")}
    return scores.select(F.col("seed").cast("string").alias("Seed"), F.col("query").cast("string").alias("Query"), *[c.alias(n) for n, c in both.items()], F.col("mode").alias("Method"))


def write_score_table(scores: DataFrame, path: str) -> None:
    score_table(scores).write.option("sep", "\t").option("header", True).csv(path)


def score_json(scores: DataFrame) -> DataFrame:
    """One JSON object per row, ``{"seed_query": ["fwd", "rev"]}``: lines that a reader joins, however many there are."""
    values = F.array(F.coalesce(four_significant("fwd_final"), F.lit("NA")), F.coalesce(four_significant("rev_final"), F.lit("NA")))
    return scores.select(F.to_json(F.create_map(F.concat_ws("_", F.col("seed").cast("string"), F.col("query").cast("string")), values)).alias("value"))


def write_split_domains(domains: DataFrame, path: str, ids: DataFrame | None = None, seeds: int = 200, most: int = 1_000_000) -> None:
    """One folder per seed: the text before the first # of the pair's label. ``ids`` (seed_id) restricts the seeds.

    A folder and its file take a task far longer than their few rows, so that tasks get some ``seeds`` of them, not so
    many bytes. A seed's rows are in one file, but for a seed of more than ``most``, which several tasks write.
    """
    rows = domains.withColumn("seed_id", F.substring_index("pair_id", "#", 1))
    if ids is not None:
        rows = rows.join(ids.select("seed_id").distinct(), "seed_id", "left_semi")
    rows = cut(rows, "split-rows")
    counts = cut(rows.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n")), "split-seeds")
    n_seeds, n_rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(-(-n_seeds // seeds), -(-n_rows // most), 1)
    long = counts.where(F.col("n") > most).select(F.col("seed_id").alias("long_seed"), F.ceil(F.col("n") / most).cast("int").alias("long_parts"))
    part = F.lit(0)
    if not long.isEmpty():
        rows = rows.join(long, F.col("seed_id").eqNullSafe(F.col("long_seed")), "left")
        part = F.coalesce(F.pmod(F.xxhash64(*domains.columns), F.col("long_parts")).cast("int"), F.lit(0))
    dealt = rows.repartition(tasks, "seed_id", part).select(*domains.columns, "seed_id")
    dealt.write.partitionBy("seed_id").option("sep", "\t").option("header", True).csv(path)


def write_run_record(spark: SparkSession, path: str, options: dict, command: str, version: str) -> None:
    """``key: value`` lines about a run."""
    lines = [f"command: {command}", f"version: {version}", *(f"{k}: {v}" for k, v in sorted(options.items()))]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def version_report(versions: DataFrame) -> DataFrame:
    """tool, key, value rows of a proteome's version map."""
    return versions.select("proteome", "tool", F.explode("info").alias("key", "value"))


def score_lines(scores: DataFrame) -> DataFrame:
    """A tab-separated line ``#``, seed, query, final score for each pair."""
    return scores.select(F.concat_ws("\t", F.lit("#"), F.col("seed").cast("string"), F.col("query").cast("string"), F.col("final").cast("string")).alias("line"))


def parse_weight_file(text: str) -> tuple[dict[str, float], float]:
    """Weights of the distance variant and the default for features without one (0.5 where absent)."""
    data = json.loads(text)
    return {k: float(v) for k, v in data.get("weights", {}).items()}, float(data.get("default", 0.5))


