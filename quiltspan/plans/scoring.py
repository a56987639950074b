"""Scores of pairs of architectures: multiplicity, clan, position and length; similarity and distance variants."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import ScoringOptions
from ..storage import cut_by
from . import greedy, path_pairs
from .linearise import routed, with_path_counts, with_paths, with_predecessors
from .path_pairs import TIES
from .path_scorer import tool_prefix

def prepare(proteins: DataFrame, options: ScoringOptions) -> DataFrame:
    """Predecessors and path counts of every protein, written once for all its pairs and both directions, by protein:
    pairs that are dealt out by protein meet it where it lies."""
    return cut_by(with_path_counts(with_predecessors(proteins, options)).withColumn("n_lin", F.size("lin")), "protein_id", "proteins")


def _carried(proteins: DataFrame) -> DataFrame:
    """What scoring reads of a protein: its instances, those on paths first, as arrays by field."""
    both = lambda c: F.concat(f"lin.{c}", f"normal.{c}").alias(c)
    instances = F.struct(both("feature"), both("position"), both("start"), both("stop"), F.col("lin.clan").alias("clan"))
    return proteins.select("protein_id", instances.alias("instances"), "before", "mark")


#: Stands between names that travel as one string; no name holds it.
_NUL = "\0"


def _packed(carried: DataFrame) -> DataFrame:
    """``_carried`` with paths, as it travels to meet the other protein of a pair: names and paths as a string each (an
    array of strings or arrays takes several times their bytes), and lengths, which is all that is read of the spans."""
    clans = F.transform("instances.clan", lambda c: F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c)))
    span = F.zip_with("instances.start", "instances.stop", lambda a, b: b - a + 1)
    paths = F.array_join(F.transform("paths", lambda p: F.array_join(p.cast("array<string>"), ",")), ";")
    return carried.select("protein_id", F.array_join(F.concat("instances.feature", clans), _NUL).alias("names"), F.col("instances.position").alias("position"), span.alias("span"), paths.alias("paths"), "mark")


def _unpacked(names: str, position: str, span: str, paths: str) -> tuple[Column, Column]:
    """The instances, from 1 to their length, and the paths."""
    n, every = F.size(position), F.split(names, _NUL)
    clans = F.slice(every, n + 1, F.when(n > 0, F.size(every) - n).otherwise(0))
    clans = F.transform(clans, lambda c: F.when(c != "", F.substring(c, F.lit(2), F.length(c))))
    start = F.transform(span, lambda x: F.lit(1).cast("int"))
    instances = F.struct(F.slice(every, 1, n).alias("feature"), F.col(position).alias("position"), start.alias("start"), F.col(span).alias("stop"), clans.alias("clan"))
    return instances, F.transform(F.split(paths, ";"), lambda p: F.when(p == "", F.array().cast("array<int>")).otherwise(F.split(p, ",").cast("array<int>")))


_BEST = "struct<final:double,ms:double,ps:double,cs:double,ls:double,seed_path:array<int>,query_path:array<int>>"


def _best_of(s_paths: Column, q_paths: Column, weights: Column | None, options: ScoringOptions, distance: bool) -> Column:
    """The highest final score over all pairs of a row's paths; ties go to the first query path, then the first seed path."""

    @F.arrow_udf(_BEST)
    def run(s: pa.Array, some_s: pa.Array, q: pa.Array, some_q: pa.Array, *w_map: pa.Array) -> pa.Array:
        return path_pairs.best_pairs(s, some_s, q, some_q, *(w_map or [None]), options, distance, tool_prefix)

    return run(F.col("s"), s_paths, F.col("q"), q_paths, *([] if weights is None else [F.map_entries(weights)]))


#: Pairs of paths that a row compares; proteins with more are compared by rows of their own, block by block.
PATHS_TOGETHER = 4_096


def _best_by_blocks(rows: DataFrame, s_paths: Column, q_paths: Column, best_of, together: int) -> DataFrame:
    """seed, query and the best pair of paths ``b``, in two steps: blocks of seed and query paths, of which no row
    compares more than ``together`` pairs, give their best; of these the highest is chosen, ties by the first query
    path, then the first seed path, as within a row."""
    s_step = F.greatest(F.least(F.size(s_paths), F.lit(together)), F.lit(1))
    q_step = F.greatest(F.floor(F.lit(together) / s_step), F.lit(1)).cast("int")
    starts = lambda paths, step: F.sequence(F.lit(1), F.greatest(F.size(paths), F.lit(1)), step)
    cut_ = rows.withColumns({"s_paths": s_paths, "q_paths": q_paths, "pair": F.monotonically_increasing_id()})
    cut_ = cut_.withColumns({"s_step": s_step, "q_step": q_step})
    cut_ = cut_.withColumn("s_at", F.explode(starts("s_paths", F.col("s_step")))).withColumn("q_at", F.explode(starts("q_paths", F.col("q_step"))))
    cut_ = cut_.withColumns({"s_paths": F.slice("s_paths", F.col("s_at"), F.col("s_step")), "q_paths": F.slice("q_paths", F.col("q_at"), F.col("q_step"))})
    # the blocks of one pair go to tasks of their own
    cut_ = cut_.repartition("seed", "query", "s_at", "q_at")
    part = cut_.select("seed", "query", "pair", best_of(F.col("s_paths"), F.col("q_paths")).alias("b"))
    order = F.struct((-F.round("b.final", TIES)).alias("less"), F.col("b.query_path").alias("query_path"), F.col("b.seed_path").alias("seed_path"))
    return part.groupBy("seed", "query", "pair").agg(F.min_by("b", order).alias("b")).select("seed", "query", "b")


def score_pairs(pairs: DataFrame, seeds: DataFrame, queries: DataFrame, options: ScoringOptions, weights: DataFrame | None = None, distance: bool = False, together: int = PATHS_TOGETHER) -> DataFrame:
    """Score ``pairs`` (seed, query) of prepared proteins.

    Returns seed, query, final, ms, ps, cs, ls, seed_path, query_path, mode. Paths are enumerated once per protein and
    not per pair; a pair then meets its two proteins in equi-joins, by which their instances travel once and paths as
    ranks, and its paths meet within its own row, without another shuffle (``path_pairs``, for a batch of rows at once). Only where proteins have so many paths that a
    row would compare more than ``together`` pairs of them, these are dealt out in blocks and the blocks' best are
    compared. Proteins with too many features or paths take the greedy route first of all; of the others, a query
    without linearized instances is compared along the seed's last path alone, equal annotations are compared whole,
    and the rest along all pairs of paths. Pairs beyond ``paths_limit`` come out with null scores.

    ``weights``: (protein_id, feature, weight) of the seeds, or for the distance variant (feature, weight) for all.
    """
    over = F.col("n_paths") > options.paths_limit if options.paths_limit > 1 else F.lit(False)
    marked = [routed(side, options, name == "seed").withColumn("over", over) for side, name in ((seeds, "seed"), (queries, "query"))]
    # only of proteins that are in pairs paths are enumerated, and only what scoring reads is sent to meet these
    wanted = lambda some, name: some.join(pairs.select(F.col(name).alias("protein_id")).distinct(), "protein_id", "left_semi")
    rows = pairs.select("seed", "query")
    plain = [with_paths(wanted(_carried(m.where("not greedy and not over")), name)) for m, name in zip(marked, ("seed", "query"), strict=True)]
    # a pair goes from its seed to its query, with what the seed carries
    packed = _packed(plain[0])
    rows = rows.join(packed.select(F.col("protein_id").alias("seed"), *[F.col(c).alias(f"s_{c}") for c in packed.columns[1:]]), "seed")
    rows = rows.join(plain[1].select(F.col("protein_id").alias("query"), F.col("instances").alias("q"), F.col("paths").alias("q_paths"), F.col("mark").alias("q_mark")), "query")
    rows = rows.withColumns(dict(zip(("s", "s_paths"), _unpacked("s_names", "s_position", "s_span", "s_paths"), strict=True)))
    rows = rows.drop("s_names", "s_position", "s_span")
    weight_map = None
    if weights is not None and distance:
        # one map for all seeds: as many entries as the weight file has
        rows = rows.crossJoin(F.broadcast(weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("w_map"))))
        weight_map = F.col("w_map")
    elif weights is not None:
        rows = rows.join(weights.groupBy(F.col("protein_id").alias("seed")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("w_map")), "seed", "left")
        weight_map = F.coalesce("w_map", F.create_map().cast("map<string,double>"))
    bare = F.size("q.clan") == 0
    same = ~bare & (F.col("s_mark") == F.col("q_mark"))
    every = {k: F.array(F.transform(f"{k}.clan", lambda x, n: n)) for k in "sq"}
    s_paths = F.when(bare, F.slice("s_paths", -1, 1)).when(same, every["s"]).otherwise(F.col("s_paths"))
    q_paths = F.when(same, every["q"]).otherwise(F.col("q_paths"))

    def best_of(s_some: Column, q_some: Column) -> Column:
        return _best_of(s_some, q_some, weight_map, options, distance)

    # one row tells whether any prepared protein takes another route or has many paths; most inputs have none of these
    exact = F.when(~F.col("greedy") & ~F.col("over"), F.col("n_paths"))
    tell = [m.agg(F.max("greedy").alias(f"{k}_greedy"), F.max("over").alias(f"{k}_over"), F.coalesce(F.max(exact), F.lit(1)).alias(f"{k}_most")) for m, k in zip(marked, "sq", strict=True)]
    told = tell[0].crossJoin(tell[1]).first()  # one row each
    marks = {k: told[f"s_{k}"] or told[f"q_{k}"] for k in ("greedy", "over")}
    if told["s_most"] * told["q_most"] > together:
        best = _best_by_blocks(rows, s_paths, q_paths, best_of, together)
    else:
        best = rows.select("seed", "query", best_of(s_paths, q_paths).alias("b"))
    cols = ["final", "ms", "ps", "cs", "ls", "seed_path", "query_path"]
    out = best.select("seed", "query", *[f"b.{c}" for c in cols], F.lit("exhaustive/exhaustive").alias("mode"))

    if not (marks["greedy"] or marks["over"]):
        return out
    sides = [wanted(m, name) for m, name in zip(marked, ("seed", "query"), strict=True)]
    flags = [x.select(F.col("protein_id").alias(n), F.col("greedy").alias(f"{n}_greedy"), F.col("over").alias(f"{n}_over")) for x, n in zip(sides, ("seed", "query"), strict=True)]
    flagged = pairs.select("seed", "query").join(flags[0], "seed").join(flags[1], "query")
    if marks["greedy"]:
        hard = flagged.where("(seed_greedy or query_greedy) and not (seed_over or query_over)")
        out = out.union(greedy.score(hard, sides[0], sides[1], options, weights, distance).select("seed", "query", *cols, "mode"))
    if marks["over"]:
        none = [F.lit(None).cast(t) for t in ["double"] * 5 + ["array<int>"] * 2 + ["string"]]
        out = out.union(flagged.where("seed_over or query_over").select("seed", "query", *none))
    return out


def nearest_instances(pairs: DataFrame, arch: DataFrame) -> DataFrame:
    """seed, query, feature, i, n_q, match, ratio: for each instance of the seed how many the query has of its feature,
    and the closeness and length ratio of the nearest one (the first of equally near ones), null without any."""
    a = arch.select("protein_id", "feature", "i", "position", (F.col("stop") - F.col("start") + 1).alias("len"))
    s = a.select(F.col("protein_id").alias("seed"), "feature", "i", F.col("position").alias("s_pos"), F.col("len").alias("s_len"))
    q = a.select(F.col("protein_id").alias("query"), "feature", F.col("i").alias("q_i"), F.col("position").alias("q_pos"), F.col("len").alias("q_len"))
    met = pairs.select("seed", "query").join(s, "seed").join(q, ["query", "feature"], "left")
    match = F.lit(1.0) - F.abs(F.col("s_pos") - F.col("q_pos"))
    ratio = F.least("s_len", "q_len") / F.greatest("s_len", "q_len")
    nearest = F.max(F.when(F.col("q_i").isNotNull(), F.struct(match.alias("match"), (-F.col("q_i")).alias("order"), ratio.alias("ratio"))))
    rows = met.groupBy("seed", "query", "feature", "i").agg(nearest.alias("b"), F.count("q_i").alias("n_q"))
    return rows.select("seed", "query", "feature", "i", "n_q", "b.match", "b.ratio")


def unlinearized_scores(pairs: DataFrame, arch: DataFrame) -> DataFrame:
    """seed, query, ms, ps, ls with uniform weights when no overlap is resolved, of the pairs whose seed has instances.

    A protein's instances are one row, which a pair meets in two equi-joins; the nearest instances, their averages by
    feature and over the seed's features are found within the pair's row, so that no instance is a row that is sorted.
    """
    fields = ["feature", "position", "start", "stop"]
    every = F.sort_array(F.collect_list(F.struct("i", *fields)))
    p = arch.groupBy("protein_id").agg(every.alias("every")).select("protein_id", F.struct(*[F.col(f"every.{c}").alias(c) for c in fields]).alias("instances"))

    @F.arrow_udf("struct<ms:double,ps:double,ls:double>")
    def run(s: pa.Array, q: pa.Array) -> pa.Array:
        return path_pairs.whole_scores(s, q)

    rows = pairs.select("seed", "query").join(p.select(F.col("protein_id").alias("seed"), F.col("instances").alias("s")), "seed")
    rows = rows.join(p.select(F.col("protein_id").alias("query"), F.col("instances").alias("q")), "query", "left")
    none = F.struct(*[F.array().cast(p.schema["instances"].dataType[c].dataType).alias(c) for c in fields])
    return rows.select("seed", "query", run(F.col("s"), F.coalesce("q", none)).alias("u")).select("seed", "query", "u.ms", "u.ps", "u.ls")


def common_feature(pairs: DataFrame, arch: DataFrame) -> DataFrame:
    """seed, query, common: whether the two share a feature of tools whose overlaps are resolved."""
    t = arch.where("linearized").groupBy("protein_id").agg(F.collect_set("feature").alias("features"))
    s, q = t.select(F.col("protein_id").alias("seed"), F.col("features").alias("a")), t.select(F.col("protein_id").alias("query"), F.col("features").alias("b"))
    return pairs.select("seed", "query").join(s, "seed").join(q, "query").select("seed", "query", F.arrays_overlap("a", "b").alias("common"))


def bidirectional(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Forward scores beside those of the swapped pairs."""
    back = reverse.select(F.col("query").alias("seed"), F.col("seed").alias("query"), F.col("final").alias("rev_final"))
    return forward.join(back, ["seed", "query"], "left").select("seed", "query", F.col("final").alias("fwd_final"), "rev_final")
