"""Overlap resolution: which intervals may follow each other, the reduced graph, and its paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import ScoringOptions

START, END = -1, 1_000_000


def precedence(rank: DataFrame, options: ScoringOptions) -> DataFrame:
    """(protein_id, u, v): in order of ends, u may stand before v. A self-join with the protein as equi-key."""
    a = rank.select("protein_id", F.col("rank").alias("u"), F.col("start").alias("u_start"), F.col("stop").alias("u_stop"))
    b = rank.select("protein_id", F.col("rank").alias("v"), F.col("start").alias("v_start"), F.col("stop").alias("v_stop"))
    over, share = F.col("u_stop") - F.col("v_start") + 1, F.lit(options.max_overlap_share)
    fits = (over <= options.max_overlap) & (over <= share * (F.col("u_stop") - F.col("u_start"))) & (over <= share * (F.col("v_stop") - F.col("v_start")))
    return a.join(b, "protein_id").where((F.col("u") < F.col("v")) & fits).select("protein_id", "u", "v")


def reduced(proteins: DataFrame) -> DataFrame:
    """(protein_id, u, v): the transitive reduction of the precedence, with START and END, from each protein's
    predecessors (``with_predecessors``), of which each rank has its own: no row meets another one. A protein without
    linearized instances has the one edge START -> END."""
    edge = lambda u, v: F.struct(u.cast("int").alias("u"), v.cast("int").alias("v"))
    inward = F.flatten(F.transform("before", lambda us, v: F.when(F.size(us) == 0, F.array(edge(F.lit(START), v))).otherwise(F.transform(us, lambda u: edge(u, v)))))
    inner = F.array_distinct(F.flatten("before"))
    ranks = F.when(F.size("before") > 0, F.sequence(F.lit(0), F.size("before") - 1)).otherwise(F.array().cast("array<int>"))
    last = F.transform(F.array_except(ranks, inner), lambda u: edge(u, F.lit(END)))
    bare = F.array(edge(F.lit(START), F.lit(END)))
    edges = F.when(F.size("before") == 0, bare).otherwise(F.concat(inward, last))
    return proteins.select("protein_id", F.explode(edges).alias("e")).select("protein_id", "e.u", "e.v")


#: Path counts stop here: they double with each pair of intervals that overlap, and nothing enumerates so many.
MOST_PATHS = 10**18


def _predecessors_exact() -> Column:
    """For each rank the ranks before it in the reduced graph, per protein on Arrow batches.

    In order of ends, those that may stand before v are the first ranks, up to the last that ends before v starts. Of
    these the ones that no other stands between are those that end no earlier than any of them starts: a run of ranks
    that reaches to the last one, found by two binary searches. (Spark's functions on arrays evaluate a bound value
    anew for each element that a nested one visits: cubic in the instances.)
    """

    @F.arrow_udf("array<array<int>>")
    def run(lin: pa.Array) -> pa.Array:
        spans, sizes = lin.flatten(), lin.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts, stops = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop"))
        # each protein at a place of its own on one line, where its ends stand in order among those of all
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        least, most = min(starts.min(initial=0), stops.min(initial=0)), max(starts.max(initial=0), stops.max(initial=0))
        line = np.repeat(np.arange(len(sizes)), sizes) * (most - least + 1) - least
        ends = stops + line
        latest = np.maximum.accumulate(starts + line)
        last = np.searchsorted(ends, starts + line)
        some = last > first
        least_of = np.where(some, np.minimum(np.searchsorted(ends, latest[np.maximum(last - 1, 0)]), last), last)
        count = last - least_of
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ranks = np.repeat(least_of - first, count) + place
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ranks, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), inner)

    return run(F.col("lin"))


def _predecessors_general(options: ScoringOptions) -> Column:
    """With an allowed overlap precedence is not transitive; the closure is taken per protein on Arrow batches.

    Ranks are taken from the last to the first. What a rank reaches is one integer, a bit for each rank, made of those
    of its successors: an edge is kept unless its end is reached through an earlier kept one, and with each kept edge
    all that it reaches goes from the candidates at once.
    """
    limit, share = options.max_overlap, options.max_overlap_share

    @F.arrow_udf("array<array<int>>")
    def run(lin: pa.Array) -> pa.Array:
        spans, sizes = lin.flatten(), lin.value_lengths().to_pylist()
        starts, stops = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop"))
        out, at = [], 0
        for n in sizes:
            out.append(_reduced_with_overlap(starts[at : at + n], stops[at : at + n], limit, share))
            at += n
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    return run(F.col("lin"))


def _reduced_with_overlap(starts: np.ndarray, stops: np.ndarray, limit: int, share: float) -> list[list[int]]:
    """For each rank those before it in the reduced graph, in order."""
    n = len(starts)
    reach = [0] * n
    before: list[list[int]] = [[] for _ in range(n)]
    for u in reversed(range(n)):
        over = stops[u] - starts[u + 1 :] + 1
        fits = (over <= limit) & (over <= share * (stops[u] - starts[u])) & (over <= share * (stops[u + 1 :] - starts[u + 1 :]))
        left = int.from_bytes(np.packbits(fits, bitorder="little").tobytes(), "little") << (u + 1)
        got = 0
        while left:
            first = left & -left
            v = first.bit_length() - 1
            before[v].append(u)
            got |= first | reach[v]
            left &= ~got
        reach[u] = got
    return [us[::-1] for us in before]


def with_predecessors(proteins: DataFrame, options: ScoringOptions) -> DataFrame:
    exact = options.max_overlap == 0
    return proteins.withColumn("before", (_predecessors_exact() if exact else _predecessors_general(options)).cast("array<array<int>>"))


def with_path_counts(proteins: DataFrame) -> DataFrame:
    """n_paths: START -> END paths, by one fold over the ranks, without enumerating them; MOST_PATHS stands for more."""
    zero, one, most = (F.lit(x).cast("bigint") for x in (0, 1, MOST_PATHS))

    def total(counts: Column) -> Column:
        return F.aggregate(counts, zero, lambda s, n: F.least(s + n, most))

    def ending(acc: Column, b: Column) -> Column:
        n = F.when(F.size(b) == 0, one).otherwise(total(F.transform(b, lambda u: F.element_at(acc, u + 1))))
        return F.concat(acc, F.array(n))

    out = proteins.withColumn("ending", F.aggregate("before", F.array().cast("array<bigint>"), ending))
    out = out.withColumn("inner", F.array_distinct(F.flatten("before")))
    last = F.transform("ending", lambda n, k: F.when(F.array_contains("inner", k), zero).otherwise(n))
    return out.withColumn("n_paths", F.greatest(total(last), one)).drop("ending", "inner")


def with_paths(proteins: DataFrame) -> DataFrame:
    """paths: the ranks of every START -> END path, in order of the ranks; [[]] without linearized instances.

    Ranks are topologically ordered, so that one fold sees every edge into a node before any edge out of it. Rows with
    too many paths are to be filtered by n_paths first.
    """
    paths_type = "array<array<array<int>>>"
    step = F.aggregate(
        F.transform("before", lambda b, v: F.struct(b.alias("b"), v.alias("v"))),
        F.array().cast(paths_type),
        lambda acc, x: F.concat(acc, F.array(F.when(F.size(x["b"]) == 0, F.array(F.array(x["v"]))).otherwise(F.flatten(F.transform(x["b"], lambda u: F.transform(F.element_at(acc, u + 1), lambda p: F.array_append(p, x["v"]))))))),
    )
    out = proteins.withColumn("ending", step).withColumn("inner", F.array_distinct(F.flatten("before")))
    whole = F.array_sort(F.flatten(F.transform("ending", lambda p, k: F.when(F.array_contains("inner", k), F.array().cast("array<array<int>>")).otherwise(p))))
    return out.withColumn("paths", F.when(F.size("before") == 0, F.array(F.array().cast("array<int>"))).otherwise(whole)).drop("ending", "inner")


def routed(proteins: DataFrame, options: ScoringOptions, seed: bool) -> DataFrame:
    """``greedy``: too many features or paths to enumerate. A seed is routed from the limit on, a query beyond it."""
    n = F.col("n_lin") if "n_lin" in proteins.columns else F.size("lin")
    many = n >= options.max_features if seed else n > options.max_features
    return proteins.withColumn("greedy", many | (F.col("n_paths") > options.max_paths))


def complexity(proteins: DataFrame) -> DataFrame:
    """protein_id, n_paths and the steps of a greedy walk: out-degrees above one along first successors from START."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = []
            for before in b.column("before").to_pylist():
                after: dict[int, list[int]] = {-1: [v for v, p in enumerate(before) if not p]}
                for v, p in enumerate(before):
                    for u in p:
                        after.setdefault(u, []).append(v)
                at, total = -1, 0
                while after.get(at):
                    total += len(after[at]) if len(after[at]) > 1 else 0
                    at = after[at][0]
                steps.append(total)
            yield pa.RecordBatch.from_arrays([b.column("protein_id"), b.column("n_paths"), pa.array(steps, pa.int64())], names=["protein_id", "n_paths", "greedy_steps"])

    kind = proteins.schema["protein_id"].dataType.simpleString()
    return proteins.select("protein_id", "n_paths", "before").mapInArrow(run, f"protein_id {kind}, n_paths bigint, greedy_steps bigint")
