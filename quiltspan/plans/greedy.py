"""The greedy route for proteins with too many features or paths.

A sequential arg-max along the graph cannot be a relational plan; it runs per pair on Arrow batches. The pair's two
proteins come to it through equi-joins, so that Spark deals out the work. The seed's path goes by the final score
against a query path. The query's path goes by a score against the whole seed: in the similarity variant by that of
the path with uniform weights, in the distance variant by the distance score with the weight file's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import ScoringOptions
from .path_scorer import QueryPath, QueryPathByDistance, SeedPath, by_feature, clan_tally, tool_prefix

_OUT = "final double, ms double, ps double, cs double, ls double, seed_path array<int>, query_path array<int>, mode string"


def successors(before: list[list[int]]) -> dict[int, list[int]]:
    """Of each rank, and of START as -1, the ranks that follow it in the reduced graph."""
    after: dict[int, list[int]] = {k: [] for k in range(-1, len(before))}
    for v, us in enumerate(before):
        for u in us or [-1]:
            after[u].append(v)
    return after


def _nearest(e: dict, others: list[dict]) -> tuple[float, float]:
    n, best, ratio = e["stop"] - e["start"] + 1, 0.0, 0.0
    for o in others:
        match = 1.0 - abs(e["position"] - o["position"])
        if match > best:
            m = o["stop"] - o["start"] + 1
            best, ratio = match, min(m, n) / max(m, n)
    return best, ratio


def score_elements(seed_lin: list, seed_normal: list, query_lin: list, query_normal: list, weights: dict | None, o: ScoringOptions, distance: bool) -> tuple:
    """(final, ms, ps, cs, ls) of two chosen sets of instances, as the column expressions give it."""
    s, q = by_feature(seed_lin + seed_normal), by_feature(query_lin + query_normal)
    w = {f: 1.0 if weights is None and not distance else (weights or {}).get(f, o.distance_default if distance else 1.0) for f in s}
    if o.constraints and weights is not None and not distance:
        for tool, limit in o.constraints.items():
            own = [f for f, es in s.items() if es[0]["linearized"] and f not in o.constraints and tool_prefix(f) == tool]
            short = sum(w[f] * len(s[f]) for f in own)
            if 0 < short < limit:
                w |= {f: w[f] * limit / short for f in own}
    total = sum(w.values())
    scale = (1 / total if total > 1 else 1.0) if distance else (1 / total if total else 0.0)
    ms = ps = ls = 0.0
    for f, es in s.items():
        if f in q:
            near = [_nearest(e, q[f]) for e in es]
            part = (min(len(q[f]) / len(es), 1.0), sum(x for x, _ in near) / len(es), sum(x for _, x in near) / len(es))
        else:
            part = (0.0, 0.0, 0.0)
        if distance:
            part = tuple(x - 1.0 for x in part)
        ms, ps, ls = ms + part[0] * w[f] * scale, ps + part[1] * w[f] * scale, ls + part[2] * w[f] * scale
    if distance:
        ms, ps, ls = 1.0 + ms, 1.0 + ps, 1.0 + ls
    sc, qc = clan_tally(seed_lin), clan_tally(query_lin)
    both = [c for c in sc if c in qc]
    if not sc:
        cs = 0.0
    elif distance:
        cs = 1.0 - sum(1.0 - min(qc[c] / sc[c], 1.0) for c in both) / len(sc)
    else:
        cs = sum(sc[c] * qc[c] / max(sc[c], qc[c]) ** 2 for c in both) / len(sc)
    if o.digits is not None:
        ms, ps, cs, ls = (round(x, o.digits) for x in (ms, ps, cs, ls))
    if o.empty_as_1 and not distance and not s and not q:
        ms = ps = cs = ls = 1.0
    return ms * o.weight_multiplicity + cs * o.weight_clan + ps * o.weight_position, ms, ps, cs, ls


def partial_parts(lin: list, seed_all: list, query_clans: dict) -> tuple[float, float, float]:
    """(ms, ps, cs) of a query path, as far as it has come, against the whole seed with uniform weights, its clans
    against all of the query's own."""
    mine, theirs = by_feature(lin), by_feature(seed_all)
    if not mine:
        return 0.0, 0.0, 0.0
    ms = sum(min(len(theirs.get(f, ())) / len(es), 1.0) for f, es in mine.items()) / len(mine)
    ps = sum(sum(_nearest(e, theirs.get(f, []))[0] for e in es) / len(es) for f, es in mine.items()) / len(mine)
    clans = clan_tally(lin)
    cs = sum(n * query_clans[c] / max(n, query_clans[c]) ** 2 for c, n in clans.items() if c in query_clans) / len(clans) if clans else 0.0
    return ms, ps, cs


def partial_score(lin: list, seed_all: list, query_clans: dict, o: ScoringOptions) -> float:
    ms, ps, cs = partial_parts(lin, seed_all, query_clans)
    return ms * o.weight_multiplicity + cs * o.weight_clan + ps * o.weight_position


def partial_scores(pairs: DataFrame, seeds: DataFrame, queries: DataFrame, o: ScoringOptions) -> DataFrame:
    """seed, query, final, ms, ps, cs of all of each query's linearized instances, by ``partial_score``: how the greedy
    walk values a query's paths."""
    # what the score reads of an instance is all that goes to Python
    needed = lambda c, *names: F.transform(c, lambda e: F.struct(*[e[n].alias(n) for n in names]))
    fields = ("feature", "clan", "position", "start", "stop")
    s = seeds.select(F.col("protein_id").alias("seed"), *[needed(c, *fields).alias(f"s_{c}") for c in ("lin", "normal")])
    q = queries.select(F.col("protein_id").alias("query"), needed("lin", *fields).alias("lin"), needed("normal", "clan").alias("normal"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                clans = clan_tally(r["lin"] + r["normal"])
                seed_all = r["s_lin"] + r["s_normal"]
                ms, ps, cs = partial_parts(r["lin"], seed_all, clans)
                rows.append((ms * o.weight_multiplicity + cs * o.weight_clan + ps * o.weight_position, ms, ps, cs))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("seed"), b.column("query"), *(pa.array(c, pa.float64()) for c in cols)], names=["seed", "query", "final", "ms", "ps", "cs"])

    t = pairs.schema["seed"].dataType.simpleString(), pairs.schema["query"].dataType.simpleString()
    return pairs.select("seed", "query").join(s, "seed").join(q, "query").mapInArrow(run, f"seed {t[0]}, query {t[1]}, final double, ms double, ps double, cs double")


#: Values of candidates are compared to so many decimals, so that the order of sums decides nothing.
TIES = 10


def walk(after: dict[int, list[int]], lin: list[dict], scorer, prefer: str | None = None) -> list[int]:
    """From START to END, at each node to the successor that gives the path the highest value, the last among equals;
    candidates of the feature ``prefer`` go first where there are any. ``scorer`` keeps the path's value as it grows,
    so that a candidate is not scored from the beginning."""
    path: list[int] = []
    at = -1
    while after[at]:
        some = [v for v in after[at] if lin[v]["feature"] == prefer] or after[at]
        if len(some) > 1:
            best = None
            for v in some:
                x = round(scorer.peek(lin[v]), TIES)
                if best is None or x >= best[0]:
                    best = (x, v)
            at = best[1]
        else:
            at = some[0]
        scorer.take(lin[at])
        path.append(at)
    return path


def all_paths(before: list[list[int]]) -> list[list[int]]:
    ending: list[list[list[int]]] = []
    for v, us in enumerate(before):
        ending.append([[*p, v] for u in us for p in ending[u]] if us else [[v]])
    inner = {u for us in before for u in us}
    return sorted(p for v, ps in enumerate(ending) if v not in inner for p in ps) or [[]]


def best_pair(row: dict, o: ScoringOptions, distance: bool) -> tuple:
    s_lin, s_normal, q_lin, q_normal = row["s_lin"], row["s_normal"], row["q_lin"], row["q_normal"]
    weights = None if row["w_map"] is None else dict(row["w_map"])
    s_after, q_after = successors(row["s_before"]), successors(row["q_before"])

    def score(sp: list[int], qp: list[int]) -> tuple:
        return score_elements([s_lin[k] for k in sp], s_normal, [q_lin[k] for k in qp], q_normal, weights, o, distance)

    if row["query_greedy"]:
        clans = clan_tally(q_lin + q_normal)

        def scorer() -> QueryPath | QueryPathByDistance:
            return QueryPathByDistance(s_lin, s_normal, weights, o) if distance else QueryPath(s_lin + s_normal, clans, o)

        queries = {tuple(walk(q_after, q_lin, scorer(), f)) for f in [*dict.fromkeys(e["feature"] for e in q_lin), None]}
    else:
        queries = set(map(tuple, all_paths(row["q_before"])))
    best = None
    for qp in sorted(queries):
        if row["seed_greedy"]:
            seeds = [walk(s_after, s_lin, SeedPath(s_normal, [q_lin[k] for k in qp], q_normal, weights, o, distance))]
        else:
            seeds = all_paths(row["s_before"])
        for sp in seeds:
            x = score(sp, list(qp))
            if best is None or round(x[0], 10) > round(best[0][0], 10):
                best = (x, sp, list(qp))
    names = ["priority" if row[f"{k}_greedy"] else "exhaustive" for k in ("seed", "query")]
    return (*best[0], best[1], best[2], "/".join(names))


def score(pairs: DataFrame, seeds: DataFrame, queries: DataFrame, options: ScoringOptions, weights: DataFrame | None, distance: bool) -> DataFrame:
    """``pairs``: seed, query, seed_greedy, query_greedy."""
    s = seeds.select(F.col("protein_id").alias("seed"), F.col("lin").alias("s_lin"), F.col("normal").alias("s_normal"), F.col("before").alias("s_before"))
    q = queries.select(F.col("protein_id").alias("query"), F.col("lin").alias("q_lin"), F.col("normal").alias("q_normal"), F.col("before").alias("q_before"))
    rows = pairs.select("seed", "query", "seed_greedy", "query_greedy").join(s, "seed").join(q, "query")
    if weights is None:
        rows = rows.withColumn("w_map", F.lit(None).cast("map<string,double>"))
    elif distance:
        rows = rows.crossJoin(F.broadcast(weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("w_map"))))
    else:
        rows = rows.join(weights.groupBy(F.col("protein_id").alias("seed")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("w_map")), "seed", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["final", "ms", "ps", "cs", "ls", "seed_path", "query_path", "mode"]
        kinds = [pa.float64()] * 5 + [pa.list_(pa.int32())] * 2 + [pa.string()]
        for b in batches:
            out = list(zip(*(best_pair(r, options, distance) for r in b.to_pylist()), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("seed"), b.column("query"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=["seed", "query", *names])

    t = pairs.schema["seed"].dataType.simpleString(), pairs.schema["query"].dataType.simpleString()
    return rows.mapInArrow(run, f"seed {t[0]}, query {t[1]}, {_OUT}")
