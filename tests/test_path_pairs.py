"""Paths of a batch of pairs compared at once: against the plain scorer under every option, and what the plans send."""

import random
from dataclasses import replace

import pyarrow as pa
import pytest

from quiltspan.options import ScoringOptions
from quiltspan.plans import architecture as A
from quiltspan.plans import greedy, path_pairs, scoring
from quiltspan.plans.path_scorer import tool_prefix

O = ScoringOptions(weight_multiplicity=0.6, weight_clan=0.2, weight_position=0.2)
WEIGHTS = {"pfam_A": 0.2, "pfam_B": 0.3, "smart_C": 0.4}


def _protein(rng):
    def one(f):
        s = rng.randint(1, 80)
        return {"feature": f, "clan": "K" if f == "pfam_A" else None, "linearized": f != "tmhmm_D", "position": s / 100, "start": s, "stop": s + rng.randint(3, 19)}

    lin = [one(rng.choice(["pfam_A", "pfam_B", "smart_C"])) for _ in range(rng.randint(0, 5))]
    paths = [sorted(rng.sample(range(len(lin)), rng.randint(0, len(lin)))) for _ in range(rng.randint(1, 4))]
    return lin, [one("tmhmm_D") for _ in range(rng.randint(0, 3))], paths


def _column(proteins):
    flat = [{**{c: [e[c] for e in lin + normal] for c in ("feature", "position", "start", "stop")}, "clan": [e["clan"] for e in lin]} for lin, normal, _ in proteins]
    kind = pa.struct([("feature", pa.list_(pa.string())), ("position", pa.list_(pa.float64())), ("start", pa.list_(pa.int32())), ("stop", pa.list_(pa.int32())), ("clan", pa.list_(pa.string()))])
    return pa.array(flat, kind), pa.array([p for *_, p in proteins], pa.list_(pa.list_(pa.int32())))


@pytest.mark.parametrize("together", [1 << 20, 7])
@pytest.mark.parametrize("options, weights, distance", [(O, None, False), (O, WEIGHTS, False), (replace(O, distance_default=0.3), WEIGHTS, True), (O, None, True), (replace(O, constraints={"pfam": 0.9, "smart_C": 0.1}), WEIGHTS, False), (replace(O, empty_as_1=True), None, False)])
def test_batches_against_the_plain_scorer(monkeypatch, together, options, weights, distance):
    monkeypatch.setattr(path_pairs, "TOGETHER", together)
    rng = random.Random(5)
    seeds, queries = [[_protein(rng) for _ in range(60)] for _ in "sq"]
    w_map = None if weights is None else pa.array([[{"key": k, "value": v} for k, v in weights.items()]] * 60, pa.list_(pa.struct([("key", pa.string()), ("value", pa.float64())])))
    got = path_pairs.best_pairs(*_column(seeds), *_column(queries), w_map, options, distance, tool_prefix).to_pylist()
    for (s_lin, s_normal, s_paths), (q_lin, q_normal, q_paths), row in zip(seeds, queries, got, strict=True):
        best = None
        for qp in q_paths:
            for sp in s_paths:
                x = greedy.score_elements([s_lin[k] for k in sp], s_normal, [q_lin[k] for k in qp], q_normal, weights, options, distance)
                if best is None or round(x[0], 10) > round(best[0][0], 10):
                    best = (x, sp, qp)
        assert [row[c] for c in ("final", "ms", "ps", "cs", "ls")] == pytest.approx(best[0]) and (row["seed_path"], row["query_path"]) == best[1:]


def _tables(spark):
    rows = [("a", 0, "pfam_A", 1, 10), ("a", 1, "pfam_B", 20, 30), ("b", 0, "pfam_A", 3, 12), ("c", 0, "smart_C", 5, 9)]
    inst = spark.createDataFrame([(p, 100, f.split("_")[0], True, f, None, i, s, e, None) for p, i, f, s, e in rows], "protein_id string, length int, tool string, linearized boolean, feature string, clan string, i int, start int, stop int, evalue double")
    return inst, spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "none"), ("none", "a"), ("c", "a")], "seed string, query string")


def test_paths_are_compared_in_batches(spark):
    """Not by functions on arrays for each instance of each path of each pair, and without the columns that scoring does not read."""
    inst, pairs = _tables(spark)
    p = scoring.prepare(A.proteins(inst.select("protein_id").distinct(), inst, O), O)
    plan = scoring.score_pairs(pairs, p, p, O)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "arrays_zip" not in plan and "map_from_entries" not in plan and "map_keys" not in plan


def test_unlinearized_scores_sort_no_instances(spark):
    """A pair meets a row of each protein: no join by feature, whose sorted rows filled a task's memory before."""
    inst, pairs = _tables(spark)
    out = scoring.unlinearized_scores(pairs, A.architecture(inst, O))
    got = {(r["seed"], r["query"]): (r["ms"], round(r["ps"], 9), round(r["ls"], 9)) for r in out.collect()}
    assert got == {("a", "b"): (0.5, 0.49, 0.5), ("b", "a"): (1.0, 0.98, 1.0), ("a", "none"): (0.0, 0.0, 0.0), ("c", "a"): (0.0, 0.0, 0.0)}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 2 and not any("feature" in x for x in joins)
