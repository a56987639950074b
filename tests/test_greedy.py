"""The greedy walk with its growing scores, against walks that score every candidate's whole path."""

import random
import time

import pytest

from quiltspan.options import ScoringOptions
from quiltspan.plans import greedy
from quiltspan.plans.path_scorer import QueryPath, QueryPathByDistance, SeedPath, clan_tally


def element(rng, i, linearized=True):
    s = rng.randint(1, 80)
    e = s + rng.randint(3, 16)
    feature = rng.choice(["pfam_A", "pfam_B", "smart_C", "smart_D"]) if linearized else rng.choice(["tmhmm_X", "flps_Y"])
    return {"i": i, "feature": feature, "clan": rng.choice([None, "K", "L"]), "linearized": linearized, "position": (s + e) / 2 / 100, "start": s, "stop": e}


def protein(rng):
    lin = sorted((element(rng, i) for i in range(rng.randint(1, 9))), key=lambda e: (e["stop"], e["i"]))
    return lin, [element(rng, 100 + i, False) for i in range(rng.randint(0, 3))]


def before(lin):
    out = []
    for v, e in enumerate(lin):
        fits = [u for u in range(v) if lin[u]["stop"] < e["start"]]
        out.append([u for u in fits if not any(lin[u]["stop"] < lin[w]["start"] for w in fits if w > u)])
    return out


def plain_walk(after, lin, value, prefer=None):
    path, at = [], -1
    while after[at]:
        some = [v for v in after[at] if lin[v]["feature"] == prefer] or after[at]
        values = [round(value([*path, v]), 10) for v in some] if len(some) > 1 else [0.0]
        at = max(v for v, x in zip(some, values, strict=True) if x == max(values))
        path.append(at)
    return path


WEIGHTS = {"pfam_A": 0.4, "pfam_B": 0.3, "smart_C": 0.1, "tmhmm_X": 0.2}
SHARES = {"weight_multiplicity": 0.5, "weight_clan": 0.2, "weight_position": 0.3}
OPTIONS = [ScoringOptions(**SHARES), ScoringOptions(**SHARES, digits=4), ScoringOptions(**SHARES, constraints={"pfam": 0.9, "smart_C": 0.05})]


@pytest.mark.parametrize("o", OPTIONS)
@pytest.mark.parametrize("distance", [False, True])
@pytest.mark.parametrize("weights", [None, WEIGHTS])
def test_seed_walk(o, distance, weights):
    rng = random.Random(5)
    for _ in range(120):
        (s_lin, s_normal), (q_lin, q_normal) = protein(rng), protein(rng)
        chosen = [e for e in q_lin if rng.random() < 0.6]
        after = greedy.successors(before(s_lin))
        value = lambda p: greedy.score_elements([s_lin[k] for k in p], s_normal, chosen, q_normal, weights, o, distance)[0]  # noqa: B023, E731
        scorer = SeedPath(s_normal, chosen, q_normal, weights, o, distance)
        got = greedy.walk(after, s_lin, scorer)
        assert got == plain_walk(after, s_lin, value)
        assert scorer.value() == pytest.approx(value(got), abs=1e-9 if o.digits is None else 2e-4)


@pytest.mark.parametrize("o", OPTIONS[:2])
def test_query_walk_by_similarity(o):
    rng = random.Random(6)
    for _ in range(150):
        (s_lin, s_normal), (q_lin, q_normal) = protein(rng), protein(rng)
        clans, seed = clan_tally(q_lin + q_normal), s_lin + s_normal
        after = greedy.successors(before(q_lin))
        value = lambda p: greedy.partial_score([q_lin[k] for k in p], seed, clans, o)  # noqa: B023, E731
        for prefer in ("pfam_A", None):
            scorer = QueryPath(seed, clans, o)
            got = greedy.walk(after, q_lin, scorer, prefer)
            assert got == plain_walk(after, q_lin, value, prefer)
            assert scorer.value() == pytest.approx(value(got), abs=1e-9 if o.digits is None else 2e-4)


@pytest.mark.parametrize("o", OPTIONS[:2])
@pytest.mark.parametrize("weights", [None, WEIGHTS, {"pfam_A": 0.05}])
def test_query_walk_by_distance(o, weights):
    """The distance variant goes by the score of the whole seed against the path, without the query's other features."""
    rng = random.Random(7)
    other = 0
    for _ in range(150):
        (s_lin, s_normal), (q_lin, q_normal) = protein(rng), protein(rng)
        after = greedy.successors(before(q_lin))
        value = lambda p: greedy.score_elements(s_lin, s_normal, [q_lin[k] for k in p], [], weights, o, True)[0]  # noqa: B023, E731
        for prefer in ("pfam_A", None):
            scorer = QueryPathByDistance(s_lin, s_normal, weights, o)
            got = greedy.walk(after, q_lin, scorer, prefer)
            assert got == plain_walk(after, q_lin, value, prefer)
            assert scorer.value() == pytest.approx(value(got), abs=1e-9 if o.digits is None else 2e-4)
            other += got != greedy.walk(after, q_lin, QueryPath(s_lin + s_normal, clan_tally(q_lin + q_normal), o), prefer)
    assert other > 20


def test_best_pair_by_distance():
    rng = random.Random(8)
    o = OPTIONS[0]
    for _ in range(60):
        (s_lin, s_normal), (q_lin, q_normal) = protein(rng), protein(rng)
        row = {"s_lin": s_lin, "s_normal": s_normal, "q_lin": q_lin, "q_normal": q_normal, "w_map": list(WEIGHTS.items()), "s_before": before(s_lin), "q_before": before(q_lin), "seed_greedy": True, "query_greedy": True}
        got = greedy.best_pair(row, o, True)
        score = lambda x, y: greedy.score_elements([s_lin[k] for k in x], s_normal, [q_lin[k] for k in y], q_normal, WEIGHTS, o, True)[0]  # noqa: B023, E731
        whole = lambda p: greedy.score_elements(s_lin, s_normal, [q_lin[k] for k in p], [], WEIGHTS, o, True)[0]  # noqa: B023, E731
        ways = [plain_walk(greedy.successors(before(q_lin)), q_lin, whole, f) for f in [*{e["feature"] for e in q_lin}, None]]
        best = max(score(plain_walk(greedy.successors(before(s_lin)), s_lin, lambda p, w=w: score(p, w)), w) for w in ways)  # noqa: B023
        assert got[0] == pytest.approx(best)


@pytest.mark.parametrize("distance", [False, True])
def test_many_overlapping_instances(distance):
    """5,000 instances of which many overlap, and paths of some thousand: seconds, not hours."""
    rng = random.Random(9)
    lin = []
    for i in range(5_000):
        s = rng.randint(1, 30_000)
        e = s + rng.randint(2, 12)
        lin.append({"i": i, "feature": f"pfam_{rng.randint(0, 40)}", "clan": rng.choice([None, "K"]), "linearized": True, "position": (s + e) / 60_000, "start": s, "stop": e})
    lin.sort(key=lambda e: (e["stop"], e["i"]))

    from bisect import bisect_left
    from itertools import accumulate

    ends, starts = [e["stop"] for e in lin], [e["start"] for e in lin]
    latest = list(accumulate(starts, max))
    last = [bisect_left(ends, s) for s in starts]
    preds = [list(range(bisect_left(ends, latest[k - 1]), k)) if k else [] for k in last]
    row = {"s_lin": lin, "s_normal": [], "q_lin": lin, "q_normal": [], "w_map": [("pfam_1", 0.2)] if distance else None, "s_before": preds, "q_before": preds, "seed_greedy": True, "query_greedy": True}
    began = time.time()
    path = greedy.walk(greedy.successors(preds), lin, SeedPath([], lin, [], None, ScoringOptions(), distance))
    assert len(path) > 1_000
    query = QueryPathByDistance(lin, [], {"pfam_1": 0.2}, ScoringOptions()) if distance else QueryPath(lin, clan_tally(lin), ScoringOptions())
    assert len(greedy.walk(greedy.successors(row["q_before"]), lin, query)) > 1_000
    assert time.time() - began < 60
