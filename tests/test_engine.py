"""The architecture engine: hand-made cases, a plain scorer, formats, and every registered query against its SQL."""

import itertools
import json
import os
import random
from dataclasses import replace

import pytest

import __spark_entry__
from quiltspan import catalogue, catalogue_files  # noqa: F401
from quiltspan.functions.expressions import corrected_count, exact_round, four_significant
from quiltspan.operators import maintenance as M
from quiltspan.operators import reports
from quiltspan.options import ScoringOptions
from quiltspan.plans import architecture as A
from quiltspan.plans import greedy, scoring, weights
from quiltspan.plans import linearise as L
from quiltspan.sources import annotation, predictors, text

SMALL = "/root/testdata/sf0.001"
INSTANCE = "protein_id string, length int, tool string, linearized boolean, feature string, clan string, i int, start int, stop int, evalue double"


def arch(spark, proteins, length=100):
    rows = []
    for p, fs in proteins.items():
        rows += [(p, length, f.split("_")[0], f.split("_")[0] in ("pfam", "smart"), f, c, k, s, e, None) for k, (f, c, s, e) in enumerate(fs)]
    universe = spark.createDataFrame([(p,) for p in proteins], "protein_id string")
    return universe, spark.createDataFrame(rows, INSTANCE)


def score(spark, proteins, pairs, options=ScoringOptions(), w=None, distance=False):
    universe, inst = arch(spark, proteins)
    p = scoring.prepare(A.proteins(universe, inst, options), options)
    out = scoring.score_pairs(spark.createDataFrame(pairs, "seed string, query string"), p, p, options, w(inst) if w else None, distance)
    return {(r["seed"], r["query"]): r for r in out.collect()}


A1, B1 = ("pfam_A", None, 1, 10), ("pfam_B", None, 20, 30)


def test_hand_made_cases(spark):
    ps = {"a": [A1], "a2": [A1], "ab": [A1, B1], "none": [], "none2": [], "twice": [("pfam_A", None, 16, 24), ("pfam_A", None, 76, 84)], "once": [("pfam_A", None, 16, 24)], "x2": [("pfam_A", "X", 1, 10), ("pfam_B", "X", 20, 30)], "x1": [("pfam_A", "X", 1, 10)]}
    r = score(spark, ps, [("a", "a2"), ("ab", "a"), ("a", "ab"), ("none", "none2"), ("none", "a"), ("twice", "once"), ("x2", "x1")])
    near = lambda x, *v: [round(x[k], 9) for k in ("ms", "ps", "final")] == [pytest.approx(y) for y in v]
    assert near(r["a", "a2"], 1, 1, 1) and near(r["ab", "a"], 0.5, 0.5, 0.5) and near(r["a", "ab"], 1, 1, 1)
    assert near(r["none", "none2"], 0, 0, 0) and near(r["none", "a"], 0, 0, 0)
    assert near(r["twice", "once"], 0.5, 0.7, 0.56) and r["x2", "x1"]["cs"] == 0.5
    one = score(spark, ps, [("none", "none2")], ScoringOptions(empty_as_1=True))
    assert one["none", "none2"]["final"] == 1.0
    far = score(spark, ps, [("none", "none2"), ("ab", "a")], distance=True)
    assert far["none", "none2"]["ms"] == far["none", "none2"]["ps"] == 1.0 and far["ab", "a"]["ms"] == pytest.approx(0.5)


def test_overlaps_and_paths(spark):
    universe, inst = arch(spark, {"p": [("pfam_A", None, 1, 50), ("pfam_B", None, 40, 90)], "q": []})
    for o, n in ((ScoringOptions(), 2), (ScoringOptions(max_overlap=20), 1)):
        rows = {r["protein_id"]: r for r in L.with_paths(scoring.prepare(A.proteins(universe, inst, o), o)).collect()}
        assert rows["p"]["n_paths"] == n == len(rows["p"]["paths"]) and rows["q"]["paths"] == [[]] and rows["q"]["n_paths"] == 1


def test_counts_and_weights(spark):
    df = spark.createDataFrame([(1,), (3,), (10,)], "n long")
    assert [r[0] for r in df.select(corrected_count(df["n"], "loge")).collect()] == [1, 2, 3]
    _, inst = arch(spark, {"p": [("pfam_f", None, 1, 2), ("pfam_g", None, 3, 4)]})
    ref = spark.createDataFrame([("pfam_f", 1), ("pfam_g", 3)], "feature string, n long")
    w = {r["feature"]: r["weight"] for r in weights.frequency_weights(inst, ref, ScoringOptions(count_correction="linear", digits=4)).collect()}
    assert w == {"pfam_f": 0.75, "pfam_g": 0.25}
    c = {r["feature"]: r["weight"] for r in weights.constrained_weights(inst, ref, ScoringOptions(count_correction="linear", constraints={"pfam_f": 0.3})).collect()}
    assert c == {"pfam_f": 0.3, "pfam_g": pytest.approx(0.7)}


def plain_paths(spans):
    """All maximal chains of intervals that do not overlap, as sorted lists of ranks."""
    n = len(spans)
    ok = lambda a, b: spans[a][1] < spans[b][0]
    chains = [c for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(ok(a, b) for a, b in zip(c, c[1:], strict=False))]
    full = set(chains)
    return sorted(list(c) for c in chains if not any(tuple(sorted((*c, x))) in full for x in range(n) if x not in c)) or [[]]


def test_random_architectures_against_a_plain_scorer(spark):
    rng = random.Random(11)
    ps = {}
    for k in range(24):
        fs = []
        for _ in range(rng.randint(0, 7)):
            s = rng.randint(1, 80)
            f = rng.choice(["pfam_A", "pfam_B", "smart_C", "tmhmm_D"])
            fs.append((f, "K" if f == "pfam_A" else None, s, s + rng.randint(3, 19)))
        ps[f"p{k}"] = fs
    names = list(ps)
    pairs = [(a, b) for a in names for b in names if a != b and rng.random() < 0.3]
    o = ScoringOptions(weight_multiplicity=0.6, weight_clan=0.2, weight_position=0.2)
    got, dist = score(spark, ps, pairs, o), score(spark, ps, pairs, o, distance=True)
    c = replace(o, constraints={"pfam": 0.9, "smart_C": 0.1})
    fixed = spark.createDataFrame([("pfam_A", 0.2), ("pfam_B", 0.3), ("smart_C", 0.4), ("tmhmm_D", 0.5)], "feature string, weight double")
    tied = score(spark, ps, pairs, c, lambda inst: inst.select("protein_id").distinct().crossJoin(fixed))

    def side(p):
        es = [{"feature": f, "clan": c, "start": s, "stop": e, "position": (s + e) / 2 / 100, "i": i, "linearized": not f.startswith("tmhmm")} for i, (f, c, s, e) in enumerate(ps[p])]
        lin = sorted((e for e in es if not e["feature"].startswith("tmhmm")), key=lambda e: (e["stop"], e["i"]))
        return lin, [e for e in es if e["feature"].startswith("tmhmm")]

    for a, b in pairs:
        (s_lin, s_norm), (q_lin, q_norm) = side(a), side(b)
        sp, qp = plain_paths([(e["start"], e["stop"]) for e in s_lin]), plain_paths([(e["start"], e["stop"]) for e in q_lin])
        if not q_lin:
            sp = sp[-1:]
        for rows, far in ((got, False), (dist, True), (tied, None)):
            own = {f: 0.2 + 0.1 * k for k, f in enumerate(("pfam_A", "pfam_B", "smart_C", "tmhmm_D"))} if far is None else None
            best = max(greedy.score_elements([s_lin[k] for k in x], s_norm, [q_lin[k] for k in y], q_norm, own, c if far is None else o, bool(far))[0] for x in sp for y in qp)
            if sorted(ps[a]) != sorted(ps[b]):
                assert rows[a, b]["final"] == pytest.approx(best), (a, b, far)


def test_greedy_route(spark):
    rng = random.Random(5)
    many = [("pfam_A" if rng.random() < 0.5 else "smart_B", None, s, s + 2) for s in range(1, 97, 3)]
    ps = {"m": many, "n": list(reversed(many)), "a": [("pfam_A", None, 1, 3)]}
    r = score(spark, ps, [("m", "n"), ("a", "m"), ("m", "a")])
    assert r["m", "n"]["mode"] == "priority/priority" and r["m", "n"]["final"] == pytest.approx(1.0)
    assert r["a", "m"]["mode"] == "exhaustive/priority" and r["m", "a"]["mode"] == "priority/exhaustive"
    assert r["a", "m"]["ms"] == 1.0
    limited = score(spark, {"x": [("pfam_A", None, 1, 50), ("pfam_B", None, 40, 90)], "y": [A1]}, [("x", "y")], ScoringOptions(paths_limit=0 + 1))
    assert limited["x", "y"]["final"] is not None


def test_very_many_paths_and_instances(spark):
    """200 overlapping pairs have 2^200 paths, 5,000 intervals in a row have one: both take the greedy route."""
    pairs = [(("pfam_A", "smart_B")[k % 2], None, 10 * (k // 2) + k % 2, 10 * (k // 2) + 5 + k % 2) for k in range(400)]
    row = [("pfam_A" if k % 3 else "smart_B", None, 3 * k + 1, 3 * k + 2) for k in range(5000)]
    universe, inst = arch(spark, {"pairs": pairs, "row": row, "a": [A1]}, 20_000)
    o = ScoringOptions()
    p = scoring.prepare(A.proteins(universe, inst, o), o)
    assert {r["protein_id"]: r["n_paths"] for r in p.collect()} == {"pairs": L.MOST_PATHS, "row": 1, "a": 1}
    r = {(x["seed"], x["query"]): x for x in scoring.score_pairs(spark.createDataFrame([("a", "pairs"), ("pairs", "a"), ("a", "row"), ("row", "a")], "seed string, query string"), p, p, o).collect()}
    assert len(r) == 4 and all(x["final"] is not None and "priority" in x["mode"] for x in r.values())
    assert len(r["row", "a"]["seed_path"]) == 5000 and len(r["pairs", "a"]["seed_path"]) == 200


def test_predecessors_against_the_definition(spark):
    rng = random.Random(9)
    ps = {}
    for k in range(60):
        starts = [rng.randint(1, 40) for _ in range(rng.randint(0, 9))]
        ps[f"p{k}"] = [("pfam_A", None, s, s + rng.randint(0, 12)) for s in starts]
    universe, inst = arch(spark, ps)
    got = {r["protein_id"]: r for r in scoring.prepare(A.proteins(universe, inst, ScoringOptions()), ScoringOptions()).collect()}
    for p, fs in ps.items():
        spans = sorted(((s, e) for _, _, s, e in fs), key=lambda x: x[1])
        ok = lambda u, v, spans=spans: u < v and spans[u][1] < spans[v][0]
        n = len(spans)
        want = [[u for u in range(n) if ok(u, v) and not any(ok(u, w) and ok(w, v) for w in range(n))] for v in range(n)]
        assert got[p]["before"] == want and got[p]["n_paths"] == len(plain_paths(spans))


def test_distance_weight_file_default(spark):
    """The default weighs what the file does not name, in scores and in the domain table."""
    ps = {"s": [A1, B1, ("smart_C", None, 40, 50)], "q": [A1]}
    universe, inst = arch(spark, ps)
    w = spark.createDataFrame([("pfam_A", 0.4)], "feature string, weight double")
    pairs = spark.createDataFrame([("s", "q")], "seed string, query string")
    for default, scale in ((0.5, 1 / 1.4), (0.1, 1.0), (0.8, 1 / 2.0)):
        o = ScoringOptions(distance_default=default)
        p = scoring.prepare(A.proteins(universe, inst, o), o)
        r = scoring.score_pairs(pairs, p, p, o, w, True)
        assert r.first()["ms"] == pytest.approx(1 - 2 * default * scale)
        none = [spark.createDataFrame([], f"feature string, {c}") for c in ("interpro string", "plen int")]
        rows = reports.domain_report(r, (p, inst), (p, inst), *none, w, True, default).collect()
        assert {x["feature"]: x["weight"] for x in rows if x["ortholog"] == "s"} == {"pfam_A": round(0.4 * scale, 4), "pfam_B": pytest.approx(round(default * scale, 4)), "smart_C": pytest.approx(round(default * scale, 4))}
        assert [(x["feature"], x["weight"], x["path"]) for x in rows if x["ortholog"] == "q"] == [("pfam_A", round(0.4 * scale, 4), "Y")]


def test_greedy_against_a_plain_walk(spark):
    """At each place the walk goes on to the successor whose path so far scores best; the last one among equals."""
    rng = random.Random(21)
    ps = {}
    for k in range(14):
        fs = []
        for _ in range(rng.randint(4, 9)):
            s = rng.randint(1, 80)
            fs.append((rng.choice(["pfam_A", "pfam_B", "smart_C"]), "K" if rng.random() < 0.4 else None, s, s + rng.randint(3, 14)))
        ps[f"p{k}"] = fs
    pairs = [(a, b) for a in ps for b in ps if a != b and rng.random() < 0.4]
    o = ScoringOptions(max_features=1, weight_multiplicity=0.6, weight_clan=0.2, weight_position=0.2)
    got = score(spark, ps, pairs, o)

    def lin(p):
        es = [{"feature": f, "clan": c, "start": s, "stop": e, "position": (s + e) / 2 / 100, "i": i, "linearized": True} for i, (f, c, s, e) in enumerate(ps[p])]
        return sorted(es, key=lambda e: (e["stop"], e["i"]))

    def following(es, at):
        ok = lambda u, v: u is None or es[u]["stop"] < es[v]["start"]
        some = [v for v in range(len(es)) if (at is None or v > at) and ok(at, v)]
        return [v for v in some if not any(w != v and ok(w, v) and w < v for w in some)]

    def go(es, value, wanted=None):
        path, at = [], None
        while some := following(es, at):
            some = [v for v in some if wanted and es[v]["feature"] == wanted] or some
            scores = [value(path + [v]) for v in some] if len(some) > 1 else [0]
            at = max(v for v, x in zip(some, scores, strict=True) if x == max(scores))
            path.append(at)
        return path

    def multiplicity(mine, theirs):
        return sum(min(sum(t["feature"] == f for t in theirs) / sum(m["feature"] == f for m in mine), 1) for f in {m["feature"] for m in mine}) / len({m["feature"] for m in mine})

    def places(mine, theirs):
        by = {}
        for m in mine:
            near = [1 - abs(m["position"] - t["position"]) for t in theirs if t["feature"] == m["feature"]]
            by.setdefault(m["feature"], []).append(max([0, *near]))
        return sum(sum(x) / len(x) for x in by.values()) / len(by)

    def clans(mine, all_):
        n = {c: sum(m["clan"] == c for m in mine) for c in {m["clan"] for m in mine} if c}
        t = {c: sum(m["clan"] == c for m in all_) for c in n}
        return sum(n[c] * t[c] / max(n[c], t[c]) ** 2 for c in n if t[c]) / len(n) if n else 0

    for a, b in pairs:
        s, q = lin(a), lin(b)
        value = lambda mine, theirs, all_: 0.6 * multiplicity(mine, theirs) + 0.2 * clans(mine, all_) + 0.2 * places(mine, theirs)
        ways = {tuple(go(q, lambda p: round(value([q[k] for k in p], s, q), 12), f)) for f in [*{e["feature"] for e in q}, None]}
        best = max(max(value([s[k] for k in go(s, lambda p, w=w: round(value([s[k] for k in p], [q[k] for k in w], [q[k] for k in w]), 12))], [q[k] for k in w], [q[k] for k in w]) for _ in (0,)) for w in ways)
        assert got[a, b]["mode"] == "priority/priority"
        assert got[a, b]["final"] == pytest.approx(best), (a, b)


def test_complexity_against_the_definition(spark):
    universe, inst = arch(spark, {"p": [("pfam_A", None, 1, 10), ("pfam_B", None, 5, 12), ("pfam_C", None, 20, 30), ("pfam_D", None, 22, 33), ("pfam_E", None, 25, 34)], "q": [], "r": [A1]})
    p = scoring.prepare(A.proteins(universe, inst, ScoringOptions()), ScoringOptions())
    # START has two successors, each of them three, those none but the end
    assert {r["protein_id"]: (r["n_paths"], r["greedy_steps"]) for r in L.complexity(p).collect()} == {"p": (6, 5), "q": (1, 0), "r": (1, 0)}


def test_options_are_checked():
    for bad in ({"weight_clan": 0.5}, {"max_overlap_share": 2}, {"count_correction": "ln"}, {"constraints": {"pfam": 1.5}}):
        with pytest.raises(ValueError):
            ScoringOptions(**bad)


def test_rounding_and_formats(spark):
    df = spark.createDataFrame([(2.675,), (0.5,), (None,)], "x double")
    assert [r[0] for r in df.select(exact_round(2)("x")).collect()] == [2.67, 0.5, None]
    assert [r[0] for r in df.select(four_significant("x")).collect()] == ["2.675", "0.5", None]


def test_annotation_documents(spark, tmp_path):
    doc = {"feature": {"p1": {"length": 100, "pfam": {"pfam_B": {"evalue": 0.1, "instance": [[1, 10, 0.5, 3.2, 1, 9]]}, "pfam_A": {"evalue": "NA", "instance": [[5, 8, "NA"], [9, 12, 0.001]]}}, "smart": {}}, "p2": {"length": 7, "pfam": {}}}, "clan": {"pfam_A": "CL1"}, "count": {"pfam_A": 2}, "interproID": {"pfam_A": "PF1.2"}, "length": {"pfam_A": "33"}, "version": {"pfam": {"version": "1"}}}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    docs = annotation.read_documents(spark, str(tmp_path / "x.json"))
    rows = [tuple(r) for r in A.number_instances(annotation.instances(docs)).orderBy("i").select("proteome", "protein_id", "length", "tool", "feature", "feature_evalue", "start", "stop", "evalue", "bit_score", "i").collect()]
    assert rows == [("x", "p1", 100, "pfam", "pfam_B", 0.1, 1, 10, 0.5, 3.2, 0), ("x", "p1", 100, "pfam", "pfam_A", None, 5, 8, None, None, 1), ("x", "p1", 100, "pfam", "pfam_A", None, 9, 12, 0.001, None, 2)]
    assert {(r["protein_id"], r["length"]) for r in annotation.proteins(docs).collect()} == {("p1", 100), ("p2", 7)}
    assert [tuple(r) for r in annotation.dimension(docs, "clan", "clan").collect()] == [("pfam_A", "CL1")]
    assert annotation.versions(docs).first()["info"] == {"version": "1"}


def test_text_formats(spark, tmp_path):
    assert text.parse_tool_list("#linearized\nPfam\nsmart\n#normal\ntmhmm\n#checked\n") == [("pfam", True, 0), ("smart", True, 1), ("tmhmm", False, 2)]
    with pytest.raises(ValueError):
        text.parse_tool_list("pfam\n")
    assert text.annotation_tools("Pfam\n#checked\n") == ["pfam"]
    with pytest.raises(ValueError):
        text.annotation_tools("pfam\n")
    assert text.parse_constraints("#tools\npfam\t0.4\nsmart\tN\n#features\npfam_X\t0.1\n") == {"pfam": 0.4, "pfam_X": 0.1}
    (tmp_path / "f.fa").write_text(">a one\nMK\nLV\n>g|t|p|1\nAA\n>b\n\n")
    fasta = text.read_fasta(spark, str(tmp_path / "f.fa"))
    assert {(r["id"], r["sequence"], r["length"]) for r in fasta.collect()} == {("a", "MKLV", 4), ("g|t|p|1", "AA", 2), ("b", "", 0)}
    assert [(r["grp"], r["taxon"], r["protein_id"]) for r in text.extended_headers(text.read_fasta(spark, str(tmp_path / "f.fa"), positions=True)).collect()] == [("g", "t", "p")]
    assert text.unique_ids(fasta).count() == 3
    with pytest.raises(Exception, match="twice"):
        text.unique_ids(fasta.union(fasta)).count()
    lines = spark.createDataFrame([("a  t1 b t2",), ("x y",), (">>id",)], "value string")
    assert [tuple(r) for r in text.four_columns(lines).collect()] == [("a", "t1", "b", "t2")]
    assert [r[0] for r in text.id_list(lines.where("value like '>%'")).collect()] == ["id"]
    assert ("x", "y") in [tuple(r) for r in text.two_columns(lines, "k", "v").collect()]
    (tmp_path / "d.dat").write_text("# STOCKHOLM 1.0\n#=GF ID   Fam1\n#=GF AC   PF001.3\n#=GF CL   CL9\n#=GF ML   55\n//\n#=GF ID   Fam2\n#=GF AC   PF002.1\n#=GF ML   7\n//\n")
    assert {tuple(r) for r in text.domain_family_blocks(spark, str(tmp_path / "d.dat")).select("id", "accession_base", "clan", "length").collect()} == {("Fam1", "PF001", "CL9", 55), ("Fam2", "PF002", "NA", 7)}
    aln = spark.createDataFrame([("f", k, v) for k, v in enumerate(["CLUSTAL W", "", "a.1  MK-", "b    MKL", "", "a.1  V", "b    W"])], "file string, pos long, value string")
    assert {(r["id"], r["sequence"]) for r in text.clustal_to_sequences(aln).collect()} == {("a_1", "MK-V"), ("b", "MKLW")}


def test_predictor_outputs(spark):
    df = lambda rows, schema="id string, value string": spark.createDataFrame(rows, schema)
    masked = df([("a", "xxNNxNx"), ("b", "NN"), ("c", "")], "id string, sequence string")
    assert sorted((r["id"], r["start"], r["stop"]) for r in predictors.runs(masked, "x", "coils").collect()) == [("a", 1, 2), ("a", 5, 5), ("a", 7, 7)]
    residues = df([("a", k, c) for k, c in enumerate("**..*.*")], "id string, pos int, mark string")
    assert sorted((r["start"], r["stop"]) for r in predictors.islands(residues).collect()) == [(0, 2), (4, 5)]
    assert [(r["start"], r["stop"]) for r in predictors.transmembrane(df([("a", "%pred NB(0): o 1 6, M 7 29, i 30 40, M 41 60"), ("a", "x")])).collect()] == [(7, 29), (41, 60)]
    assert [(r["id"], r["stop"]) for r in predictors.signal_peptides(df([("", "# h"), ("", "p1 0.1 2 0.1 23 0.1 1 0.1 0.1 Y 0.4 net"), ("", "p2 0.1 2 0.1 23 0.1 1 0.1 0.1 N 0.4 net")])).collect()] == [("p1", 22)]
    assert [(r["start"], r["stop"]) for r in predictors.low_complexity(df([("a", " abc 10-20"), ("a", "MKL")])).collect()] == [(10, 20)]
    flps = predictors.biased_regions(df([("", "p\tx\tSINGLE\t1\t5\t30\t8\t1e-6\t{Q}"), ("", "p\tWHOLE\t1\t2\t9\t8\t1e-5\t{A}")]), 0.001).collect()
    assert {(r["feature"], r["start"], r["stop"]) for r in flps} == {("flps_SINGLE_{Q}", 5, 30), ("flps_WHOLE_{A}", 2, 9)}
    report = """Query:       prot1  [L=120]
Scores for complete sequences:
    1.2e-30  100.1   0.1    2e-20   90.0   0.1    1.2  1  Dom1   text
    0.5      10.0    0.1    2e-20   90.0   0.1    1.2  1  Dom2   text
Domain annotation for each model:
>> Dom1  text
   1 !   50.5   0.1   1e-20   2e-18       3      40 ..       5      44 ..       4      45 .. 0.95
   2 ?    1.5   0.1   0.5     0.7         3      40 ..      55      74 ..      54      75 .. 0.95
>> Dom2  text
   1 !   50.5   0.1   1e-20   2e-18       3      40 ..       5      44 ..       4      45 .. 0.95
"""
    rows = predictors.profile_hits(spark.createDataFrame([(report,), ("",)], "value string"), "pfam", 0.001, 0.01).collect()
    assert [(r["id"], r["length"], r["feature"], r["start"], r["stop"], r["bit_score"], r["hmm_from"], r["hmm_to"]) for r in rows] == [("prot1", 120, "pfam_Dom1", 4, 45, 50.5, 3, 40)]


def test_reports(spark, tmp_path):
    s = spark.createDataFrame([("a", "b", "exhaustive/exhaustive", 0.5, None)], "seed string, query string, mode string, fwd_final double, rev_final double")
    full = s.selectExpr("*", *[f"fwd_final as fwd_{k}" for k in ("ms", "ps", "cs", "ls")], *[f"rev_final as rev_{k}" for k in ("ms", "ps", "cs", "ls")])
    assert tuple(reports.score_table(full).first()) == ("a", "b", "0.5/NA", "0.5/NA", "0.5/NA", "0.5/NA", "0.5/NA", "exhaustive/exhaustive")
    assert reports.score_json(s).first()[0] == '{"a_b":["0.5","NA"]}'
    reports.write_score_table(full, str(tmp_path / "t"))
    reports.write_run_record(spark, str(tmp_path / "r"), {"b": 1, "a": 2}, "run", "1")
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["command: run", "version: 1", "a: 2", "b: 1"]
    d = spark.createDataFrame([("x#y", 1), ("z#y", 2)], "pair_id string, start int")
    reports.write_split_domains(d, str(tmp_path / "d"))
    assert {x for x in os.listdir(tmp_path / "d") if x.startswith("seed")} == {"seed_id=x", "seed_id=z"}
    assert reports.parse_weight_file('{"weights": {"f": 1}}') == ({"f": 1.0}, 0.5)
    with pytest.raises(Exception, match="no taxon"):
        reports.phylogenetic_profile(s, spark.createDataFrame([], "protein_id string, ncbi_id string")).collect()


def test_maintenance_errors(spark):
    _, inst = arch(spark, {"p": [A1]})
    both = inst.selectExpr("*", "'a' as proteome").union(inst.selectExpr("*", "'b' as proteome"))
    with pytest.raises(Exception, match="more than one proteome"):
        M.merge_annotations(both).collect()
    with pytest.raises(Exception, match="unknown protein"):
        M.check_ids(spark.createDataFrame([("q",)], "protein_id string"), inst).collect()
    mixed = spark.createDataFrame([("g", "t1", "a", 0), ("g", "t2", "b", 1), ("h", "t2", "b", 2), ("h", "t1", "c", 3)], "grp string, taxon string, protein_id string, pos long")
    assert {(r["seed"], r["query"]) for r in M.ortholog_groups(mixed).collect()} == {("a", "b"), ("b", "c")}
    with pytest.raises(Exception, match="more than one taxon"):
        M.ortholog_groups(mixed, True).collect()


DOC = {
    "feature": {
        "p1": {"length": 100, "pfam": {"pfam_A": {"evalue": 1e-9, "instance": [[1, 10, 1e-5, 30.0, 1, 10]]}}, "tmhmm": {"tmhmm_transmembrane": {"evalue": "NA", "instance": [[50, 70, "NA"]]}}},
        "p2": {"length": 100, "pfam": {"pfam_A": {"evalue": 1e-9, "instance": [[1, 10, 1e-5]]}, "pfam_B": {"evalue": 0.5, "instance": [[1, 10, 1e-5]]}}, "tmhmm": {}},
        "p3": {"length": 50, "pfam": {}, "tmhmm": {}},
    },
    "clan": {"pfam_A": "CL1"},
    "interproID": {"pfam_A": "PF00001.3"},
    "length": {"pfam_A": "33"},
    "version": {"pfam": {"version": "35"}},
}


def test_commands_end_to_end(spark, tmp_path):
    from quiltspan.__main__ import COMMANDS, main

    (tmp_path / "a.json").write_text(json.dumps(DOC))
    (tmp_path / "tools.txt").write_text("#linearized\npfam\n#normal\ntmhmm\n#checked\n")
    (tmp_path / "pairs.tsv").write_text("p1\tp2\np1\tp3\n")
    (tmp_path / "ids.txt").write_text(">p1\nnone\n")
    (tmp_path / "four.txt").write_text("p1 t1 p2 t2\nbad line\np1 t1 gone t9\n")
    (tmp_path / "x.fa").write_text(">p1\nMK\n>p9\nMK\n")
    (tmp_path / "g.fa").write_text(">g1|t1|p1|1\nMK\n>g1|t2|p2|1\nMK\n")
    (tmp_path / "map.tsv").write_text("p2\tncbi2\np3\tncbi3\n")
    t = lambda *x: [str(tmp_path / y) if y in os.listdir(tmp_path) or y.startswith("out") else y for y in x]
    base = ("--tools", "tools.txt")
    main(t("score", "--seeds", "a.json", "--queries", "a.json", "--pairs", "pairs.tsv", "--reference", "a.json", "--mapping", "map.tsv", "--out", "out1", *base))
    rows = {(r["seed"], r["query"]): r for r in spark.read.parquet(str(tmp_path / "out1/scores")).collect()}
    assert set(rows) == {("p1", "p2"), ("p1", "p3")} and rows["p1", "p3"]["fwd_final"] == 0 and 0 < rows["p1", "p2"]["fwd_final"] < 1 and rows["p1", "p2"]["rev_final"] == 1.0
    dom = spark.read.csv(str(tmp_path / "out1/domains_forward"), sep="\t", header=True).where("pair_id = 'p1#p2'").collect()
    assert {(r["ortholog"], r["feature"], r["path"]) for r in dom} == {("p1", "pfam_A", "Y"), ("p1", "tmhmm_transmembrane", "Y"), ("p2", "pfam_A", "Y"), ("p2", "pfam_B", "N")}
    assert {r["interpro"] for r in dom if r["feature"] == "pfam_A"} == {"PF00001"}
    assert spark.read.csv(str(tmp_path / "out1/phylogenetic_profile"), sep="\t", header=True).count() == 2
    back = text.read_score_table(spark, str(tmp_path / "out1/scores_tsv")).where("query = 'p2'").first()
    assert back["rev_final"] == 1.0
    main(t("distance", "--seeds", "a.json", "--queries", "a.json", "--out", "out2", "--no-domains", *base))
    assert spark.read.parquet(str(tmp_path / "out2/scores")).count() == 9
    main(t("taxa", "--annotations", "a.json", "--pairs", "four.txt", "--out", "out3", *base))
    assert spark.read.parquet(str(tmp_path / "out3/scores")).count() == 1 and spark.read.json(str(tmp_path / "out3/missing")).first()["taxon"] == "t9"
    main(t("groups", "--annotations", "a.json", "--fasta", "g.fa", "--out", "out4", *base))
    assert spark.read.parquet(str(tmp_path / "out4/scores")).first()["query"] == "p2"
    main(t("extract", "--annotations", "a.json", "--ids", "ids.txt", "--name", "sub", "--out", "out5", *base))
    assert [r[0] for r in spark.read.csv(str(tmp_path / "out5/missing")).collect()] == ["none"]
    main(t("find", "--annotations", "a.json", "--features", "pfam_a,pfam_b", "--every", "--out", "out6", *base))
    assert [r[0] for r in spark.read.csv(str(tmp_path / "out6/proteins")).collect()] == ["p2"]
    for k, x in enumerate((("merge", "--annotations", "a.json", "--name", "m"), ("update", "--annotations", "a.json", "--new", "a.json", "--name", "u"), ("complexity", "--annotations", "a.json"), ("domains", "--annotations", "a.json", "--ids", "ids.txt", "--group", "G"), ("versions", "--annotations", "a.json"), ("overlaps", "--annotations", "a.json", "--pair-of-tools", "pfam,tmhmm"), ("check", "--annotations", "a.json", "--fasta", "x.fa", "--name", "c")), 10):
        main(t(*x, "--out", f"out{k}", *base))
    assert [r[0] for r in spark.read.csv(str(tmp_path / "out16/missing")).collect()] == ["p9"]
    for k, name in ((5, "sub"), (10, "m"), (11, "u")):
        found = json.loads((tmp_path / f"out{k}" / "annotation" / f"{name}.json").read_text())
        assert set(found) == {"feature", "clan", "interproID", "length", "count", "version"} and set(found["feature"]) == ({"p1"} if k == 5 else {"p1", "p2", "p3"})
    profile = spark.read.csv(str(tmp_path / "out4/phylogenetic_profile"), sep="\t", header=True).collect()
    assert [(r["geneID"], r["ncbiID"], r["orthoID"]) for r in profile] == [("g1", "ncbit2", "g1|t2|p2|1")]
    assert {r["pair_id"] for r in spark.read.csv(str(tmp_path / "out4/domains_forward"), sep="\t", header=True).collect()} == {"g1#g1|t2|p2"}
    main(["merge-scores", "--scores", f"{tmp_path}/out1/scores,{tmp_path}/out2/scores", "--out", str(tmp_path / "out20")])
    assert spark.read.parquet(str(tmp_path / "out20")).count() == 6
    main(["scores-to-json", "--scores", str(tmp_path / "out1/scores_tsv"), "--out", str(tmp_path / "out21")])
    main(["split-domains", "--domains", str(tmp_path / "out1/domains_forward"), "--out", str(tmp_path / "out22")])
    assert "seed_id=p1" in os.listdir(tmp_path / "out22") and len(COMMANDS) >= 20
    with pytest.raises(Exception, match="unknown protein"):
        (tmp_path / "bad.tsv").write_text("p1\tnobody\n")
        main(t("score", "--seeds", "a.json", "--queries", "a.json", "--pairs", "bad.tsv", "--out", "out30", *base))


def test_annotate_and_score(spark, tmp_path):
    """From predictors' outputs to a document, its completion and check, and scores from it."""
    from quiltspan.__main__ import main

    put = lambda name, value: (tmp_path / name).write_text(value) and str(tmp_path / name)
    fasta = put("x.fa", ">p1 one\nMKLV\n>p2\nMMKK\n>p3\nAA\n")
    tools = put("tools.txt", "#linearized\npfam\n#normal\ncoils\ntmhmm\n#checked\n")
    report = """Query:       p1  [L=120]
    1.2e-30  100.1   0.1    2e-20   90.0   0.1    1.2  1  Dom1   text
Domain annotation for each model:
>> Dom1  text
   1 !   50.5   0.1   1e-20   2e-18       3      40 ..       5      44 ..       4      45 .. 0.95
//
"""
    pfam = put("pfam.out", report + report.replace("p1", "p2").replace("120", "90"))
    coils, tmhmm = put("coils.fa", ">p1\nNNxx\n>p2\nxNNN\n>p3\nNN\n"), put("tmhmm.txt", "p2\t%pred NB(0): o 1 1, M 2 3\n")
    families = put("fam.dat", "#=GF ID   Dom1\n#=GF AC   PF001.3\n#=GF CL   CL9\n#=GF ML   55\n//\n")
    lengths, versions = put("len.txt", "pfam_Dom1 77\n"), put("versions.json", '{"pfam": {"version": "35"}}')
    out = lambda k: str(tmp_path / f"out{k}")
    known = ("--families", families, "--lengths", lengths, "--versions", versions, "--tools", tools)
    main(["annotate", "--fasta", fasta, "--hits", f"pfam={pfam},coils={coils},tmhmm={tmhmm}", "--name", "tax", "--out", out(1), *known])
    path = out(1) + "/annotation/tax.json"
    doc = json.loads(open(path).read())
    assert doc["feature"]["p1"]["pfam"] == {"pfam_Dom1": {"evalue": 1.2e-30, "instance": [[4, 45, 1e-20, 50.5, 3, 40]]}} and doc["feature"]["p3"] == {"length": 2, "coils": {}, "pfam": {}, "tmhmm": {}}
    assert (doc["clan"], doc["interproID"], doc["length"], doc["version"]) == ({"pfam_Dom1": "CL9"}, {"pfam_Dom1": "PF001.3"}, {"pfam_Dom1": 77}, {"pfam": {"version": "35"}})
    main(["score", "--seeds", path, "--queries", path, "--tools", tools, "--out", out(2)])
    rows = {(r["seed"], r["query"]): r["fwd_final"] for r in spark.read.parquet(out(2) + "/scores").collect()}
    assert len(rows) == 9 and rows["p1", "p1"] == 1.0 and 0 < rows["p1", "p2"] < 1 and rows["p1", "p3"] == 0
    old = {k: v for k, v in doc.items() if k not in ("interproID", "version", "length")}
    old["feature"] = {k: v for k, v in old["feature"].items() if k != "p3"}
    bare = put("bare.json", json.dumps(old))
    newer = put("newer.json", '{"pfam": {"version": "36"}}')
    main(["add-information", "--annotations", bare, "--name", "full", "--out", out(3), *known])
    full = json.loads(open(out(3) + "/annotation/full.json").read())
    assert all(full[k] == doc[k] for k in ("interproID", "version", "length", "clan", "count"))
    main(["check", "--annotations", path, "--fasta", fasta, "--name", "c", "--out", out(4), "--versions", newer])
    assert [tuple(r) for r in spark.read.csv(out(4) + "/outdated", header=True).collect()] == [("pfam", "version", "35", "36")]
    main(["check", "--annotations", bare, "--fasta", fasta, "--name", "c", "--out", out(5), "--new", path])
    assert [r[0] for r in spark.read.csv(out(5) + "/missing").collect()] == ["p3"] and {r[0] for r in spark.read.csv(out(5) + "/lacking").collect()} == {"accessions", "versions", "lengths"}
    assert set(json.loads(open(out(5) + "/annotation/c.json").read())["feature"]) == {"p1", "p2", "p3"}
    table = put("ipr.tsv", "p1\tmd5\t120\tPfam\tPF001\tx\t4\t45\t1e-9\tT\tdate\tIPR7\n")
    main(["parse-interpro", "--table", table, "--fasta", fasta, "--name", "i", "--out", out(6), *known])
    i = json.loads(open(out(6) + "/annotation/i.json").read())
    assert i["feature"]["p1"]["pfam"] == {"pfam_Dom1": {"evalue": "NA", "instance": [[4, 45, 1e-9]]}} and i["interproID"] == {"pfam_Dom1": "IPR7"} and i["feature"]["p2"]["pfam"] == {}
    residues = put("res.tsv", "".join(f"a\t{k}\t{c}\n" for k, c in enumerate("**..*.")) + "b\t0\t\n")
    main(["disorder", "--residues", residues, "--name", "d", "--out", out(7)])
    d = json.loads(open(out(7) + "/annotation/d.json").read())
    assert d["feature"] == {"a": {"length": 6, "aucpred": {"aucpred_disordered_region": {"evalue": "NA", "instance": [[0, 2, "NA"], [4, 5, "NA"]]}}}} and d["count"] == {"aucpred_disordered_region": 2}
    assert [r[0] for r in spark.read.csv(out(7) + "/failed").collect()] == ["b"]
    with pytest.raises(ValueError, match="missing in the annotation: smart"):
        main(["score", "--seeds", path, "--queries", path, "--tools", put("t2.txt", "#linearized\npfam\nsmart\n"), "--out", out(8)])


def test_streamed_pairs(spark, tmp_path):
    from quiltspan.streaming import incremental

    o = ScoringOptions()
    universe, inst = arch(spark, {"a": [A1], "b": [A1, B1], "c": [B1]})
    p = scoring.prepare(A.proteins(universe, inst, o), o)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.tsv").write_text("a\tb\nb\ta\nb\tc\n")
    run = lambda: incremental.score_new_pairs(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), p, o)
    run()
    (tmp_path / "in" / "2.tsv").write_text("c\tb\nc\ta\n")
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {frozenset((r["seed"], r["query"])) for r in rows} == {frozenset(x) for x in ("ab", "bc", "ac")} and len(rows) == 3


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def _cell(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType") or x != x:
        return "~"
    return f"{float(x):.8g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_registered_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    if name not in catalogue.ORACLES:
        assert name == "complexity" or len(got)
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [sorted(tuple(map(_cell, r)) for r in x[cols].itertuples(index=False)) for x in (got, want)]
    assert rows[0] == rows[1]


def test_entry_without_the_training_data_subpackage(tmp_path):
    """A copy without the subpackage and its pipeline still imports, and has the engine's queries and no others."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quiltspan", tmp_path / "quiltspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    say = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.splitlines()[-2:]
    assert [x.split() for x in out] == [sorted(catalogue.QUERIES), sorted(catalogue.ORACLES)]
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_storage_is_cleared(spark):
    from quiltspan import storage

    kept = storage.cut(spark.range(5), "x")
    folder = f"{storage.shared_dir(spark).removeprefix('file://')}/{spark.sparkContext.applicationId}"
    assert kept.count() == 5 and os.listdir(folder)
    storage.clear(spark)
    assert not os.path.exists(folder) and storage.cut(spark.range(3), "x").count() == 3


# annotation documents


def _document(spark, name, rows, lengths, clans=(), versions=(("pfam", {"v": "1"}),)):
    from quiltspan.operators import documents as D

    inst = D.completed(spark.createDataFrame(rows, "protein_id string, tool string, feature string, start int, stop int, evalue double"))
    proteins = spark.createDataFrame(lengths, "protein_id string, length int")
    t = lambda x, c: spark.createDataFrame(list(x), f"feature string, {c}")
    return D.Document(inst, proteins, t(clans, "clan string"), t([], "interpro string"), t([], "plen int"), spark.createDataFrame(list(versions), "tool string, info map<string,string>"), D.counted(inst))


def test_documents_round_trip(spark, tmp_path):
    from quiltspan.operators import documents as D

    rows = [(f"p{k % 7}", "pfam", f'pfam_{"AB"[k % 2]}"x', 3 * k + 1, 3 * k + 9, None if k % 3 else 0.25 * k) for k in range(30)] + [("p1", "tmhmm", "tmhmm_t", 5, 6, None)]
    doc = _document(spark, "x", rows, [(f"p{k}", 100 + k) for k in range(8)], [('pfam_A"x', "CL1"), ("pfam_none", "CL2")])
    for n, files in ((100, 1), (3, 3)):
        D.write(doc, str(tmp_path / f"d{n}"), "tax", ["pfam", "smart"], n)
        names = sorted(f.name for f in (tmp_path / f"d{n}").iterdir() if f.suffix == ".json")
        assert names == (["tax.json"] if files == 1 else names) and 1 <= len(names) <= files
        whole = [json.loads((tmp_path / f"d{n}" / f).read_text()) for f in names]
        assert {p for d in whole for p in d["feature"]} == {f"p{k}" for k in range(8)}
        assert all({"length", "pfam", "smart"} <= set(x) for d in whole for x in d["feature"].values())
        assert sum(v for d in whole for v in d["count"].values()) == 31 and whole[0]["version"] == {"pfam": {"v": "1"}}
        back = D.read(spark, str(tmp_path / f"d{n}" / "*.json"))
        key = lambda x: sorted(map(str, x.select("protein_id", "tool", "feature", "start", "stop", "evalue").collect()))
        assert key(back.instances) == key(doc.instances)
        assert {(r[0], r[1]) for r in back.clans.collect()} == {('pfam_A"x', "CL1")}
        assert {tuple(r) for r in back.counts.collect()} == {tuple(r) for r in D.counted(doc.instances).collect()}
        assert D.lacking(back) == ["accessions", "lengths"]


def test_documents_built_merged_updated(spark, tmp_path):
    from quiltspan.operators import documents as D

    hits = spark.createDataFrame([("a", "pfam_F1", 0.001, 1, 9, 0.002, 5.5, 1, 8)], "id string, feature string, feature_evalue double, start int, stop int, evalue double, bit_score double, hmm_from int, hmm_to int")
    coils = predictors.runs(spark.createDataFrame([("a", "NNxx"), ("b", "N")], "id string, sequence string"), "x", "coils_coiled_coil")
    fasta = spark.createDataFrame([("a", 4), ("b", 1)], "id string, length int")
    families = spark.createDataFrame([("F1", "PF1.2", "CL7"), ("F2", "PF2.1", "NA")], "id string, accession string, clan string")
    plens = spark.createDataFrame([("pfam_F1", 50)], "feature string, plen int")
    versions = spark.createDataFrame([("pfam", {"v": "3"})], "tool string, info map<string,string>")
    doc = D.build([hits, coils], fasta, families, plens, versions)
    D.write(doc, str(tmp_path / "a"), "a", ["pfam", "coils"])
    back = json.loads((tmp_path / "a" / "a.json").read_text())
    assert back["feature"]["b"] == {"length": 1, "coils": {}, "pfam": {}}
    assert back["feature"]["a"]["pfam"] == {"pfam_F1": {"evalue": 0.001, "instance": [[1, 9, 0.002, 5.5, 1, 8]]}}
    assert back["feature"]["a"]["coils"] == {"coils_coiled_coil": {"evalue": "NA", "instance": [[3, 4, "NA"]]}}
    assert (back["clan"], back["interproID"], back["length"], back["count"]) == ({"pfam_F1": "CL7"}, {"pfam_F1": "PF1.2"}, {"pfam_F1": 50}, {"coils_coiled_coil": 1, "pfam_F1": 1})
    other = _document(spark, "y", [("c", "pfam", "pfam_F1", 2, 3, 0.5)], [("c", 9)], [("pfam_F1", "CL8")], [("pfam", {"v": "4"}), ("smart", {"v": "1"})])
    get = lambda df: {r[0]: r[1] for r in df.collect()}
    m = D.merge([doc, other])
    assert get(m.clans) == {"pfam_F1": "CL8"} and get(m.versions) == {"pfam": {"v": "3"}, "smart": {"v": "1"}}
    assert get(m.counts) == {"pfam_F1": 2, "coils_coiled_coil": 1} and get(m.proteins) == {"a": 4, "b": 1, "c": 9}
    with pytest.raises(Exception, match="more than one"):
        D.merge([doc, doc]).proteins.collect()
    newer = _document(spark, "z", [("a", "pfam", "pfam_F2", 2, 3, 0.5)], [("a", 5)])
    u = D.update(doc, newer)
    assert get(u.proteins) == {"a": 5, "b": 1} and {r["feature"] for r in u.instances.collect()} == {"pfam_F2"}
    assert get(u.counts) == {"pfam_F1": 1, "coils_coiled_coil": 1, "pfam_F2": 1} and get(u.versions) == {"pfam": {"v": "1"}}
    full = D.add_information(_document(spark, "w", [("a", "pfam", "pfam_F1", 2, 3, 0.5)], [("a", 5)], versions=[]), families, plens, versions)
    assert D.lacking(full) == [] and get(full.accessions) == {"pfam_F1": "PF1.2"} and get(full.versions) == {"pfam": {"v": "3"}}
    assert [tuple(r) for r in D.check_versions(doc, spark.createDataFrame([("pfam", "v", "9")], "tool string, key string, value string")).collect()] == [("pfam", "v", "3", "9")]
    assert get(D.fill(doc, m).proteins) == {"a": 4, "b": 1, "c": 9} and get(D.extract(m, spark.createDataFrame([("c",)], "protein_id string")).counts) == {"pfam_F1": 1}
    assert [r[0] for r in D.require_tools(doc, ["pfam", "smart"]).collect()] == ["smart"]
