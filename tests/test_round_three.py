"""Findings of round 3: halves in score files, documents written line by line, runs, comparisons of annotations."""

import json
import re

import duckdb

from quiltspan import catalogue
from quiltspan.functions.expressions import four_significant, half_up
from quiltspan.operators import documents as D
from quiltspan.operators import maintenance as M
from quiltspan.options import ScoringOptions
from quiltspan.plans import greedy
from quiltspan.sources import predictors


def test_four_significant_takes_halves_up(spark):
    """Shares such as 5/32 end in a fifth digit of 5; the SQL of the score files rounds them up."""
    values = [k / 32 for k in range(33)] + [k / 64 for k in range(1, 64)] + [1 / 3, 2 / 7, 0.1, 0.012345, 1e-4, 0.99995, 12.345, 123456.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(four_significant("x")).collect()]
    want = duckdb.execute(f"SELECT {catalogue._FOUR.format('x')} FROM (SELECT unnest(?) AS x)", [values[:-1]]).fetchall()
    assert got[:-1] == [w[0] for w in want]
    assert got[5] == "0.1563" and half_up(-0.15625, 4) == -0.1563 and half_up(2.5, 0) == 3.0


def _document(spark, n):
    rows = spark.range(n).selectExpr("cast(id as string) as protein_id", "'pfam' as tool", "concat('pfam_', id % 3) as feature", "0 as i", "1 as start", "9 as stop", "0.5D as evalue")
    rows = D.completed(rows)
    proteins = spark.range(n + 2).selectExpr("cast(id as string) as protein_id", "400 as length")
    clans = spark.createDataFrame([("pfam_0", 'C"1')], "feature string, clan string")
    none = spark.createDataFrame([], "feature string, interpro string"), spark.createDataFrame([], "feature string, plen int")
    versions = spark.createDataFrame([("pfam", {"version": "35"})], "tool string, info map<string,string>")
    return D.Document(rows, proteins, clans, *none, versions, D.counted(rows))


def test_a_document_is_written_line_by_line(spark, tmp_path):
    """No row holds more than a protein, whatever the size of the document; all lines together are the document."""
    doc = _document(spark, 300)
    lines = D.document_lines(doc, ["pfam", "smart"], 1).collect()
    assert len(lines) > 302 and max(len(r["value"]) for r in lines) < 200
    D.write(doc, str(tmp_path / "one"), "tax", ["pfam"], 1_000)
    whole = json.loads((tmp_path / "one" / "tax.json").read_text())
    assert len(whole["feature"]) == 302 and whole["feature"]["7"]["pfam"] == {"pfam_1": {"evalue": "NA", "instance": [[1, 9, 0.5]]}}
    assert whole["clan"] == {"pfam_0": 'C"1'} and whole["interproID"] == {} and whole["count"] == {f"pfam_{k}": 100 for k in range(3)} and whole["version"] == {"pfam": {"version": "35"}}
    D.write(doc, str(tmp_path / "many"), "tax", ["pfam"], 100)
    parts = [json.loads(p.read_text()) for p in sorted((tmp_path / "many").glob("tax-*.json"))]
    assert len(parts) == 4 and sorted(k for p in parts for k in p["feature"]) == sorted(whole["feature"])
    assert sum(p["count"].get("pfam_0", 0) for p in parts) == 100 and all(p["version"] for p in parts)


def test_runs_of_long_sequences(spark):
    """Many runs in one sequence: quadratic before, when their borders were appended to an array one by one."""
    long = "e." * 200_000
    rows = [(1, long), (2, ""), (3, None), (4, "eee"), (5, "\N{GRINNING FACE}ee.e"), (6, "...")]
    got = predictors.runs(spark.createDataFrame(rows, "id long, sequence string"), "e", "f")
    assert got.where("id = 1").selectExpr("count(*)", "sum(start)", "sum(stop - start)").first() == (200_000, 200_000**2, 0)
    assert sorted((r["id"], r["start"], r["stop"]) for r in got.where("id > 1").collect()) == [(4, 1, 3), (5, 2, 3), (5, 5, 5)]


def test_annotations_are_compared_but_not_joined_by(spark):
    """Contents are no key of a join, by which Spark would sort them."""
    rows = [("a", 0.5), ("b", 0.5), ("c", None), ("d", None), ("e", 0.25)]
    inst = spark.createDataFrame([(p, "pfam", "pfam_A", 1, 9, e) for p, e in rows], "protein_id string, tool string, feature string, start int, stop int, evalue double")
    pairs = spark.createDataFrame([(p, q) for p, _ in rows for q, _ in rows], "seed string, query string")
    out = M.identical_pairs(pairs, inst)
    assert sorted(map(tuple, out.collect())) == [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" in plan and not re.search(r"content#\d+ = ", plan)


def test_partial_scores_value_a_path_once(spark, monkeypatch):
    calls = []
    parts = greedy.partial_parts

    def counted(*args):
        calls.append(1)
        return parts(*args)

    element = {"i": 0, "feature": "pfam_A", "clan": "C", "linearized": True, "position": 0.2, "start": 1, "stop": 9}
    kind = "array<struct<i:int,feature:string,clan:string,linearized:boolean,position:double,start:int,stop:int>>"
    p = spark.createDataFrame([("a", [element], []), ("b", [element, element], [])], f"protein_id string, lin {kind}, normal {kind}")
    o = ScoringOptions(weight_multiplicity=0.6, weight_clan=0.2, weight_position=0.2)
    got = greedy.partial_scores(spark.createDataFrame([("a", "b")], "seed string, query string"), p, p, o).first()
    assert [round(got[c], 9) for c in ("ms", "ps", "cs", "final")] == [0.5, 1.0, 1.0, 0.7]
    monkeypatch.setattr(greedy, "partial_parts", counted)
    assert greedy.partial_score([element], [element], {"C": 1}, o) == 1.0 and len(calls) == 1


def test_folders_of_seeds_are_dealt_out_by_number(spark, tmp_path):
    """rows of many seeds are few bytes, but each seed is a folder; a seed of very many rows has several writers."""
    from quiltspan.operators import reports

    def written(rows, path, **limits):
        reports.write_split_domains(spark.createDataFrame(rows, "pair_id string, start int"), path, **limits)
        back = spark.read.option("sep", "\t").option("header", True).schema("pair_id string, start int, seed_id string").csv(path)
        got = back.select("pair_id", "start", "seed_id", "_metadata.file_name").collect()
        assert sorted((r["pair_id"], r["start"]) for r in got) == sorted(rows)
        assert all(r["pair_id"].split("#")[0] == r["seed_id"] for r in got)
        files = {}
        for r in got:
            files.setdefault(r["seed_id"], set()).add(r["file_name"].split("-")[1])
        return files

    files = written([(f"{k % 450}#{k}", k) for k in range(1_350)], str(tmp_path / "many"))
    assert len(files) == 450 and all(len(x) == 1 for x in files.values()) and len(set().union(*files.values())) >= 2
    files = written([("a#b", k) for k in range(500)] + [("c#d", 1), ("c#d", 1)], str(tmp_path / "long"), most=100)
    assert len(files["a"]) >= 2 and len(files["c"]) == 1
