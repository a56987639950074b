"""Score stores in buckets, keyed state of streamed pairs, and predictors of the user's."""

import os
import re

import pytest

from quiltspan.operators import documents, score_store
from quiltspan.operators.maintenance import update_scores
from quiltspan.options import ScoringOptions
from quiltspan.plans import architecture as A
from quiltspan.plans import scoring
from quiltspan.sources import user_predictors
from quiltspan.streaming import incremental


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_update_touches_its_own_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    old = spark.createDataFrame([(f"s{k}", f"q{k}", k / 10) for k in range(400)], "seed string, query string, final double")
    score_store.create(old, path, 64)
    before = files(path)
    new = spark.createDataFrame([("q7", "s7", 9.0), ("s8", "q8", 8.0), ("new", "pair", 1.0)], "seed string, query string, final double")
    assert score_store.missing(spark, path, new.select("seed", "query"), 64).collect()[0]["seed"] == "new"
    met = score_store.update(spark, path, new, 64)
    after = files(path)
    of = lambda fs: {f for f in fs if int(re.search(r"bucket=(\d+)", f)[1]) in met}
    assert 1 <= len(met) <= 3 and {f: t for f, t in before.items() if f not in of(before)} == {f: t for f, t in after.items() if f not in of(after)}
    got = sorted(tuple(r) for r in score_store.read(spark, path).select("seed", "query", "final").collect())
    assert got == sorted(tuple(r) for r in update_scores(old, new).collect()) and len(got) == 401
    assert score_store.update(spark, path, new, 64) == met  # again: the same
    assert sorted(tuple(r) for r in score_store.read(spark, path).select("seed", "query", "final").collect()) == got
    assert score_store.update(spark, path, new.limit(0), 64) == []


def test_streamed_pairs_are_known_by_state_not_by_the_table(spark, tmp_path):
    o = ScoringOptions()
    rows = [(p, 100, "pfam", True, "pfam_A", None, 0, 1, 20, 0.0) for p in "abcd"]
    inst = spark.createDataFrame(rows, "protein_id string, length int, tool string, linearized boolean, feature string, clan string, i int, start int, stop int, evalue double")
    p = scoring.prepare(A.proteins(inst.select("protein_id"), inst, o), o)
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def run(name, text):
        (source / name).write_text(text)
        incremental.score_new_pairs(spark, str(source), out, checkpoint, p, o)

    run("1.tsv", "b\ta\na\tb\nb\tc\nb\tc\n")
    first = {f for f in files(out)}
    run("2.tsv", "c\tb\nc\ta\nd\ta\n")
    rows = sorted((r["seed"], r["query"]) for r in spark.read.parquet(out).collect())
    assert rows == [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]
    assert first <= set(files(out))
    for f in files(out):  # the table may be moved away: the state still knows
        os.remove(f)
    run("3.tsv", "a\tc\nd\tb\n")
    assert [(r["seed"], r["query"]) for r in spark.read.parquet(out).collect()] == [("d", "b")]


def test_a_users_predictor_in_sql(spark):
    def charged(sequence):
        return [(m[0][0] * 2, m.start() + 1, m.end(), 0.001 * len(m[0])) for m in re.finditer("D{2,}|K{2,}", sequence)]

    user_predictors.register_predictor(spark, "charged_runs", "charge", charged)
    fasta = spark.createDataFrame([("p", "MDDDAKK", 7), ("q", "MAAA", 4), ("r", None, 0)], "id string, sequence string, length int")
    fasta.createOrReplaceTempView("user_fasta")
    rows = spark.sql("SELECT id AS protein_id, p.* FROM user_fasta, LATERAL charged_runs(sequence) AS p")
    got = sorted((r["protein_id"], r["feature"], r["start"], r["stop"], r["evalue"]) for r in rows.collect())
    assert got == [("p", "charge_DD", 2, 4, 0.003), ("p", "charge_KK", 6, 7, 0.002)]
    none = spark.createDataFrame([], "id string, accession string, accession_base string, clan string, length int")
    versions = spark.createDataFrame([], "tool string, key string, value string")
    doc = documents.build([rows], fasta.where("sequence is not null"), none, spark.createDataFrame([], "feature string, plen int"), versions)
    assert {r["feature"]: r["n"] for r in doc.counts.collect()} == {"charge_DD": 1, "charge_KK": 1}
    assert sorted(r["protein_id"] for r in doc.proteins.collect()) == ["p", "q"]
    user_predictors.register_predictor(spark, "beyond", "x", lambda s: [("f", 1, len(s) + 1)])
    with pytest.raises(Exception, match="beyond"):
        spark.sql("SELECT p.* FROM user_fasta, LATERAL beyond(sequence) AS p").collect()


def test_one_tool_redone(spark):
    """The redone tool's instances are the new ones, the others stay; proteins that the old document lacks stay out."""
    none = spark.createDataFrame([], "id string, accession string, accession_base string, clan string, length int")
    lengths = spark.createDataFrame([], "feature string, plen int")
    fasta = lambda ids: spark.createDataFrame([(p, 50) for p in ids], "id string, length int")
    hits = lambda rows: spark.createDataFrame(rows, "protein_id string, feature string, start int, stop int")
    version = lambda v: spark.createDataFrame([(t, {"version": v}) for t in ("seg", "coils")], "tool string, info map<string,string>")
    old = documents.build([hits([("p", "seg_low", 1, 5), ("p", "coils_c", 7, 9), ("q", "seg_low", 2, 3)])], fasta("pq"), none, lengths, version("1"))
    new = documents.build([hits([("p", "seg_low", 10, 15), ("p", "coils_c", 30, 31), ("z", "seg_low", 1, 2)])], fasta("pz"), none, lengths, version("2"))
    doc = documents.redo(old, new, "seg")
    assert sorted((r["protein_id"], r["feature"], r["start"]) for r in doc.instances.collect()) == [("p", "coils_c", 7), ("p", "seg_low", 10)]
    assert {r["feature"]: r["n"] for r in doc.counts.collect()} == {"seg_low": 1, "coils_c": 1}
    assert {r["tool"]: r["info"]["version"] for r in doc.versions.collect()} == {"seg": "2", "coils": "1"}
    assert sorted(r["protein_id"] for r in doc.proteins.collect()) == ["p", "q"]
