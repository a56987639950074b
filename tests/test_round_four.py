"""Findings of round 4: batches without names, documents read and written without sending their text more than once, ends
that texts meet in several lists."""

import json
import random

import pyarrow as pa
import pytest

from quiltspan import storage
from quiltspan.llm import near_copies
from quiltspan.operators import documents as D
from quiltspan.options import ScoringOptions
from quiltspan.plans import path_pairs
from quiltspan.plans.path_scorer import tool_prefix
from quiltspan.sources import annotation


def test_constraints_on_a_batch_without_features():
    """Proteins without instances, and no weights, may be all that a batch holds."""
    kind = pa.struct([("feature", pa.list_(pa.string())), ("position", pa.list_(pa.float64())), ("start", pa.list_(pa.int32())), ("stop", pa.list_(pa.int32())), ("clan", pa.list_(pa.string()))])
    weights = pa.list_(pa.struct([("key", pa.string()), ("value", pa.float64())]))
    options = ScoringOptions(constraints={"pfam": 0.5})
    for n in (0, 2):
        proteins = pa.array([{c.name: [] for c in kind}] * n, kind)
        paths = pa.array([[[]]] * n, pa.list_(pa.list_(pa.int32())))
        got = path_pairs.best_pairs(proteins, paths, proteins, paths, pa.array([[]] * n, weights), options, False, tool_prefix)
        assert got.to_pylist() == [{"final": 0.0, "ms": 0.0, "ps": 0.0, "cs": 0.0, "ls": 0.0, "seed_path": [], "query_path": []}] * n


ODD = ['a"b', "c}d", "e{f", 'g\\"}h', "i\\\\", "plain", "{}", '"{"', "}}}}", "\\", '\\"feature": {', "ä}ö"]


def _odd_document(rng, n):
    feature = {}
    for k in range(n):
        tools = {"length": rng.randint(50, 900)}
        for tool in rng.sample(["pfam", "smart", "seg"], rng.randint(0, 3)):
            tools[tool] = {f"{tool}_{x}": {"evalue": 0.5, "instance": [[j + 1, j + 9, "NA"] for j in range(rng.choice([1, 2, 60]))]} for x in rng.sample(ODD, rng.randint(0, 3))}
        feature[f"p{k}{rng.choice(ODD)}"] = tools
    out = {"feature": feature, "clan": {f"pfam_{x}": f"C{x}" for x in ODD}, "interproID": {}, "length": {"pfam_x": "5"}, "version": {"pfam": {"version": "3}1"}, "seg": {"version": "NA"}}}
    more = {"made by": "}", "n": 5, "nothing": None, 'long "feature': {"x": {"y": 1}}, "": {"z": {"a": "}"}}}
    keys = list(out | more)
    rng.shuffle(keys)
    return {k: (out | more)[k] for k in keys}


@pytest.mark.parametrize("size", [37, 150, 900, 5_000])
def test_documents_in_splits_of_any_size(spark, tmp_path, size):
    """Entries, strings and names may lie across splits; sections come in any order, beside others."""
    rng = random.Random(size)
    for k, n in enumerate((0, 1, 5)):
        (tmp_path / f"d{k}-0000{k}.json").write_text(json.dumps(_odd_document(rng, n), indent=rng.choice([None, 1]), ensure_ascii=k == 0))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    columns = (annotation.instances, annotation.proteins, annotation.versions, *(lambda d, c=c: annotation.dimension_rows(d, c, "v") for c in ("clan", "interproID", "length", "count")))
    whole = annotation.read_documents(spark, str(tmp_path))
    want = [sorted(map(str, f(whole).collect())) for f in columns]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        parts = annotation.read_in_parts(spark, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(want[:4]) and [sorted(map(str, f(parts).collect())) for f in columns] == want


def test_documents_are_read_without_sending_their_text(spark, tmp_path):
    """Pieces of the text were sent four times and written three times before, and an entry was parsed four times."""
    (tmp_path / "d.json").write_text(json.dumps(_odd_document(random.Random(3), 40)))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{storage.shared_dir(spark)}/{spark.sparkContext.applicationId}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tables = lambda: {f.getPath().getName() for f in fs.listStatus(folder)} if fs.exists(folder) else set()
    there = tables()
    docs = annotation.read_in_parts(spark, str(tmp_path / "d.json"))
    assert sorted(t.rpartition("-")[0] for t in tables() - there) == ["document-entries", "document-splits"]
    # entries that lie in one split, those joined from parts, and tools' bodies
    assert annotation.instances(docs)._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 3


def test_lines_of_proteins_take_one_shuffle_of_the_instances(spark):
    rows = [("a", "smart", "smart_x", 0), ("a", "pfam", "pfam_z", 1), ("a", "smart", "smart_a", 2), ("a", "pfam", "pfam_z", 3), ("a", "smart", "smart_x", 4), ("b", "tmhmm", 'tm"x', 0)]
    inst = D.completed(spark.createDataFrame([(p, t, f, i, i + 1, i + 9) for p, t, f, i in rows], "protein_id string, tool string, feature string, i int, start int, stop int"))
    none = [spark.createDataFrame([], f"feature string, {c}") for c in ("clan string", "interpro string", "plen int")]
    proteins = spark.createDataFrame([("a", 10), ("b", None), ("c", 5)], "protein_id string, length int")
    doc = D.Document(inst, proteins, *none, spark.createDataFrame([], "tool string, info map<string,string>"), D.counted(inst))
    lines = D.protein_lines(doc, ["smart", "pfam"])
    assert lines._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") <= 2
    got = {r["protein_id"]: r["value"] for r in lines.collect()}
    one = lambda *x: '{"evalue":"NA","instance":[' + ",".join(f'[{k + 1},{k + 9},"NA"]' for k in x) + "]}"
    assert got["a"] == f'"a":{{"length":10,"smart":{{"smart_x":{one(0, 4)},"smart_a":{one(2)}}},"pfam":{{"pfam_z":{one(1, 3)}}}}}'
    assert got["b"] == f'"b":{{"length":null,"tmhmm":{{"tm\\"x":{one(0)}}},"pfam":{{}},"smart":{{}}}}'
    assert got["c"] == '"c":{"length":5,"pfam":{},"smart":{}}'


def test_an_end_met_in_several_lists_makes_one_pair(spark):
    """36 lists, each of all but one of 31 texts: a text made two rows in each list before."""
    rng = random.Random(4)
    lists = {rng.getrandbits(62): [x for x in range(1, 32) if x != k % 31 + 1] for k in range(36)}
    posts = spark.createDataFrame([(k, fp) for k, x in lists.items() for fp in x], "key long, fp long")
    want = set()
    for key, x in lists.items():
        ends = [f(x, key=lambda fp: fp ^ key) for f in (min, max)]
        want |= {(max(fp, e), min(fp, e)) for fp in x for e in ends if fp != e}
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: [x.executionId() for x in (store.executionsList().apply(k) for k in range(store.executionsList().size()))]
    pairs, long = near_copies.candidates(posts)
    before = max(listed(), default=-1)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and long.count() == posts.count()
    made = 0
    for number in (x for x in listed() if x > before):
        nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Generate" in node.name():
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made += int(values.apply(m.accumulatorId()).replace(",", ""))
    assert 0 < made <= 2 * len(want) < 2 * posts.count()
