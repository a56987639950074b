"""Annotation documents read in parts are those that are read whole."""

import json
import random

from quiltspan import api
from quiltspan.sources import annotation


def _document(rng, n):
    odd = ['a"b', "c}d", "e{f", 'g\\"}h', "i\\\\", "plain", "{}", '"{"']
    feature = {}
    for k in range(n):
        tools = {"length": rng.randint(50, 900)}
        for tool in rng.sample(["pfam", "smart", "seg"], rng.randint(0, 3)):
            names = rng.sample(odd, rng.randint(0, 3))
            tools[tool] = {f"{tool}_{x}": {"evalue": 0.01 * j, "instance": [[j + 1, j + 9, 0.5], [j + 20, j + 30, "NA"]]} for j, x in enumerate(names)}
        feature[f"p{k}{rng.choice(odd)}"] = tools
    return {"feature": feature, "clan": {f"pfam_{x}": f"C{k}}}" for k, x in enumerate(odd)}, "interproID": {}, "length": {"pfam_x": 5}, "count": {"pfam_x": 3}, "version": {"pfam": {"version": "3}1"}, "seg": {"version": "NA"}}}


def test_read_in_parts(spark, tmp_path):
    rng = random.Random(4)
    folder = tmp_path / "documents"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps(_document(rng, 60)))
    (folder / "two-00001.json").write_text(json.dumps(_document(rng, 20), indent=2) + "\n")
    (folder / "none.json").write_text('{"feature": {}, "clan": {}}')
    (folder / "empty.json").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        whole = annotation.read_documents(spark, str(folder))
        want = [sorted(map(str, f(whole).collect())) for f in (annotation.instances, annotation.proteins, annotation.versions)]
        want += [sorted(map(str, annotation.dimension_rows(whole, c, "v").collect())) for c in ("clan", "interproID", "length", "count")]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        parts = annotation.read_in_parts(spark, str(folder))
        got = [sorted(map(str, f(parts).collect())) for f in (annotation.instances, annotation.proteins, annotation.versions)]
        got += [sorted(map(str, annotation.dimension_rows(parts, c, "v").collect())) for c in ("clan", "interproID", "length", "count")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(want[:3]) and got == want


def test_load_in_parts(spark, tmp_path):
    (tmp_path / "tax.json").write_text(json.dumps(_document(random.Random(5), 30)))
    tools = [("pfam", True, 0), ("smart", True, 1), ("seg", False, 2)]
    whole, parts = (api.load(spark, [str(tmp_path / "tax.json")], tools, in_parts=p) for p in (False, True))
    for name in ("instances", "proteins", "clans"):
        columns = getattr(whole, name).columns
        a, b = (sorted(map(str, getattr(x, name).select(*columns).collect())) for x in (whole, parts))
        assert a and a == b, name
