"""F7, F15 and F19 to F22 of round 3: how pairs are dealt out, and what is sent for them."""

from pyspark.sql import functions as F
from quiltspan import api


def test_all_pairs_are_made_by_many_tasks(spark, tmp_path):
    """A small file of ids is one split; one task made all pairs before."""
    spark.range(300).withColumnRenamed("id", "protein_id").coalesce(1).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    by_task = api.all_pairs(ids, ids).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in by_task) == 90_000 and len(by_task) == 4 and max(r["count"] for r in by_task) < 45_000
    few = api.all_pairs(ids.where("protein_id < 3"), ids).groupBy(F.spark_partition_id()).count()
    assert few.count() > 1 and api.all_pairs(ids.where("false"), ids).count() == 0


KIND = "array<struct<i:int,feature:string,clan:string,linearized:boolean,position:double,start:int,stop:int>>"


def _proteins(spark):
    def e(i, feature, clan, start, stop):
        return {"i": i, "feature": feature, "clan": clan, "linearized": True, "position": (start + stop) / 800, "start": start, "stop": stop}

    rows = [(1, [e(0, "pfam_A", "CL", 1, 20), e(1, "pfam_B;,=", None, 10, 30), e(2, "pfam_A", "", 40, 50)], [e(3, "tmhmm", None, 5, 8)], [1, 1]), (2, [], [], [2, 2]), (3, [], [e(0, "x", None, 1, 1)], [3, 3])]
    return spark.createDataFrame(rows, f"protein_id long, lin {KIND}, normal {KIND}, mark array<long>")


def test_what_a_seed_carries_is_packed_and_comes_back(spark):
    from quiltspan.options import ScoringOptions
    from quiltspan.plans import linearise as L
    from quiltspan.plans import scoring

    p = L.with_paths(scoring._carried(L.with_predecessors(_proteins(spark), ScoringOptions())))
    packed = scoring._packed(p)
    assert {f.dataType.simpleString() for f in packed.schema if f.name in ("names", "paths")} == {"string"}
    instances, paths = scoring._unpacked("names", "position", "span", "paths")
    got = {r["protein_id"]: r for r in packed.select("protein_id", instances.alias("x"), paths.alias("paths")).collect()}
    for r in p.collect():
        x, y = r["instances"], got[r["protein_id"]]["x"]
        assert (x["feature"], x["position"], x["clan"], r["paths"]) == (y["feature"], y["position"], y["clan"], got[r["protein_id"]]["paths"])
        assert [b - a for a, b in zip(x["start"], x["stop"])] == [b - a for a, b in zip(y["start"], y["stop"])]


def test_prepared_proteins_are_not_sent_to_meet_pairs(spark):
    """They lie in buckets by protein; both sides were sent before."""
    from quiltspan.options import ScoringOptions
    from quiltspan.plans import scoring

    p = scoring.prepare(_proteins(spark), ScoringOptions())
    plan = p.groupBy("protein_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    pairs = spark.range(1, 4).selectExpr("id as seed", "id % 3 + 1 as query")
    assert scoring.score_pairs(pairs, p, p, ScoringOptions()).count() == 3
