"""F6 of round 3: the pipeline's near-dedup gets its groups from SimHashes and the index of their positional bytes."""

import random

import numpy as np
from quiltspan.llm import near_copies as nc


def _nodes(spark, sets):
    rows = []
    for k, s in enumerate(sets):
        bits, places = nc.simhashes(s)
        rows.append((k, bytearray(places.tobytes() + bits[:2].tobytes())))
    return spark.createDataFrame(rows, "fp long, print binary")


def test_simhashes_are_the_majority_of_the_shingles_bits():
    h = np.random.default_rng(3).integers(0, 2**64, 700, dtype=np.uint64)
    bits, places = nc.simhashes(h)
    for k in (0, 1, nc.SIMHASHES - 1):
        spread = [int(x) for x in nc._spread(h ^ nc._SALT[k])]
        sums = [sum(1 if x >> b & 1 else -1 for x in spread) for b in range(64)]
        assert int(bits[k]) == sum(1 << b for b in range(64) if sums[b] > 0)
        most = max(range(64), key=lambda b: (abs(sums[b]), -b))
        assert int(places[k]) == 2 * most + (sums[most] > 0)


def test_pairs_at_the_similarity_share_a_list_of_the_simhash_index(spark):
    rng = np.random.default_rng(4)
    sets, pairs = [], []
    for n in (9, 36, 90, 360) * 60:  # 8/9 of the shingles of each are in both: a similarity of 0.8
        h = np.unique(rng.integers(0, 2**64, 10 * n // 9, dtype=np.uint64))
        pairs.append((len(sets), len(sets) + 1))
        sets += [h[:n], h[len(h) - n :]]
    assert all(abs(nc.similarity(sets[a], sets[b]) - 0.8) < 0.03 for a, b in pairs)
    groups = {}
    for r in nc.posted(_nodes(spark, sets), len(sets)).collect():
        groups.setdefault(r["key"], set()).add(r["fp"])
    met = {tuple(sorted(g)) for g in groups.values()}
    assert len(met & set(pairs)) >= 0.99 * len(pairs) and len(met - set(pairs)) <= 2


def test_lists_too_long_to_tally_are_groups_as_they_are(spark):
    """Whatever the length at which lists are no longer tallied, near copies stay together."""
    rng = random.Random(5)
    base = [rng.randrange(2**64) for _ in range(200)]
    sets = [np.unique(np.array([rng.randrange(2**64) if rng.random() < 0.03 else x for x in base], np.uint64)) for _ in range(1_500)]
    nodes = _nodes(spark, sets)
    for tallied in (nc.TALLIED, 100):
        got = nc.posted(nodes, len(sets), tallied)
        pairs = got.join(got.withColumnRenamed("fp", "other"), "key").where("fp > other").select(nc.F.col("fp").alias("a"), nc.F.col("other").alias("b")).distinct()
        assert nc.connected_components(pairs).where("root = 0").count() == 1_500


def test_keys_of_many_texts_are_longer():
    assert nc.simhash_keys(nc.MANY).shape == (36, 2) and nc.simhash_keys(nc.MANY + 1).shape == (96, 3)


def _executions(spark):
    """The numbers of the session's SQL executions that Spark still lists."""
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [listed.apply(k).executionId() for k in range(listed.size())]


def _rows_of_joins(spark, by, executions):
    """Rows that inner joins by ``by`` have made in ``executions``."""
    store = spark._jsparkSession.sharedState().statusStore()
    made = 0
    for number in executions:
        nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and f"[{by}" in node.desc() and "Inner" in node.desc():
                for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        made += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return made


def test_overlapping_lists_become_one_where_that_compares_no_more(spark):
    rng = random.Random(8)
    close = [rng.sample(range(40), 25) for _ in range(20)]  # 20 lists of 25 among 40 texts: one
    chain = [range(k, k + 4) for k in range(100, 160, 3)]  # each shares a text with the next: as they are
    lists = [*close, *chain, range(200, 204)]
    rows = [(key, fp, min(x), len(x)) for key, x in enumerate(lists) for fp in x]
    given = spark.createDataFrame(rows, "key long, fp long, first long, n long")
    for most, sizes in ((1_000, [4] * 21 + [len(set().union(*close))]), (30, [4] * 21 + [25] * 20)):
        got = {}
        for r in nc.merged(given, most).collect():
            got.setdefault(r["key"], []).append(r["fp"])
        assert sorted(map(len, got.values())) == sorted(sizes)
        assert all(any(set(x) <= set(y) for y in got.values()) for x in lists)
    assert nc.merged(given.where("false")).count() == 0


def test_texts_of_many_lists_meet_their_shingles_a_few_times(spark):
    """Texts that share most lists of the index: the joins that give them their shingles make a few rows of each."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3_000)]
    base = [rng.choice(words) for _ in range(200)]
    texts = []
    for _ in range(300):  # some 0.75 between two of them
        t = list(base)
        for _ in range(3):
            t[rng.randrange(200)] = rng.choice(words)
        texts.append((len(texts), " ".join(t)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    before = max(_executions(spark), default=-1)
    assert 0 < nc.survivors(docs).count() < 300
    assert 0 < _rows_of_joins(spark, "fp", [k for k in _executions(spark) if k > before]) <= 5 * len(texts)
