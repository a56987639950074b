"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import connected_components, cut, table, text_batches

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Two fingerprints that differ in so many bits share at least 8 - DISTANCE of their 8 positional bytes.
MIN_SHARED = 8 - DISTANCE
_CHUNK = 65_536
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Four blocks of two positions; a key is two of the blocks, and of four blocks two bytes that differ spoil two at most.
KEYS = [(*a, *b) for a, b in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]
#: Lists of more members are posted anew under longer keys.
HOT_LIST = 1_000


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash; null or wordless text: 0. Bytes are split, so that only ASCII white space parts words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        shingles = words
    else:
        shingles = [b" ".join(x) for x in zip(words, words[1:], words[2:], strict=False)]
    n, ones = len(shingles), np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        part = shingles[k : k + _CHUNK]
        h = np.fromiter((xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return text_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that the edges (a, b) reach."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def tally(rests: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of places, a < b, of a posting list whose members share ``shared`` bytes and have the other bytes
    ``rests`` (n x m): those that share at least MIN_SHARED of all, and of these the ones at DISTANCE bits or fewer."""
    count = np.full((len(rests), len(rests)), shared, np.uint8)
    for column in rests.T:
        count += column[:, None] == column[None, :]
    a, b = np.nonzero(np.triu(count >= MIN_SHARED, 1))
    close = _POPCOUNT[rests[a] ^ rests[b]].sum(axis=1) <= DISTANCE
    return a[close], b[close]


def _pairs_of_two_bytes(rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs at DISTANCE bits or fewer among members that differ in two bytes alone (n x 2, each once): all of
    them share enough bytes, so that each is looked up under the 16 + 120 values within two bits of its own."""
    value = rests[:, 0].astype(np.int64) | rests[:, 1].astype(np.int64) << 8
    place = np.full(65_536, -1, np.int64)
    place[value] = np.arange(len(value))
    a, b = [], []
    for m in [1 << i for i in range(16)] + [(1 << i) | (1 << j) for i, j in combinations(range(16), 2)]:
        to = place[value ^ m]
        at = np.flatnonzero(to > np.arange(len(value)))
        a.append(at)
        b.append(to[at])
    return np.concatenate(a), np.concatenate(b)


def _keyed(positions: tuple[int, ...]) -> tuple[Column, Column]:
    """The bytes at ``positions`` of fp (the others zero), and the other ones."""
    mask = sum(0xFF << 8 * k for k in positions)
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.col("fp").bitwiseAND(F.lit(signed)), F.col("fp").bitwiseAND(F.lit(~signed))


def links(distinct: DataFrame, hot: int = HOT_LIST) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs at DISTANCE bits or fewer.

    ``distinct``: fp, each once. The index posts a fingerprint under the bytes at each of the six choices of four
    positions in KEYS: two bytes that differ leave one of them whole, so that each pair that shares six bytes meets in
    a list. There the shared positional bytes of each pair are tallied, pairs with fewer than MIN_SHARED go, and the
    bits of the others are compared. A list of more than ``hot`` members is not tallied but posted anew under each
    choice of two more positions, by which its pairs share six bytes for certain; such a list differs in two bytes,
    so that it has 65,536 members at most. What leaves a list is a forest, not all pairs.
    """

    def run(positions: list[tuple[int, ...]]):
        def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out_a, out_b = [], []
                for k, shared, rests in zip(*(batch.column(c) for c in ("k", "shared", "rests")), strict=True):
                    fixed = positions[k.as_py()]
                    members = np.asarray(rests.values, np.int64) | shared.as_py()
                    free = [p for p in range(8) if p not in fixed]
                    rest = members.view(np.uint8).reshape(-1, 8)[:, free]
                    a, b = tally(rest, len(fixed)) if len(members) <= hot else _pairs_of_two_bytes(rest)
                    root = _roots(len(members), a, b)
                    at = np.flatnonzero(root != np.arange(len(root)))
                    out_a.append(members[at])
                    out_b.append(members[root[at]])
                empty = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [empty])) for x in (out_a, out_b)], names=["a", "b"])

        return edges

    def posted(rows: DataFrame, keys: list[tuple[int, ...]], of: list[int] | None = None) -> DataFrame:
        """k (the key's number), shared, rest of each row under each key; ``of``: the first key's number each refines."""
        out = []
        for k, positions in enumerate(keys):
            key, rest = _keyed(positions)
            post = F.struct(F.lit(k).alias("k"), key.alias("shared"), rest.alias("rest"))
            out.append(post if of is None else F.when(F.col("first") == of[k], post))
        return rows.select(F.explode(F.array_compact(F.array(*out))).alias("p")).select("p.*")

    def lists(posts: DataFrame) -> DataFrame:
        return posts.groupBy("k", "shared").agg(F.collect_list("rest").alias("rests")).where(F.size("rests") > 1)

    # the distinct fingerprints are few bytes, but each posts six rows: dealt out anew by number, which stays as given
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    posts = posted(spread, KEYS)
    long = cut(posts.groupBy("k", "shared").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("k", "shared"), "hot-lists")
    schema = "a long, b long"
    out = lists(posts.join(long, ["k", "shared"], "left_anti")).mapInArrow(run(KEYS), schema)
    finer = [(n, tuple(sorted({*key, *more}))) for n, key in enumerate(KEYS) for more in combinations([p for p in range(8) if p not in key], 2)]
    hot_rows = posts.join(long, ["k", "shared"], "left_semi").select(F.col("k").alias("first"), F.col("shared").bitwiseOR(F.col("rest")).alias("fp"))
    again = posted(hot_rows, [key for _, key in finer], [n for n, _ in finer])
    return out.union(lists(again).mapInArrow(run([key for _, key in finer]), schema))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Equal fingerprints are one node, so that copies never meet as pairs; component_id is the smallest doc_id that
    links reach. Null, empty and wordless texts have fingerprint zero and link like any other. A null doc_id is never
    a component_id unless its component has no other. Rows that repeat a doc_id get a row each. Empty table: no rows.
    Other columns may have any names.
    """
    prints = cut(fingerprints(docs), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fp")))
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    comps = cut(linked, "linked")
    least = comps.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(comps.join(least, "root").select("fp", "component_id"), "known")
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
