"""Ranked lexical search: dual-sorted wavelet trees per shard, and best-first search of their nodes for exact top k."""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_batches

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII; A-Z alone are lower-cased. In UTF-8 the
#: other characters are single bytes, so that they can be made blanks and A-Z small in one table.
_TABLE = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
#: A shard ends at so many postings or documents; one document may exceed the former.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 13
#: Queries go to the shards in blocks of so many, or of so many terms together.
BLOCK_QUERIES, BLOCK_TERMS = 2_000, 200_000
#: Nodes that are opened together, the most promising first.
_FRONT = 128
INDEX = "doc_ids binary, null_ids binary, terms array<string>, starts binary, impacts binary, bits array<binary>"


def terms_of(text: bytes | str | None) -> list[bytes]:
    """The terms of a text, given as UTF-8 or not, in UTF-8, whose order is that of the code points."""
    utf8 = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return utf8.translate(_TABLE).split()


def _utf8(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


class WaveletTree:
    """The documents of a shard's posting lists, one list after the other, each list by falling impact.

    A level holds one bit of each posting's document number, from the highest on; those with a zero go to the left
    child of their node, the others to the right one, and both keep their order. So a node stands for a range of
    document numbers, a list's part of a node is an interval, and its first posting has the highest impact of the list
    in that range. Levels are whole arrays (all left children first): ``zeros[l][i]`` counts the zeros before i.
    """

    def __init__(self, impacts: np.ndarray, bits: list[np.ndarray]):
        self.depth, self.n = len(bits), len(impacts)
        self.zeros = np.zeros((self.depth, self.n + 1), np.int32)
        self.impacts = np.empty((self.depth + 1, self.n), np.int32)
        self.impacts[0] = impacts
        for level, one in enumerate(bits):
            np.cumsum(one == 0, out=self.zeros[level, 1:])
            left = one == 0
            self.impacts[level + 1] = np.concatenate([self.impacts[level][left], self.impacts[level][~left]])

    @staticmethod
    def build(docs: np.ndarray, depth: int) -> list[np.ndarray]:
        """The bits of each level for the documents in list order."""
        out = []
        for level in range(depth):
            one = ((docs >> (depth - 1 - level)) & 1).astype(np.uint8)
            out.append(one)
            docs = np.concatenate([docs[one == 0], docs[one == 1]])
        return out

    def top(self, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k best by the sum of weight * impact over the lists starts .. ends, equal ones by
        document number, scores above 0 alone.

        A node's bound is what a document with the highest impact of each list would score. Nodes are opened from the
        highest bound on, the front's best together; a leaf's bound is its document's score. Once k documents are
        known, nodes whose bound is below the k-th score go, and those that equal it and begin after its document.
        """
        level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        left, right = starts[None, :].astype(np.int64), ends[None, :].astype(np.int64)
        bound = self._bounds(level, left, right, weights)
        keep = bound > 0
        level, first, left, right, bound = level[keep], first[keep], left[keep], right[keep], bound[keep]
        best: list[tuple[int, int]] = []  # (-score, document)
        if self.depth == 0:
            return [(int(b), 0) for b in bound]
        ones_from = self.zeros[:, -1].astype(np.int64)
        while len(bound):
            if len(best) == k:
                score, doc = -best[-1][0], best[-1][1]
                alive = (bound > score) | ((bound == score) & (first < doc))
                level, first, left, right, bound = level[alive], first[alive], left[alive], right[alive], bound[alive]
                if not len(bound):
                    break
            if len(bound) > _FRONT:
                chosen = np.zeros(len(bound), bool)
                chosen[np.argpartition(-bound, _FRONT)[:_FRONT]] = True
            else:
                chosen = np.ones(len(bound), bool)
            lv, f, lo, hi = level[chosen], first[chosen], left[chosen], right[chosen]
            flat = self.zeros.ravel()
            base = (lv * (self.n + 1))[:, None]
            zlo, zhi = flat[base + lo].astype(np.int64), flat[base + hi].astype(np.int64)
            shift = ones_from[lv][:, None]
            width = np.int64(1) << (self.depth - 1 - lv)
            new = (np.concatenate([lv, lv]) + 1, np.concatenate([f, f + width]), np.concatenate([zlo, shift + lo - zlo]), np.concatenate([zhi, shift + hi - zhi]))
            scores = self._bounds(new[0], new[2], new[3], weights)
            leaf = new[0] == self.depth
            full = leaf & (scores > 0)
            if full.any():
                best = sorted([*best, *zip((-scores[full]).tolist(), new[1][full].tolist(), strict=True)])[:k]
            inner = ~leaf & (scores > 0)
            rest = ~chosen
            level, first, left, right, bound = (np.concatenate([old[rest], x[inner]]) for old, x in zip((level, first, left, right, bound), (*new, scores), strict=True))
        return [(-s, d) for s, d in best]

    def _bounds(self, level: np.ndarray, left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> np.ndarray:
        there = left < right
        at = np.where(there, (level * self.n)[:, None] + left, 0)
        return (np.where(there, self.impacts.ravel()[at], 0).astype(np.int64) * weights[None, :]).sum(axis=1)


class _Shard:
    """Postings of the documents of a shard, as they come."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.term, self.tf, self.doc = array("i"), array("i"), array("i")

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms_of(text)
        if not found:
            return
        counts = Counter(found)
        number = self.terms
        self.term.extend([number.setdefault(t, len(number)) for t in counts])
        self.tf.extend(counts.values())
        self.doc.extend([len(self.ids)] * len(counts))
        self.ids.append(doc_id)
        self.lengths.append(len(found))

    def full(self) -> bool:
        return len(self.term) >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCS

    def row(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        """The shard's row of the index: documents numbered by doc_id (null last), terms in order."""
        by_id = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0, i))
        number = np.empty(len(by_id), np.int64)
        number[by_id] = np.arange(len(by_id))
        doc = number[np.frombuffer(self.doc, np.int32)]
        ms = np.array([25 + (75 * n * n_docs) // n_terms for n in self.lengths], np.int64)[by_id]
        tf = np.frombuffer(self.tf, np.int32).astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * ms[doc])
        names = sorted(self.terms)
        place = np.empty(len(names), np.int64)
        place[[self.terms[t] for t in names]] = np.arange(len(names))
        term = place[np.frombuffer(self.term, np.int32)]
        order = np.lexsort((doc, -impact, term))
        starts = np.searchsorted(term[order], np.arange(len(names) + 1)).astype(np.int32)
        depth = max(len(by_id) - 1, 0).bit_length()
        bits = [np.packbits(x).tobytes() for x in WaveletTree.build(doc[order], depth)]
        ids = np.array([self.ids[i] or 0 for i in by_id], np.int64)
        nulls = np.array([self.ids[i] is None for i in by_id], np.uint8)
        columns = [pa.array([x], t) for x, t in ((ids.tobytes(), pa.binary()), (nulls.tobytes(), pa.binary()), (names, pa.list_(pa.string())), (starts.tobytes(), pa.binary()), (impact[order].astype(np.int32).tobytes(), pa.binary()), (bits, pa.list_(pa.binary())))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with at least one term, and L, all their terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(terms_of(_utf8(text))) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (sum(x > 0 for x in n), sum(n))], names=["docs", "terms"])

    row = text_batches(docs.select("text")).mapInArrow(count, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row["docs"] or 0, row["terms"] or 0


def build_index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """One row per shard: every document with a term is in one shard, every posting in its tree. Shards are made where
    the documents are read, without a shuffle, and are bounded in documents and postings."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, _utf8(text))
                if shard.full():
                    yield shard.row(n_docs, n_terms)
                    shard = _Shard()
        if shard.ids:
            yield shard.row(n_docs, n_terms)

    return text_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(shards, INDEX)


def search(index: DataFrame, queries: list[tuple[int, Counter]], n_docs: int, k: int = 10) -> DataFrame:
    """item_id, doc_id, score: each shard's k best documents for each query of a block, of which the k best overall
    are then chosen. The block's document frequencies come from the shards' dictionaries first."""
    wanted = sorted({t for _, q in queries for t in q})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1), strict=True):
                at = _places(terms.values, wanted)
                starts = np.frombuffer(starts.as_py(), np.int32)
                found += np.where(at >= 0, starts[at + 1] - starts[at], 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found).astype(np.int32)), pa.array(found[found > 0])], names=["term", "df"])

    counted = text_batches(index.select("terms", "starts"), 20).mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}  # one row a term of the block
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(wanted))]
    term_number = {t: i for i, t in enumerate(wanted)}
    plans = [(item, np.array([term_number[t] for t in q], np.int64), np.array([weight[term_number[t]] * n for t, n in q.items()], np.int64)) for item, q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nulls, terms, starts, impacts, bits in zip(*batch.columns, strict=True):
                ids, nulls = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(nulls.as_py(), np.uint8)
                at = _places(terms.values, wanted)
                starts = np.frombuffer(starts.as_py(), np.int32)
                impacts = np.frombuffer(impacts.as_py(), np.int32)
                tree = WaveletTree(impacts, [np.unpackbits(np.frombuffer(b, np.uint8), count=len(impacts)) for b in bits.as_py()])
                out: list[tuple] = []
                for item, terms_, weights in plans:
                    own = at[terms_]
                    there = (own >= 0) & (weights > 0)
                    own = own[there]
                    if len(own):
                        out += [(item, None if nulls[d] else int(ids[d]), s) for s, d in tree.top(starts[own], starts[own + 1], weights[there], k)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))], names=["item_id", "doc_id", "score"])

    return text_batches(index, 1).mapInArrow(run, "item_id long, doc_id long, score long")


def _places(terms: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """The place of each wanted term among the sorted ``terms``, or -1."""
    return pc.fill_null(pc.index_in(pa.array(wanted, pa.string()), value_set=terms.cast(pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def ranked_search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item, scores above 0, equal ones by doc_id.

    ``items`` (item_id, text) are the queries: they are brought to the shards in blocks of at most BLOCK_QUERIES or
    BLOCK_TERMS. The result is exact. A document without terms (null or empty text) has no score; an item without
    terms no row. Rows that repeat a doc_id are documents of their own; a null doc_id ranks last among equal scores.
    Rows that repeat an item_id are one query of all their texts. Long texts are read whole. Empty tables give no
    rows. Other columns may have any names.
    """
    n_docs, n_terms = corpus_size(docs)
    index = cut(build_index(docs, n_docs, max(n_terms, 1)), "search-index")
    best = None
    for queries in _blocks(items):
        found = search(index, queries, n_docs, k)
        best = found if best is None else best.union(found)
    if best is None:
        best = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, Counter]]]:
    """Blocks of (item_id, its terms) from a stream of the items, in order of item_id."""
    texts = items.select(F.col("item_id").cast("long"), "text").orderBy("item_id")
    block: list[tuple[int, Counter]] = []
    terms = 0
    for row in texts.toLocalIterator():
        counts = Counter(terms_of(row["text"]))
        if block and block[-1][0] == row["item_id"]:
            block[-1][1].update(counts)
        else:
            if len(block) >= BLOCK_QUERIES or terms > BLOCK_TERMS:
                yield block
                block, terms = [], 0
            block.append((row["item_id"], counts))
        terms += len(counts)
    if block:
        yield block


def op12_ranked_search(spark, sf_dir):
    return ranked_search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, corpus GROUP BY term),
queries AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) AS q GROUP BY item_id, term),
scored AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM queries JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) AS r WHERE rank <= 10
"""
