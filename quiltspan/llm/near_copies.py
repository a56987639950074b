"""Near copies at a Jaccard similarity of word shingles: SimHashes, the index of their positional bytes, a tally of the
bits that differ, and verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import simhash
from .common import connected_components, cut, text_batches, unused_name

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
#: A text has so many SimHashes of 64 bits. Each gives one positional byte: its most decided bit, the one whose sum over
#: the shingles is largest, and the bit's sign. At the similarity 0.8 two texts agree in a byte with probability 0.43, and
#: others in one of 128; a key of the index is two bytes, or three where there are more than MANY texts.
SIMHASHES, MANY = 72, 1 << 22
#: Of the first two SimHashes' 128 bits some 19 differ at the similarity 0.8, 64 between texts that have nothing in common.
DISTANCE = 36
#: Lists of more members are not tallied; their members are compared as those of lists of near copies are.
TALLIED = 4_096
#: Pairs that are tallied at once.
_TOGETHER = 1 << 20
#: To spare verifications, members of long lists of near copies are compared by BANDS x ROWS least hashes first.
BANDS, ROWS = 24, 6
#: At the similarity 0.8 some 115 of the 144 positional bytes agree; fewer than this with a probability of 0.0007.
LEAST_SHARED = 100
#: Lists with more members outside their largest component are posted anew under longer keys: members of a similarity of
#: UNLIKE then meet some LIST others, and a pair at SIMILARITY misses all keys with probability MISSED.
HOT_LIST, LIST, UNLIKE, MISSED = 8_192, 512, 0.6, 0.001
_CHUNK = 2048
_RNG = np.random.default_rng(SEED)
_FACTOR = _RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_SALT = _RNG.integers(0, 2**64, SIMHASHES, dtype=np.uint64)


def shingles(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending; a shorter text is one shingle, a wordless one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < length:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(words[k : k + length]) for k in range(len(words) - length + 1)]
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in parts), np.uint64, len(parts)))


def _low(hashes: np.ndarray) -> np.ndarray:
    """The shingles as they are stored to be compared, 32 bits each: among 20,000 words two meet once in 20 texts."""
    return np.unique(hashes.astype("<u4"))


def _spread(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers whose bits all depend on all bits of the given ones (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHashes of a text's shingles, and of each the positional byte: twice its most decided bit's place, and one
    more if that bit is set."""
    ones = np.zeros(64 * SIMHASHES, np.int64)
    for k in range(0, len(hashes), 255):
        h = _spread(hashes[k : k + 255, None] ^ _SALT)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    sums = (2 * ones - len(hashes)).reshape(SIMHASHES, 64)
    place = np.abs(sums).argmax(axis=1)
    return np.packbits(sums > 0, bitorder="little").view(np.uint64), (2 * place + (sums[np.arange(SIMHASHES), place] > 0)).astype(np.uint8)


def simhash_keys(n: int) -> np.ndarray:
    """The positional bytes (keys x length) by which n texts are posted. At the similarity 0.8 two texts share no key
    with probability (1 - 0.43^2)^36 = 0.0006, and (1 - 0.43^3)^96 = 0.0003 under keys of three bytes."""
    if n <= MANY:
        return np.arange(SIMHASHES).reshape(-1, 2)
    return np.stack([np.random.default_rng([SEED, k]).permutation(SIMHASHES)[:3] for k in range(96)])


def positions(hashes: np.ndarray) -> np.ndarray:
    """For each position the least value of its hash over the shingles."""
    low, least = hashes.astype(np.uint32), np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(low), _CHUNK):
        least = np.minimum(least, (low[k : k + _CHUNK, None] * _FACTOR + _SHIFT).min(axis=0))
    return least


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def row_key(docs: DataFrame) -> Column:
    """A digest of the whole row: equal for rows that are equal in every column, and for no others."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in docs.columns])), 256)


def _prints(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            fps = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            bits = [simhashes(s) if len(s) else None for s in sets]
            # the positional bytes, and the SimHashes that are tallied
            print_ = pa.array([None if x is None else x[1].tobytes() + x[0][:2].tobytes() for x in bits], pa.binary())
            marks = pa.array([positions(s).astype(np.uint8).tobytes() for s in sets], pa.binary())
            arrays = [pa.array(fps), print_, marks, pa.array([_low(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *arrays], names=["doc_id", "row_key", "fp", "print", "marks", "shingles"])

    rows = text_batches(docs).select("doc_id", row_key(docs).alias("row_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, row_key string, fp long, print binary, marks binary, shingles binary")


def _close(ends: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each member of neighbouring lists the first one of its list that pairs at DISTANCE bits or fewer reach.
    ``ends``: where each member's list ends; ``bits``: two SimHashes of each."""
    at, edges = np.arange(len(ends)), [np.zeros((2, 0), np.int64)]
    later = ends - at - 1
    costs, k = np.cumsum(later), 0
    while k < len(ends):
        e = max(int(np.searchsorted(costs, (costs[k - 1] if k else 0) + _TOGETHER, "right")), k + 1)
        a = np.repeat(at[k:e], later[k:e])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[k:e]) - later[k:e], later[k:e])
        near = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= DISTANCE
        if near.any():
            root = simhash._roots(len(ends), a[near], b[near])
            some = np.flatnonzero(root != at)
            edges.append(np.stack([some, root[some]]))
        k = e
    return simhash._roots(len(ends), *np.concatenate(edges, axis=1))


def _groups(keys: np.ndarray, fps: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """key, fp of the groups of two or more that are close within their lists. A group's key is made of its members, so
    that a group found in many lists is one. ``keys`` ascend."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    root = _close(np.repeat(starts + sizes, sizes), bits)
    total = np.zeros(len(keys), np.uint64)
    np.add.at(total, root, _spread(fps.view(np.uint64)))
    some = np.bincount(root, minlength=len(keys))[root] > 1
    return total[root[some]].view(np.int64), fps[some]


def posted(nodes: DataFrame, n: int, tallied: int = TALLIED) -> DataFrame:
    """Groups (key, fp) of texts that may be near copies. ``nodes``: fp, print, each fp once; ``n``: their number.

    The index posts a text under pairs of positional bytes of its SimHashes. Within a list, the bits of two further
    SimHashes in which two members differ are tallied, pairs with more than DISTANCE go, and what the others connect is
    a group. Lists of more than ``tallied`` members are groups as they are.
    """
    drawn = simhash_keys(n)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(-1, SIMHASHES + 16)
            left, right = (pa.array(x) for x in np.ascontiguousarray(rows[:, SIMHASHES:]).view(np.int64).T)
            for k, places in enumerate(drawn):
                key = np.full(len(rows), k, np.int64)
                for p in places:
                    key = key << 8 | rows[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("fp"), left, right], names=["key", "fp", "left", "right"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, whole = np.zeros((0, 4), np.int64), None  # the last list so far; the key of one that is too long
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = np.stack([np.asarray(batch.column(c), np.int64) for c in ("key", "fp", "left", "right")], axis=1)
                long = rows[:, 0] == whole if whole is not None else np.zeros(len(rows), bool)
                out = [(rows[long, 0], rows[long, 1])]
                rest = np.concatenate([rest, rows[~long]])
                done = int(np.searchsorted(rest[:, 0], rest[-1, 0])) if len(rest) else 0
            else:
                out, done = [], len(rest)
            some, rest = rest[:done], rest[done:]
            out.append(_groups(some[:, 0].copy(), some[:, 1].copy(), some[:, 2:].view(np.uint64)))
            if len(rest) > tallied:
                whole = rest[0, 0]
                out.append((rest[:, 0], rest[:, 1]))
                rest = rest[:0]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["key", "fp"])

    posts = nodes.where("print is not null").select("fp", "print").mapInArrow(post, "key long, fp long, left long, right long")
    return posts.repartition("key").sortWithinPartitions("key").mapInArrow(tally, "key long, fp long").distinct()


def candidates(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of fingerprints to verify, and the posts of groups of more than three: key, fp, the group's smallest
    fp (first) and size (n). ``posts``: key, fp.

    Every member of a group meets two of its members, which the group's own order of fingerprints puts
    first and last: all pairs in groups of up to three, and in longer ones, which are mostly groups of copies, other
    pairs in each group. Both ends are minima, combined before the shuffle, and meet the list in an equi-join, so that
    no group is gathered and the pairs grow as the rows. A text is in as many lists as the index has keys at most; an end
    that it meets in several of them makes one pair. What such pairs leave apart in a longer group ``left_apart`` compares.
    """
    order = F.col("fp").bitwiseXOR(F.col("key"))
    ends = posts.groupBy("key").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.min("fp").alias("first"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    met = cut(posts.join(ends, "key"), "lists")
    lo, hi = (F.collect_set(F.col(c).bitwiseXOR(F.col("key"))).alias(c) for c in ("lo", "hi"))
    texts = met.groupBy("fp").agg(lo, hi).select("fp", F.array_remove(F.array_union("lo", "hi"), F.col("fp")).alias("ends"))
    pairs = texts.select("fp", F.explode("ends").alias("end")).select(F.greatest("fp", "end").alias("a"), F.least("fp", "end").alias("b")).distinct()
    return pairs, met.where("n > 3").select("key", "fp", "first", "n")


def merged(lists: DataFrame, most: int = HOT_LIST) -> DataFrame:
    """Posts (key, fp) of fewer lists, in which all members of each given list (key, fp, first, n) meet.

    Texts of a large group share many lists of the index, so that each of their pairs would meet in many. Lists that
    overlap, in chains as well, become one where that has no more pairs than all of them and ``most`` members at most;
    the others stay. Overlaps are those of the lists' first members, of which a text names its own lists'.
    """
    texts = lists.groupBy("fp").agg(F.min("first").alias("first"), F.collect_set("first").alias("firsts"), F.sum("n").alias("met"))
    texts = cut(texts, "lists-of-texts")
    edges = texts.select(F.explode("firsts").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    roots = connected_components(edges)
    texts = texts.join(roots, texts["first"] == roots["node"], "left").select(F.coalesce("root", "first").alias("cluster"), "fp", "met")
    texts = cut(texts, "clusters")
    one = texts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("met").alias("met")).where((F.col("n") <= most) & (F.col("n") * F.col("n") <= F.col("met")))
    whole = texts.join(one, "cluster", "left_semi").select(F.xxhash64("cluster").alias("key"), "fp")
    return whole.union(lists.join(texts.join(one, "cluster", "left_anti"), "fp", "left_semi").select("key", "fp"))


def longer_keys(n: int) -> np.ndarray:
    """The positions (keys x length) by which a list of n members is posted anew: so many that members at the
    similarity UNLIKE meet LIST others, and so many keys that members at SIMILARITY share none of them with
    probability MISSED."""
    length = max(1, math.ceil(math.log(max(n, 1) / LIST) / math.log(1 / UNLIKE)))
    keys = math.ceil(math.log(MISSED) / math.log(1 - SIMILARITY**length)) if length > 1 else BANDS
    return np.stack([np.random.default_rng([SEED, length, k]).permutation(BANDS * ROWS)[:length] for k in range(keys)])


def _posted_anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plans: dict[int, np.ndarray] = {}
    for batch in batches:
        out: list[np.ndarray] = []
        counts = []
        for key, n, mark in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "marks")), strict=True):
            if n not in plans:
                plans[n] = longer_keys(n)
            drawn = np.frombuffer(mark, np.uint8)[plans[n]]
            out.append(np.array([xxh64_intdigest(x.tobytes(), key + k & 2**64 - 1) for k, x in enumerate(drawn)], np.uint64).view(np.int64))
            counts.append(len(drawn))
        place = np.repeat(np.arange(len(counts)), counts)
        columns = [np.asarray(batch.column(c), np.int64)[place] for c in ("fp", "root", "size")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out, np.zeros(0, np.int64)])), *map(pa.array, columns)], names=["key", "fp", "root", "size"])


def _mixed(named: DataFrame) -> DataFrame:
    """Of the lists (key, fp, root, size) with several components: key, n, the largest component, and the members
    outside it and their bytes."""
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = F.max_by(F.struct("root", "n", "size"), F.struct("n", "root"))
    lists = sizes.groupBy("key").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    lists = lists.select("key", "n", F.col("most.root").alias("largest"), (F.col("n") - F.col("most.n")).alias("others"), (F.col("size") - F.col("most.size")).alias("bytes"))
    return lists.where("others > 0")


def left_apart(posts: DataFrame, roots: DataFrame, prints: DataFrame, block: int = 1_024, mbytes: int = 8, hot: int = HOT_LIST) -> DataFrame:
    """Links (a, b), some more than once, between members of one list that are not in one component yet.

    Of each list (``posts``: key, fp) whose members are in several components (``roots``: node, root), those outside
    its largest one, in blocks of some ``block`` members or ``mbytes``, meet all its members (``prints``: fp, marks,
    shingles). The positional bytes that two of them share are tallied, and pairs below LEAST_SHARED go. A member is
    then verified against those of each other component, from the most shared bytes down, until one is a link: joining
    components takes one link of theirs, and where there is none, every pair has been verified. That is done where the
    two meet, so that no shingles are sent for a pair.

    A list with more than ``hot`` members outside its largest component, such as the pages of one template, is not
    compared so, which would grow as its square, but posted anew under ``longer_keys``, whose lists are.
    """
    sized = prints.select("fp", F.length("shingles").cast("long").alias("size"))
    named = posts.join(roots, posts["fp"] == roots["node"], "left").join(sized, "fp").select("key", "fp", F.coalesce("root", "fp").alias("root"), "size")
    named = cut(named, "named-lists")
    lists = cut(_mixed(named), "mixed-lists")
    long = lists.where(F.col("others") > hot)
    if not long.isEmpty():
        members = named.join(long.select("key", "n"), "key").join(prints.select("fp", "marks"), "fp").select("key", "n", "fp", "root", "size", "marks")
        anew = cut(members.mapInArrow(_posted_anew, "key long, fp long, root long, size long"), "posted-anew")
        named = named.join(long, "key", "left_anti").union(anew)
        lists = cut(lists.where(F.col("others") <= hot).union(_mixed(anew)), "mixed-lists")
    blocks = F.ceil(F.greatest(F.col("others") / F.lit(block), F.col("bytes") / F.lit(mbytes << 20)))
    lists = lists.select("key", "largest", blocks.cast("int").alias("blocks"))
    rows = named.join(lists, "key").join(prints, "fp")
    left = rows.where("root <> largest").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["key", "block", "side", "fp", "root", "marks", "shingles"]
    both = left.withColumn("side", F.lit(0)).select(*cols).union(right.withColumn("side", F.lit(1)).select(*cols))
    dealt = both.repartition("key", "block").sortWithinPartitions("key", "block", "side")

    def met(left: list[tuple], right: list[tuple], m: np.ndarray, joined: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Links of ``left`` with ``right`` members (fp, root, marks, shingles); ``joined``: (fp, root) that have one."""
        theirs = np.array([r for _, r, _, _ in right])
        for fp, root, mark, mine in left:
            shared = (m == mark).sum(axis=1)
            at = np.flatnonzero((shared >= LEAST_SHARED) & (theirs != root))
            for j in at[np.argsort(-shared[at], kind="stable")].tolist():
                other, to, _, others = right[j]
                if (fp, to) not in joined and similarity(mine, others) >= SIMILARITY:
                    joined.add((fp, to))
                    yield max(fp, other), min(fp, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        left: list[tuple] = []
        joined: set[tuple[int, int]] = set()
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c), np.int64) for c in ("key", "block", "side")], axis=1)
            borders = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out: list[tuple[int, int]] = []
            for s, e in zip(borders, borders[1:], strict=False):
                if s == e:
                    continue
                fps, roots_, marks, sets = (batch.column(c).slice(s, e - s).to_pylist() for c in ("fp", "root", "marks", "shingles"))
                some = [(f, r, np.frombuffer(x, np.uint8), np.frombuffer(y, "<u4")) for f, r, x, y in zip(fps, roots_, marks, sets, strict=True)]
                place = tuple(keys[s, :2])
                if place != here:
                    here, left, joined = place, [], set()
                if keys[s, 2] == 0:
                    left += some
                elif left:
                    out += met(left, some, np.stack([x for _, _, x, _ in some]), joined)
            cols_ = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols_], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingles have at least the similarity. ``sets``: fp, shingles, each fp once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [similarity(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) >= least for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    x = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def survivors(docs: DataFrame) -> DataFrame:
    """One whole row of each group of near copies: that of the smallest doc_id, null ids last, then of the smallest
    digest of the row. Two rows are near copies if their shingles have a similarity of SIMILARITY or more; groups are
    the connected components. Wordless and null texts are one group.

    A doc_id has no part in who is a copy: rows that share one are judged by their texts, and so are rows without.
    Long texts are read whole. An empty table gives no rows. Other columns may have any names and come back as they are.
    """
    prints = cut(_prints(docs), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    nodes = cut(prints.groupBy("fp").agg(F.min(row).alias("least"), F.first("print").alias("print")), "nodes")
    pairs, long = candidates(cut(posted(nodes, nodes.count()), "posts"))

    def of_nodes(some: DataFrame, *columns: str) -> DataFrame:
        """fp and columns of ``some`` fingerprints (fp), from one row of each."""
        shown = nodes.join(some, "fp", "left_semi").select("fp", F.col("least.row_key").alias("row_key"))
        return prints.join(shown, ["fp", "row_key"], "left_semi").select("fp", *columns).dropDuplicates(["fp"])

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        met = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
        return cut(verified(pairs, cut(of_nodes(met, "shingles"), "sets")), "links")

    roots = connected_components(linked(pairs))
    long = cut(merged(long), "merged-lists")
    more = cut(left_apart(long, roots, of_nodes(long.select("fp"), "marks", "shingles")), "links-apart")
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    groups = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    chosen = groups.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row_key").alias("row_key"))
    key = unused_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs))
    return keyed.join(chosen.withColumnRenamed("row_key", key), key, "left_semi").dropDuplicates([key]).select(*docs.columns)
