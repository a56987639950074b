"""Embedding near-duplicates by spherical-cap filters of structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, table

COSINE = 0.9
#: A product code has so many words (``plan``) in each of two halves of the (rotated) space, and a direction for each
#: pair of words; there are CODES such codes.
CODES = 16
#: A cap holds about so many of the vectors, whatever their number, but no more than the share LARGEST of the sphere and
#: no less than what lies above the height HIGHEST, which is wide against the angle of a link in few dimensions.
MEMBERS, LARGEST, HIGHEST = 12, 5e-4, 0.8
#: The share of links at the least cosine that no filter finds, by which the number of directions is chosen.
MISSED = 0.002
#: A bucket with more members is compared in blocks of about so many, each pair of blocks in its own task.
BLOCK = 1_000
SEED = 20_240
_STEPS = 20_000


def _share_above(dim: int, height: np.ndarray | float) -> np.ndarray:
    """The share of the unit sphere in ``dim`` dimensions above a height: the density of the angle is sin^(dim - 2)."""
    angle = np.linspace(0, np.pi, _STEPS + 1)
    if dim == 1:
        return np.where(np.asarray(height) < -1, 1.0, np.where(np.asarray(height) < 1, 0.5, 0.0))
    total = np.concatenate([[0.0], np.cumsum(np.sin((angle[1:] + angle[:-1]) / 2) ** (dim - 2))])
    return np.interp(np.arccos(np.clip(height, -1, 1)), angle, total / total[-1])


def share_of_both(dim: int, height: float, cosine: float) -> float:
    """The share of directions whose caps hold both of two unit vectors at ``cosine``.

    Over the directions at each angle to the first vector, the second one's height is cosine * u + sine * v, where v
    is a coordinate of a sphere of one dimension less."""
    angle = (np.arange(_STEPS) + 0.5) * np.pi / _STEPS
    u, density = np.cos(angle), np.sin(angle) ** (dim - 2)
    across = np.sqrt(max(1 - cosine**2, 1e-12)) * np.sin(angle)
    both = _share_above(dim - 1, (height - cosine * u) / across)
    return float((density * (u > height) * both).sum() / density.sum())


@cache
def plan(dim: int, n: int, cosine: float = COSINE) -> tuple[float, int]:
    """The caps' height and the number of words of a half, for ``n`` vectors of ``dim`` dimensions.

    The share of a cap falls as 1 / n, so that a bucket's members stay as many and the pairs compared grow as the
    vectors. The number of directions is then the one at which a link at ``cosine`` is missed with probability MISSED,
    as for random directions: a vector's list grows slowly with n, by a small power of it."""
    heights = np.linspace(0, HIGHEST, 2_001)
    share = min(LARGEST, MEMBERS / max(n, 1))
    height = float(heights[min(np.searchsorted(-_share_above(dim, heights), -share), len(heights) - 1)])
    directions = -np.log(MISSED) / share_of_both(dim, height, cosine)
    return height, max(2, int(np.ceil(np.sqrt(directions / CODES))))


@cache
def _codes(dim: int, words: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per code: a random rotation and the words of its two halves, each of length sqrt(1/2)."""
    rng, out = np.random.default_rng([SEED, dim]), []
    for _ in range(CODES):
        rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        halves = []
        for d in (dim // 2, dim - dim // 2):
            w = rng.standard_normal((words, max(d, 1)))
            halves.append((w / np.linalg.norm(w, axis=1, keepdims=True) * np.sqrt(0.5))[:, :d])
        out.append((rotation, *halves))
    return out


def decode(units: np.ndarray, n: int, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, directions), in this order, of all directions in whose caps the rows of ``units`` lie, and each
    row's best one. ``n``: the number of vectors that the filters are planned for.

    The list of a vector is found from its inner products with the words of both halves: the second half's are
    sorted, and for each word of the first half the words that lift the sum over the threshold are a tail of them.
    """
    rows, dirs = [], []
    dim = units.shape[1]
    if dim == 1:  # two directions in all
        return np.arange(len(units)), (units[:, 0] < 0).astype(np.int64)
    height, words = plan(dim, n, cosine)
    for k, (rotation, one, two) in enumerate(_codes(dim, words)):
        turned = units @ rotation
        a, b = turned[:, : dim // 2] @ one.T, turned[:, dim // 2 :] @ two.T
        order = np.argsort(-b, axis=1)
        sorted_b = np.take_along_axis(b, order, axis=1)
        need = height - a
        near = need <= sorted_b[:, :1]  # words of the first half that any word of the second completes
        r, w = np.nonzero(near)
        counts = (sorted_b[r] >= need[r, w][:, None]).sum(axis=1)
        base = np.repeat(np.arange(len(r)), counts)
        within = np.arange(len(base)) - np.repeat(np.cumsum(counts) - counts, counts)
        rows.append(r[base])
        dirs.append((k * words + w[base]) * words + order[r[base], within])
        # nobody is without a bucket: each vector's best direction counts, too
        rows.append(np.arange(len(units)))
        dirs.append((k * words + a.argmax(axis=1)) * words + order[:, 0])
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(dirs)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the batch, vectors, unit vectors) for each dimension that occurs."""
    column = batch.column("vec")
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x = flat[starts[at][:, None] + np.arange(dim)]
        yield at, x, x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(n: int, cosine: float):
    """(node, weight, vec, dim, dirs) of each class, its directions in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            k = 0
            while k < whole.num_rows:
                # as many vectors at once as have about four million inner products with the words of a half
                dim = max(2, whole.column("vec")[k].values.__len__())
                step = max(16, 4_000_000 // plan(dim, n, cosine)[1])
                batch = whole.slice(k, min(step, 2_000))
                k += batch.num_rows
                for at, x, units in _units(batch):
                    r, d = decode(units, n, cosine)
                    ends = np.searchsorted(r, np.arange(len(at) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(d, pa.int64()))
                    place = pa.array(at)
                    cols = [batch.column(c).take(place) for c in ("node", "weight", "vec")]
                    dims = pa.array(np.full(len(at), x.shape[1]), pa.int32())
                    yield pa.RecordBatch.from_arrays([*cols, dims, lists], names=["node", "weight", "vec", "dim", "dirs"])

    return run


def _first_here(i: np.ndarray, j: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Which of the pairs (i, j) share no earlier direction; ``lists``: each member's earlier directions, ascending.

    Members and directions make a 0/1 matrix, of which the columns that more than one member has are taken CHUNK at a
    time; the products of its rows count what two members share."""
    rows = np.repeat(np.arange(len(lists)), list(map(len, lists)))
    flat = np.concatenate(lists) if len(rows) else np.zeros(0, np.int64)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1 if len(flat) else np.zeros(0, bool)
    rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    free = np.ones(len(i), bool)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        s, e = np.searchsorted(column, [c, c + CHUNK])
        part = np.zeros((len(lists), CHUNK), np.float32)
        part[rows[s:e], column[s:e] - c] = 1
        some = np.flatnonzero(free)
        if len(some) > 4 * len(lists):
            free[some] = (part @ part.T)[i[some], j[some]] == 0
        else:
            for k in range(0, len(some), 4096):
                at = some[k : k + 4096]
                free[at] = ~((part[i[at]] > 0) & (part[j[at]] > 0)).any(axis=1)
    return free


#: Directions that are compared at once: with the 2 * BLOCK members of two blocks, 16 MB.
CHUNK = 2_048


def _compare(left: tuple, right: tuple | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, links found here, root): of the pairs within ``left``, or between ``left`` and ``right``.

    A pair counts in the first direction that both share. ``root`` is the smallest node reached by the pairs found.
    """
    both = left if right is None else tuple(np.concatenate([a, b]) for a, b in zip(left, right, strict=True))
    node, weight, vec, earlier = both
    n, split = len(node), len(left[0])
    units = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    found_i, found_j = [], []
    for s in range(0, split, 512):
        a = np.arange(s, min(s + 512, split))
        b = np.arange(a[0], n) if right is None else np.arange(split, n)
        near = units[a] @ units[b].T >= cosine
        if right is None:
            near &= b[None, :] > a[:, None]
        i, j = np.nonzero(near)
        found_i.append(a[i])
        found_j.append(b[j])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    first = _first_here(i, j, list(earlier)) if len(i) else np.zeros(0, bool)
    i, j = i[first], j[first]
    count, root = np.zeros(n, np.int64), np.arange(n)
    np.add.at(count, i, weight[j])
    np.add.at(count, j, weight[i])
    order = np.argsort(node, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    i, j = place[i], place[j]
    while len(i):
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return node, count, node[order[root[place]]]


def _bucket_links(cosine: float):
    """Rows ordered by (dim, dir, p, q), of which each group is one comparison: within a block (p = q) or of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows < 2:
                return
            node, weight = t["node"].to_numpy(), t["weight"].to_numpy()
            vec = np.asarray(t["vec"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
            lists = t["earlier"].combine_chunks()
            earlier = np.empty(t.num_rows, object)
            earlier[:] = np.split(np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()))[:-1])
            part = tuple((node, weight, vec, earlier))
            if key[2] == key[3]:
                got = _compare(part, None, cosine)
            else:
                first = t["block"].to_numpy() == key[2]
                got = _compare(tuple(x[first] for x in part), tuple(x[~first] for x in part), cosine)
            at = np.flatnonzero(got[1])
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in got], names=["node", "n", "root"])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c), np.int64) for c in ("dim", "dir", "p", "q")], axis=1)
            borders = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(borders, borders[1:], strict=False):
                if s == e:
                    continue
                if tuple(keys[s]) != key:
                    yield from done()
                    key, held = tuple(keys[s].tolist()), []
                held.append(batch.slice(s, e - s))
        yield from done()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one class with a weight. A class is in the bucket of every filter direction whose cap holds it;
    within buckets every pair is verified by its cosine in double precision, and a pair that shares several buckets
    counts in the first. Buckets larger than ``block`` are cut into blocks by a hash, and each two blocks meet in a
    group of their own: no task gets a bucket whole, and none of its rows is dropped. What leaves a bucket is one row
    per member: its links found there and the smallest node that these reach.

    n_links counts the other rows at a cosine of ``cosine`` or more; no link below is ever given. The filters are
    planned for the number of vectors (``plan``) and find a pair at exactly ``cosine`` with a probability of 0.98 or
    more, closer ones more surely (README). Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; neither do vectors of different lengths, nor
    rows without vec_id, whose component_id is null and kept false. Equal rows link with each other; different
    vectors under one vec_id are one node, whose links are pooled. Empty table: no rows. Other columns may have any names.
    """
    usable = F.col("vec_id").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    # two 64-bit hashes of the vector, the second seeded with the first's input plus a constant: 128 bits stand for it
    rows = vectors.select("vec_id", usable.alias("ok"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", F.lit(2)).alias("h2"), "embedding")
    classes = cut(rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("vec")), "classes")
    element = classes.schema["vec"].dataType.simpleString()
    id_kind = classes.schema["node"].dataType
    nodes = classes.select(F.col("node").cast("long").alias("node"), "weight", "vec")

    n = classes.count()
    schema = f"node long, weight long, vec {element}, dim int, dirs array<long>"
    decoded = cut(nodes.mapInArrow(_decoded(n, cosine), schema), "decoded")
    sizes = decoded.select("dim", F.explode("dirs").alias("dir")).groupBy("dim", "dir").agg(F.count(F.lit(1)).alias("n"))
    hot = cut(sizes.where(F.col("n") > block).select("dim", "dir", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")), "hot-buckets")
    at = decoded.select("dim", "node", "weight", "vec", "dirs", F.posexplode("dirs").alias("place", "dir"))
    # of a member's directions a bucket needs the earlier ones alone
    members = at.select("dim", "dir", "node", "weight", "vec", F.slice("dirs", 1, F.col("place")).alias("earlier"))
    members = members.join(hot, ["dim", "dir"], "left").withColumn("block", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node", "dir"), F.col("blocks")).cast("int")))
    alone = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    every = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda k: F.struct(F.least("block", k).alias("p"), F.greatest("block", k).alias("q")))
    members = members.withColumn("m", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(every)))
    members = members.select("dim", "dir", "m.p", "m.q", "block", "node", "weight", "vec", "earlier")
    keys = ["dim", "dir", "p", "q"]
    dealt = members.repartition(*keys) if partitions is None else members.repartition(partitions, *keys)
    found = cut(dealt.sortWithinPartitions(*keys).mapInArrow(_bucket_links(cosine), "node long, n long, root long"), "bucket-links")

    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.select("h1", "h2", "weight", F.col("node").cast("long").alias("node")).join(linked, "node", "left").join(roots.select("node", "root"), "node", "left")
    known = known.groupBy("h1", "h2").agg(F.max("weight").alias("weight"), F.max("n").alias("n"), F.min(F.coalesce("root", "node")).alias("root"))
    known = cut(known, "classes-known")
    out = rows.select("vec_id", "ok", "h1", "h2").join(known, ["h1", "h2"], "left")
    n_links = F.when(F.col("ok"), F.coalesce("n", F.lit(0)) + F.col("weight") - 1).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("ok"), F.col("root").cast(id_kind)).otherwise(F.col("vec_id"))
    return out.select("vec_id", n_links.alias("n_links"), component.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
