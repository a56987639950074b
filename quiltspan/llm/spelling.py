"""Spelling variants: bands of letter-parity masks find the words at one edit; each word's form leads to its root."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_batches

#: Letters of a run, of which A-Z are then lower-cased, so that words consist of a-z and U+00C0 to U+00FF: 90 letters.
RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ALPHABET = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [chr(c) for c in range(0xC0, 0x100)]
BANDS, BAND_BITS = 3, 30
#: One occurrence in so many, by checksum, loses a letter.
SLIP = 97
#: Lists of more members are not compared whole: they are posted anew under longer keys, then compared block by block.
HOT_LIST = 2_000
#: Words that a task counts before it hands them on.
_MOST_COUNTED = 500_000
#: Pairs, or letters of them, that are looked at together.
_CELLS = 2_000_000
#: Letters that make a word count as one member of a list; a longer one counts as more.
_WIDE = 64


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of a text with their occurrences: runs of letters, A-Z lower-cased; where SLIP divides the CRC-32 h
    of ``<doc_id>:<run>``, the run loses its letter at h % length. A null doc_id stands as the empty string."""
    lowered = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    counts = Counter(RUN.findall(lowered))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    changed: Counter = Counter()
    for run in counts:
        h = zlib.crc32(run.encode(), start)
        if not h % SLIP:
            changed[run] = h % len(run)
    moved = [(run[:at] + run[at + 1 :], counts.pop(run)) for run, at in changed.items()]
    for word, n in moved:
        counts[word] += n
    return counts


def vocabulary(docs: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """word, n of every word of at least ``min_chars`` code points and ``min_count`` occurrences in all texts. A task
    adds up the counts of its texts, and hands them on whenever it holds _MOST_COUNTED words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in total.items() if len(w) >= min_chars]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total.update(words_of(doc_id, text.as_py()))
                if len(total) > _MOST_COUNTED:
                    yield out()
        yield out()

    counted = text_batches(docs.select("doc_id", "text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_bits(vocab: DataFrame) -> np.ndarray:
    """For each letter (as a Latin-1 byte) its place among the 3 * 30 mask bits. Letters are dealt to the bands in
    turn, back and forth, by their frequency in ``vocab``, so that each band tells about as much; one small row for
    each of the 90 letters comes to the driver."""
    letters = vocab.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    often = {r["letter"]: r["n"] for r in letters.collect()}
    bits = np.zeros(256, np.int64)
    for k, letter in enumerate(sorted(ALPHABET, key=lambda c: (-often.get(c, 0), c))):
        turn, band = divmod(k, BANDS)
        bits[ord(letter)] = (band if turn % 2 == 0 else BANDS - 1 - band) * BAND_BITS + turn
    return bits


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words as rows of Latin-1 bytes, filled up with zeros, and their lengths."""
    length = np.array([len(w) for w in words], np.int64)
    wide = int(length.max()) if len(words) else 0
    return np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("latin-1"), np.uint8).reshape(len(words), wide), length


def masks_of(letters: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """n x 3 bands: a bit is set if its letter occurs an odd number of times."""
    out = np.zeros((len(letters), BANDS), np.int64)
    for band in range(BANDS):
        own = np.where((bits // BAND_BITS == band) & (np.arange(256) > 0), np.int64(1) << (bits % BAND_BITS), 0)
        np.bitwise_xor.reduce(own[letters], axis=1, out=out[:, band])
    return out


def _finer(rest: np.ndarray, part: int) -> np.ndarray:
    """Every third bit, from ``part``, of the two bands that a replacement's key does not hold (n x 2): 20 bits."""
    every = sum(1 << i for i in range(BAND_BITS) if i % 3 == part)
    return (rest[:, 0] & every) | (rest[:, 1] & every) << BAND_BITS


#: Kinds of lists: 0-2 replacements by one equal band; 3-5 insertions by two; 6-14 replacements by a band and a part.
def keys_of(masks: np.ndarray, kind: int) -> np.ndarray:
    """The key of each mask under ``kind``. Of 6 to 14, the band's value is the list that they refine."""
    if kind < 3:
        return masks[:, kind]
    if kind < 6:
        a, b = ((0, 1), (0, 2), (1, 2))[kind - 3]
        return masks[:, a] | masks[:, b] << BAND_BITS
    band, part = divmod(kind - 6, 3)
    # 30 bits of the band and 40 of the part do not fit one long: hashed alike, and words that collide are verified
    return _finer(np.delete(masks, band, 1), part) * np.int64(-7046029254386353131) + masks[:, band]


def one_edit(letters: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words at places a and b differ by one replaced letter (equal lengths), or b is a and one more."""
    x, y = letters[a], letters[b]
    same = x == y
    replaced = (~same).sum(axis=1) == 1
    if not (length[a] != length[b]).any():
        return replaced
    wide = letters.shape[1]
    ahead = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    # from the ends: letters moved to the right
    place = np.arange(wide)[None, :]
    x, y = (np.where(place >= wide - n[:, None], np.take_along_axis(z, np.maximum(place - wide + n[:, None], 0), 1), 0) for z, n in ((x, length[a]), (y, length[b])))
    behind = np.logical_and.accumulate((x == y)[:, ::-1], axis=1).sum(axis=1)
    inserted = (length[b] == length[a] + 1) & (ahead + behind >= length[a])
    return np.where(length[a] == length[b], replaced, inserted)


def near_pairs(lists: list[tuple[int, int, int | None, int | None]], letters: np.ndarray, length: np.ndarray, bits: np.ndarray, inserts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the near pairs of posting lists. A list is the places from .. to of the words ``letters``, of
    which two meet each other, or with a second from .. to, whose words meet those of the first. ``inserts``: pairs
    of which b is a letter longer than a; otherwise pairs of equal length. Pairs of many small lists are compared
    together, those of a long one as a matrix."""
    masks = masks_of(letters, bits)
    flips, longer = (1, 1) if inserts else (2, 0)
    out_a, out_b = [], []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, _CELLS // max(letters.shape[1], 1))
        for at in range(0, len(a), step):
            x, y = a[at : at + step], b[at : at + step]
            ok = one_edit(letters, length, x, y)
            out_a.append(x[ok])
            out_b.append(y[ok])

    def several(a: list[np.ndarray], b: list[np.ndarray]) -> None:
        x, y = np.concatenate(a), np.concatenate(b)
        hit = (np.bitwise_count(masks[x] ^ masks[y]).sum(axis=1) == flips) & (length[y] == length[x] + longer)
        keep(x[hit], y[hit])

    waiting_a, waiting_b, waiting = [], [], 0
    for from_, to, other, end in lists:
        n, m = to - from_, (to - from_ if other is None else end - other)
        if n * m <= 1024:
            x, y = _upper(n) if other is None else np.divmod(np.arange(n * m), m)
            waiting_a.append(x + from_)
            waiting_b.append(y + (from_ if other is None else other))
            waiting += len(x)
            if waiting > _CELLS:
                several(waiting_a, waiting_b)
                waiting_a, waiting_b, waiting = [], [], 0
            continue
        start = from_ if other is None else other
        rows = max(1, _CELLS // m)
        for at in range(from_, to, rows):
            first, second = slice(at, min(at + rows, to)), slice(at if other is None else start, start + m)
            changed = np.zeros((first.stop - first.start, second.stop - second.start), np.uint8)
            for band in masks.T:
                changed += np.bitwise_count(band[first][:, None] ^ band[second][None, :])
            hit = (changed == flips) & (length[second][None, :] == length[first][:, None] + longer)
            x, y = np.nonzero(np.triu(hit, 1) if other is None else hit)
            keep(x + first.start, y + second.start)
    if waiting:
        several(waiting_a, waiting_b)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


@cache
def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def near_words(vocab: DataFrame, hot: int = HOT_LIST) -> DataFrame:
    """a, a_n, b, b_n of every pair of near words, each pair in both directions and once.

    A letter that is replaced flips two parities, so that one band of the three stays whole; one that is put in or
    left out flips one, so that two bands stay. A word is posted under its three bands with its length, and under its
    three pairs of bands with its length and the one before, at which it meets the words that are a letter shorter.
    Lists compare the masks of their members, then the letters of those that differ in as many parities as they
    should. A list of more than ``hot`` words under one band is posted anew: of three parts of the other two bands
    one stays whole as well. What is longer even so is cut in blocks that meet two by two, in tasks of their own.
    """
    bits = letter_bits(vocab)

    def post(kinds: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                longest = pc.max(pc.utf8_length(batch.column(0))).as_py() or 1
                for at in range(0, batch.num_rows, step := max(1, _CELLS // longest)):
                    yield posted(batch.slice(at, step))

        def posted(batch: pa.RecordBatch) -> pa.RecordBatch:
            letters, length = letters_of(batch.column(0).to_pylist())
            masks = masks_of(letters, bits)
            rows = []
            for kind in kinds:
                for shorter in (0, 1) if 3 <= kind < 6 else (0,):
                    fixed = [np.full(len(length), x, np.int32) for x in (kind, shorter)]
                    rows.append([fixed[0], keys_of(masks, kind), (length - shorter).astype(np.int32), fixed[1]])
            columns = [pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)]
            columns += [pa.concat_arrays([batch.column(k)] * len(rows)) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "length", "role", "word", "n"])

        return run

    schema = "kind int, key long, length int, role int, word string, n long"
    by = ["kind", "key", "length"]

    def posts(rows: DataFrame, kinds: range) -> DataFrame:
        return text_batches(rows.select("word", "n"), 10_000).mapInArrow(post(kinds), schema)

    weight = F.col("members") * F.greatest(F.lit(1.0), F.col("length") / F.lit(float(_WIDE)))

    def long_lists(rows: DataFrame, name: str) -> DataFrame:
        return cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("members")).where(weight > hot), name)

    def compare(lists: DataFrame, inserts: bool) -> DataFrame:
        """The near pairs of lists ``left``, or of ``left`` with ``right``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # lists of one length, or nearly, together: words are filled up to the longest
                length, size = (batch.column(k).to_numpy() for k in (2, 3))
                order = np.argsort(length, kind="stable")
                width = np.floor(np.log2(np.maximum(length[order], 1))).astype(np.int64)
                part = np.cumsum(size[order] * length[order]) // (4 * _CELLS)
                for some in np.split(order, np.flatnonzero((np.diff(part) > 0) | (np.diff(width) > 0)) + 1):
                    if len(some):
                        yield compared(batch.take(pa.array(some)))

        def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
            left, right = batch.column(0), batch.column(1)
            members = pa.concat_arrays([left.flatten(), right.flatten()])
            words, n = members.field("word"), members.field("n")
            ends, more = (np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0))]) for x in (left, right))
            more = more + ends[-1]
            alone = right.is_null().to_pylist()
            lists = [(int(ends[k]), int(ends[k + 1]), *((None, None) if alone[k] else (int(more[k]), int(more[k + 1])))) for k in range(batch.num_rows)]
            a, b = near_pairs(lists, *letters_of(words.to_pylist()), bits, inserts)
            return pa.RecordBatch.from_arrays([words.take(pa.array(a)), n.take(pa.array(a)), words.take(pa.array(b)), n.take(pa.array(b))], names=["a", "a_n", "b", "b_n"])

        return text_batches(lists.select("left", "right", F.col("length").cast("long"), (F.size("left") + F.greatest(F.size("right"), F.lit(0))).cast("long").alias("size")), 2_000, 4).mapInArrow(run, "a string, a_n long, b string, b_n long")

    member = F.struct("word", "n")
    nothing = F.lit(None).cast("array<struct<word:string,n:long>>")

    def whole_lists(rows: DataFrame, inserts: bool) -> DataFrame:
        if inserts:
            lists = rows.groupBy(*by).agg(*(F.collect_list(F.when(F.col("role") == role, member)).alias(side) for role, side in enumerate(("left", "right"))))
            return compare(lists.where("size(left) > 0 AND size(right) > 0"), True)
        return compare(rows.groupBy(*by).agg(F.collect_list(member).alias("left")).where("size(left) > 1").withColumn("right", nothing), False)

    def blocks(rows: DataFrame, long: DataFrame, inserts: bool) -> DataFrame:
        """``rows`` of lists that are too long, block by block: a block of a list goes to each pair that it is in."""
        dealt = rows.join(long, by).withColumn("blocks", F.ceil(weight / hot).cast("int")).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
        if inserts:  # each block of the shorter words meets each block of the longer ones
            meets = F.transform(others, lambda o: F.when(F.col("role") == 0, F.struct(F.col("block").alias("x"), o.alias("y"))).otherwise(F.struct(o.alias("x"), F.col("block").alias("y"))))
        else:  # each two blocks meet once
            meets = F.transform(others, lambda o: F.struct(F.least(o, "block").alias("x"), F.greatest(o, "block").alias("y")))
        sent = dealt.select(*by, "role", "word", "n", "block", F.explode(meets).alias("m")).select("*", "m.x", "m.y")
        is_left = F.col("role") == 0 if inserts else F.col("block") == F.col("x")
        pairs = sent.groupBy(*by, "x", "y").agg(F.collect_list(F.when(is_left, member)).alias("left"), F.collect_list(F.when(~is_left, member)).alias("right"))
        return compare(pairs if inserts else pairs.withColumn("right", F.when(F.col("x") < F.col("y"), F.col("right"))), inserts)

    first = cut(posts(vocab, range(6)), "spelling-posts")
    long = long_lists(first, "spelling-long")
    short = first.join(long.select(*by), by, "left_anti")
    inserted, replaced = F.col("kind") >= 3, F.col("kind") < 3
    found = whole_lists(short.where(inserted), True).union(blocks(first.where(inserted), long.where(inserted), True)).union(whole_lists(short.where(replaced), False))
    again = first.where(replaced).join(long.select(*by), by, "left_semi")
    finer = [posts(again.where(F.col("kind") == kind), range(6 + 3 * kind, 9 + 3 * kind)) for kind in range(3)]
    finer = cut(finer[0].union(finer[1]).union(finer[2]), "spelling-finer")
    longer = long_lists(finer, "spelling-longer")
    found = found.union(whole_lists(finer.join(longer.select(*by), by, "left_anti"), False)).union(blocks(finer, longer, False))
    found = cut(found, "spelling-found")
    back = found.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    return found.union(back).distinct()


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """word, root for each (word, form), form not null: forms are followed to the last. A round doubles the steps that
    are known; a form has at least twice its word's occurrences, so that there is no circle and 63 steps are most."""
    known = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        further = known.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = known.join(further, known["root"] == further["at"], "left")
        now = cut(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        known = now.select("word", "root")
        if now.where("moved").isEmpty():
            break
    return known


def spelling_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, factor: int = 2, hot: int = HOT_LIST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts.

    A word's near words differ by one inserted, deleted or replaced code point; its form is the one that occurs most
    often (of several the first in code-point order) if it occurs at least ``factor`` times as often as the word. root
    is the last of the chain of forms, the word itself without a form. Null and empty texts have no words, and of a
    null doc_id the checksum takes the empty string. Repeated rows count each. Long texts are read whole. An empty
    table gives no rows. Other columns may have any names.
    """
    vocab = cut(vocabulary(docs, min_chars, min_count), "spelling-words")
    near = near_words(vocab, hot).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    near = near.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("most"), (-F.col("best.less")).alias("most_n"))
    joined = vocab.join(near, "word", "left")
    enough = F.col("most_n") >= F.lit(factor) * F.col("n")
    rows = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("most")).alias("form"), F.when(enough, F.col("most_n")).alias("form_n"))
    rows = cut(rows, "spelling-forms")
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))
