"""Packing: shortest-pack-first over the length histogram, patterns joined back to pieces by rank."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, table, text_batches

SEQUENCE = 1024
#: Rows of one length that are ranked together; a bound on a task's sort, not on what is packed.
ROWS_PER_RANK = 1_000_000
#: Texts are encoded in parts of about so many characters, which bounds what is held at once.
PART = 300_000
#: Parts with longer words, or with a hundred white spaces in a row, are not encoded by ranks.
LONGEST_WORD = 2_000
#: A rest of so many ids or more is cut once more.
LEAST_CUT = 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_EDGE = re.compile(r"\S(?=[ \t\n\r])")


def parts(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut where one of four white spaces follows another character.

    In the vocabulary's pattern white space is at a token's beginning only, so that tokens never reach over such a
    place and the ids of the parts are those of the whole. A run without such a place stays whole."""
    at = 0
    while at < len(text):
        edge = _EDGE.search(text, at + size - 1) if at + size < len(text) else None
        end = edge.end() if edge else len(text)
        yield text[at:end]
        at = end


_BLANKS = re.compile(r"\s{100}")


class Encoder:
    """Ids of texts by a tokenizer file, without special tokens added.

    Where the same vocabulary lies beside it as ranks, plain parts of a text are encoded from these, by a library that
    gives the same ids in a quarter of the time. It searches with a stack and merges words in quadratic time, so that
    parts with long runs of white space or very long words, and those that name the special token, are left to the
    tokenizer itself."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.ranks = _ranks(ranks) if os.path.exists(ranks) else None

    def plain(self, part: str) -> bool:
        if self.ranks is None or _BLANKS.search(part) or any(x in part for x in self.special):
            return False
        return max(map(len, part.split()), default=0) <= LONGEST_WORD

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of ``text`` (null: of the empty text), then id 0."""
        out: list[int] = []
        for part in parts(text or "", PART):
            if self.plain(part):
                out += self.ranks.encode_ordinary(part)
            else:
                out += self.tokenizer.encode(part, add_special_tokens=False).ids
        return np.array([*out, 0], "<u4")


def _ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, length: int, draw: int) -> list[int]:
    """Where a document of ``n`` ids is cut: every ``length`` ids, and its rest once more at a place that ``draw``
    chooses, so that rests of one length, of which there may be very many, give pieces of all lengths."""
    starts = list(range(0, n, length))
    rest = n - starts[-1]
    if LEAST_CUT <= rest < length:
        starts.append(starts[-1] + 1 + draw % (rest - 1))
    return [*starts, n]


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """piece, doc_id, start, length, ids_crc32, doc_tokens: each document's ids in pieces of ``length`` at most.

    ``piece`` numbers the pieces, by partition and place there: equal rows differ in it."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for k, text in enumerate(batch.column("text")):
                tokens = encoder(path).ids(text.as_py())
                n, raw = len(tokens), tokens.tobytes()
                at = cuts(n, length, xxh64_intdigest(number.to_bytes(8, "little") + raw[:64]))
                for s, e in zip(at, at[1:], strict=False):
                    rows.append((k, number, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), n))
                    number += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            names = ["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            arrays = [pa.array(c, pa.int64()) for c in cols[1:]]
            yield pa.RecordBatch.from_arrays([arrays[0], ids.take(pa.array(cols[0], pa.int64())), *arrays[1:]], names=names)

    schema = f"piece long, doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return text_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, count) for so many pieces of each length.

    Lengths are placed longest first. Each piece goes to the shortest pack, that with the most room, and opens a new
    one where it does not fit; all packs of a pattern get their pieces at once, and the pattern's count is split where
    only some of them get one. New packs take as many pieces of the length as they hold. The loop runs over lengths
    and patterns, never over pieces, so that it costs the same for a thousand documents and for 10^12.
    """
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]  # by the room left
    for n in sorted(histogram, reverse=True):
        left, room = histogram[n], size
        while left and room >= n:
            if not open_[room]:
                room -= 1
                continue
            pattern, count = open_[room].pop()
            some = min(left, count)
            if some < count:
                open_[room].append((pattern, count - some))
            open_[room - n].append(((*pattern, n), some))
            left -= some
        each = size // n
        for pieces, packs in ((each, left // each), (left % each, 1)):
            if pieces and packs:
                open_[size - pieces * n].append(((n,) * pieces, packs))
    return [p for patterns in open_ for p in patterns]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset): which pieces of a length a pattern's slot takes."""
    rank: dict[int, int] = {}
    sequence, out = 0, []
    for lengths, count in patterns:
        offset = 0
        for n in lengths:
            first = rank.get(n, 0)
            out.append((n, first, first + count, sequence, offset))
            rank[n] = first + count
            offset += n
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE, rows_per_rank: int = ROWS_PER_RANK) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Documents are tokenized
    once and cut every ``length`` ids; a rest of LEAST_CUT ids or more is cut in two at a place drawn for each row.
    The driver sees the histogram of lengths (at most ``length`` rows) and builds the patterns; pieces meet their slot
    by their rank within their length. Ranks come from counts by length and salt, a hash of the piece's own number,
    with so many salts that the commonest length has groups of about ``rows_per_rank`` rows, so that no length is
    ranked in one task. Slots are cut at the borders of salts and joined to pieces by length and salt; within these,
    ranks are compared.

    Null text: the empty text, one piece of the id 0. Null or repeated doc_ids and repeated rows are documents of
    their own. Empty table: no rows. Very long texts become many pieces. Other columns may have any names.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, tokenizer, length), "pieces")
    # at most ``length`` rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = 16 + max(histogram.values(), default=0) // rows_per_rank
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(salts)).cast("int"))
    table_ = slots(shortest_pack_first(histogram, length))  # a few for each length, whatever the number of documents
    cols = list(zip(*table_, strict=True)) or [()] * 5
    names = ("length", "a", "b", "sequence", "offset")
    slot_rows = spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in zip(names, cols, strict=True)}))
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    met = firsts.join(slot_rows, "length").where("a < first + n and b > first")
    from_, to = F.greatest("a", "first"), F.least("b", F.col("first") + F.col("n"))
    plan = met.select(
        "length",
        "salt",
        (from_ - F.col("first")).alias("lo"),
        (to - F.col("first")).alias("hi"),
        (F.col("sequence") + from_ - F.col("a")).alias("first_sequence"),
        "offset",
    )
    ranks = Window.partitionBy("length", "salt").orderBy("piece")
    ranked = pieces.withColumn("rank", F.row_number().over(ranks).cast("long") - 1)
    out = ranked.join(plan, ["length", "salt"]).where("rank >= lo and rank < hi")
    sequence = (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence, "offset")


def op9_pack_documents(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
