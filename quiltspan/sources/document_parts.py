"""Where the entries of JSON documents lie in the splits of their files: quotes and braces of Arrow batches, by numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A section's name is read from so many bytes at most; longer keys are of no section.
_NAME = 64
_BLANK = b", \t\r\n\f\v"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """Of each split of a batch the first row and the text, every piece with the brace that ends it."""
    if not batch.num_rows:
        return
    file = batch.column("_file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = batch.column("_start").to_numpy(zero_copy_only=False)
    borders = [0, *(np.flatnonzero((start[1:] != start[:-1]) | (file[1:] != file[:-1])) + 1).tolist(), len(start)]
    for s, e in zip(borders, borders[1:], strict=False):
        ended = pc.binary_join_element_wise(batch.column("value").slice(s, e - s).cast(pa.binary()), b"", b"}")
        offsets = np.frombuffer(ended.buffers()[1], np.int32)[ended.offset : ended.offset + e - s + 1]
        yield s, ended.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes()


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of quotes that are not escaped and of braces, and 1 or -1 for each brace."""
    data = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(data == ord('"'))
    slashes = np.flatnonzero(data == ord("\\"))
    if len(slashes):
        apart = np.diff(slashes) > 1
        first, last = slashes[np.r_[True, apart]], slashes[np.r_[apart, True]]
        quotes = quotes[~np.isin(quotes, last[(last - first) % 2 == 0] + 1)]
    braces = np.flatnonzero((data == ord("{")) | (data == ord("}")))
    return quotes, braces, np.where(data[braces] == ord("{"), 1, -1)


def _name(text: bytes, quotes: np.ndarray, brace: int) -> str:
    """The key of the object that a brace opens; none if it has none, or a longer one than sections have."""
    k = int(np.searchsorted(quotes, brace))
    if k < 2 or text[quotes[k - 1] + 1 : brace].strip() != b":" or quotes[k - 1] - quotes[k - 2] > _NAME:
        return ""
    return text[quotes[k - 2] + 1 : quotes[k - 1]].decode("utf-8", "replace")


@dataclass
class _Count:
    """What a split does to the depth, from a start outside a string or inside one, and the keys of the objects that it
    opens and leaves open, by their depth against the start's."""

    inside: int
    depth: int = 0
    open: dict[int, str] = field(default_factory=dict)

    def add(self, text: bytes, quotes: np.ndarray, braces: np.ndarray, step: np.ndarray) -> None:
        outside = (np.searchsorted(quotes, braces) + self.inside) % 2 == 0
        braces, step = braces[outside], step[outside]
        depth = self.depth + np.cumsum(step)
        self.inside = (self.inside + len(quotes)) % 2
        if not len(depth):
            return
        self.depth = int(depth[-1])
        # a split begins at depth 0 or more, so that sections lie at 2 or less against it
        opened = np.flatnonzero((step > 0) & (depth <= min(2, self.depth)))
        levels, last = np.unique(depth[opened][::-1], return_index=True)
        found = {int(x): _name(text, quotes, int(braces[opened[len(opened) - 1 - k]])) for x, k in zip(levels, last, strict=True)}
        # what was open before and has been left since
        self.open = {k: v for k, v in self.open.items() if k <= int(depth.min())} | found


COUNTS = "_file string, _start long, quotes int, change_0 long, open_0 map<int,string>, change_1 long, open_1 map<int,string>"


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split (``COUNTS``). ``batches``: _file, _start, value, in the order of the rows."""
    done: dict[tuple[str, int], tuple[_Count, _Count]] = {}

    def rows() -> pa.RecordBatch:
        of = list(done.items())
        columns = [pa.array([f for (f, _), _ in of], pa.string()), pa.array([s for (_, s), _ in of], pa.int64()), pa.array([c[0].inside for _, c in of], pa.int32())]
        for k in (0, 1):
            columns += [pa.array([c[k].depth for _, c in of], pa.int64()), pa.array([list(c[k].open.items()) for _, c in of], pa.map_(pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["_file", "_start", "quotes", "change_0", "open_0", "change_1", "open_1"])

    for batch in batches:
        for at, text in _runs(batch):
            place = (batch.column("_file")[at].as_py(), batch.column("_start")[at].as_py())
            if place not in done and done:
                yield rows()
                done.clear()
            both = done.setdefault(place, (_Count(0), _Count(1)))
            marks = _marks(text)
            for c in both:
                c.add(text, *marks)
    yield rows()


ENTRIES = "proteome string, section string, text string, _file string, _start long, part int, ends boolean"


class _Split:
    """A split whose place in its document is known: whether it starts inside a string, at what depth, in what section."""

    def __init__(self, file: str, start: int, inside: int, depth: int, section: str | None):
        self.file, self.start, self.inside, self.depth, self.section = file, start, inside, depth, section
        # text since the last border of an entry; whether that border lies in this split; none outside of a section
        self.pending: list[bytes] | None = [] if depth >= 2 else None
        self.own = False

    def add(self, text: bytes) -> Iterator[tuple[str, bytes, int | None, bool]]:
        """section and text of the entries that end here; a part number where an entry began in an earlier split."""
        quotes, braces, step = _marks(text)
        outside = (np.searchsorted(quotes, braces) + self.inside) % 2 == 0
        braces, step = braces[outside], step[outside]
        depth = self.depth + np.cumsum(step)
        self.inside = (self.inside + len(quotes)) % 2
        self.depth = int(depth[-1]) if len(depth) else self.depth
        borders = np.flatnonzero((depth == 2) | ((depth == 1) & (step < 0)))
        begin = 0
        for at, opens, deep in zip(braces[borders].tolist(), (step[borders] > 0).tolist(), depth[borders].tolist(), strict=True):
            if opens:
                self.section, self.pending, self.own, begin = _name(text, quotes, at), [], True, at + 1
                continue
            if self.pending is not None:
                # an entry of its own ends with its brace; the section's brace ends entries without one
                whole = b"".join([*self.pending, text[begin : at + (deep == 2)]])
                yield self.section or "", whole, None if self.own else 0, True
            self.pending, self.own, begin = ([] if deep == 2 else None), True, at + 1
        if self.pending is not None:
            self.pending.append(text[begin:])

    def rest(self) -> Iterator[tuple[str, bytes, int | None, bool]]:
        """The entry that a later split ends."""
        if self.pending is not None:
            yield self.section or "", b"".join(self.pending), int(self.own), False


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """section and text of every entry (``ENTRIES``), or, with _file, _start and part, of the parts of one that lies in
    several splits: part 1 is its beginning, ``ends`` its end. ``batches``: _file, _start, value, proteome, inside, depth
    and key, in the order of the rows."""
    split: _Split | None = None
    proteome = ""
    out: list[tuple] = []

    def take(found: Iterator[tuple[str, bytes, int | None, bool]], s: _Split) -> None:
        for section, text, part, ends in found:
            if part is not None:
                out.append((proteome, section, text, s.file, s.start, part, ends))
            elif bare := text.strip(_BLANK):
                out.append((proteome, section, bare, None, None, None, True))

    def rows() -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
        columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)]
        columns[2] = columns[2].view(pa.string())
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["proteome", "section", "text", "_file", "_start", "part", "ends"])

    for batch in batches:
        for at, text in _runs(batch):
            file, start, inside, depth, key, name = (batch.column(c)[at].as_py() for c in ("_file", "_start", "inside", "depth", "key", "proteome"))
            if split is None or (split.file, split.start) != (file, start):
                if split is not None:
                    take(split.rest(), split)
                split, proteome = _Split(file, start, inside, depth, key), name
            take(split.add(text), split)
        yield rows()
    if split is not None:
        take(split.rest(), split)
    yield rows()
