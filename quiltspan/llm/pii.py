"""Personal data: exact patterns, and identifiers found after offset-preserving deobfuscation."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_batches

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same addresses in linear time: a digit run is tried from its start alone and is never given back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
# Rewriting rules of the transducers. Letters that look like ASCII ones:
LOOKALIKES = dict(
    zip(
        "аеіјорсухѕԁһӏкАВЕЗІЈКМНОРСТУХ" + "αεικορυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeijopcyxsdhlkABE3IJKMHOPCTYX" + "aeikopuvABEZHIKMNOPTYX",
        strict=True,
    )
)
LOOKALIKES |= {chr(z + k): str(k) for z in (0x0660, 0x06F0, 0x0966) for k in range(10)}  # other decimal digits
# full-width, mathematical and enclosed forms: every character that compatibility makes one ASCII letter, digit or mark,
# but for ordinals and raised digits, which ordinary text has
LOOKALIKES |= {chr(c): n for c in (*range(0x2100, 0x2190), *range(0x2460, 0x24F0), *range(0xFE50, 0xFF60), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA)) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and "!" <= n <= "~"}
LOOKALIKES |= {"․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
INVISIBLE = "­​‌‍⁠﻿"
#: English, German, French and Spanish.
DIGITS = {
    w: str(k)
    for k, ws in enumerate(("zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"))
    for w in ws.split()
}

_ODD = re.compile("[" + "".join(map(re.escape, [*LOOKALIKES, *INVISIBLE])) + "]")
_NAMED = "|".join(DIGITS)
#: Digits in a row of which some may be spelled.
_SPELLED = re.compile(rf"(?<![^\W_])(?:\+\s?|(?:plus|más)[\s-]+)?(?:(?:{_NAMED}|[0-9]+)[\s.()-]{{1,3}})+(?:{_NAMED}|[0-9]+)(?![^\W_])", re.I)
_DIGIT_WORD = re.compile(rf"(?<![^\W_])(?:{_NAMED})(?![^\W_])", re.I)
_PLUS_WORD = re.compile(r"(?:plus|más)[\s-]+", re.I)
_GAP = re.compile(r"[\s-]{1,3}(?=[A-Za-z0-9])")
_NAME, _LABEL = r"[A-Za-z0-9._%+-]{1,64}", r"[A-Za-z0-9-]{1,63}"
_AT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:at|@|arroba)\s{0,3}[\])}>]\s{0,3}|\s{1,3}at\s{1,3}|\s{0,3}@\s{0,3})"
_DOT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:dot|punkt|point|punto|\.)\s{0,3}[\])}>]\s{0,3}|\s{1,3}dot\s{1,3}|\s{1,2}\.\s{1,2}|\.)"
#: Without brackets only an address in one of these domains is one: "look at the dot on it" has the form of another.
_DOMAINS = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv eu de fr es it nl be at ch uk ie us ca au nz in jp cn ru br mx pl se no fi dk pt gr cz".split())
_DOMAINS |= frozenset("online shop site xyz club tech store blog news email cloud live pro art top space website agency example test invalid".split())
#: A disguised address has a bracketed or spelled dot, or a bracketed at sign.
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}(?P<at>{_AT}){_LABEL}(?P<rest>(?:{_DOT}{_LABEL})+)", re.I)
_BRACKETED = re.compile(r"[\[({<]\s{0,3}(?:at|@|arroba|dot|punkt|point|punto|\.)\s{0,3}[\])}>]", re.I)
_DOT_WORD = re.compile(r"[Dd][Oo][Tt]\s")
_APART = re.compile(r"@\s|\s@|@\S{1,64}\s\.\s")
_ODD_ONES = frozenset([*LOOKALIKES, *INVISIBLE])
#: Addresses of numbers with disguised dots, and card numbers in four groups with another mark between them.
_IP_DOT = r"(?:\s{0,2}[\[({<]\s{0,2}(?:dot|punkt|point|punto|\.)\s{0,2}[\])}>]\s{0,2}|\s{1,2}dot\s{1,2}|\.)"
_HIDDEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_IP_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_IP_DOT_PART = re.compile(_IP_DOT, re.I)
_GROUPED = re.compile(r"(?<![0-9])[0-9]{4}([._/,:]|\s[-–]\s|\s{2,3})[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_DOT_PART = re.compile(_DOT, re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split("."))
    digits = "".join(c for c in s if c in "0123456789")
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of PATTERNS["email"], found from the at signs: in linear time also where long runs of letters,
    which the pattern would try from each of their places, lead to no sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def exact(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that do not overlap; those that fail their test are dropped without retry."""
    out = []
    out += [("email", s, e) for s, e in emails(text)]
    for kind in KINDS[1:]:
        if kind == "phone" and "+" not in text:
            continue
        for m in (_IP if kind == "ip" else PATTERNS[kind]).finditer(text):
            if _valid(kind, m[0]):
                out.append((kind, m.start(), m.end()))
    return out


class Tape:
    """A text under rewriting with, for each of its characters, the source span [first, last) that it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.first, self.last = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by a string, for ordered edits that do not overlap; each new character stands for all of it."""
        if not edits:
            return
        text, first, last, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a] + new)
            first += self.first[at:a] + [self.first[a]] * len(new)
            last += self.last[at:a] + [self.last[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.first, self.last = first + self.first[at:], last + self.last[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.first[a], self.last[b - 1]


def _spelled_edits(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """The edits, and the runs that as spelled have the digits of a phone number (a plus need not be spelled).

    Four spelled digits make a run; fewer do if the number is valid as a whole, with a plus or as a card number.
    """
    edits, runs = [], []
    for m in _SPELLED.finditer(text):
        words = list(_DIGIT_WORD.finditer(text, m.start(), m.end()))
        if not words:
            continue
        plus = _PLUS_WORD.match(m[0])
        digits = _DIGIT_WORD.sub(lambda x: DIGITS[x[0].lower()], m[0])
        phone = (plus or "+" in text[max(0, m.start() - 1) : m.start() + 1]) and _valid("phone", digits)
        if len(words) < 4 and not phone and not _valid("card", digits):
            continue
        if plus:
            edits.append((m.start(), m.start() + plus.end(), "+"))
        for x in words:  # white space after a digit word joins it to the next digit
            gap = _GAP.match(text, x.end(), m.end())
            edits.append((x.start(), gap.end() if gap else x.end(), DIGITS[x[0].lower()]))
        if 8 <= len(words) + sum(c in "0123456789" for c in m[0]) <= 15:
            runs.append((m.start(), m.end()))
    return edits, runs


def _disguise_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _DISGUISED.finditer(text):
        at, rest = m["at"].strip(), m["rest"]
        dots = [d for d in _DOT_PART.finditer(rest)]
        marked = any(d[0] != "." for d in dots)
        known = rest[dots[-1].end() :].lower() in _DOMAINS
        if at[:1] in tuple("[({<") or known and (marked or at == "@" and m["at"] != "@"):
            edits.append((m.start("at"), m.end("at"), "@"))
            edits += [(m.start("rest") + d.start(), m.start("rest") + d.end(), ".") for d in dots if d[0] != "."]
    return edits


def _number_edits(text: str) -> list[tuple[int, int, str]]:
    edits = [(m.start() + d.start(), m.start() + d.end(), ".") for m in _HIDDEN_IP.finditer(text) for d in _IP_DOT_PART.finditer(m[0]) if d[0] != "."]
    edits += [(m.start() + k, m.start() + k + len(m[1]), "-") for m in _GROUPED.finditer(text) for k in (4, 8 + len(m[1]), 12 + 2 * len(m[1]))]
    return sorted(edits)


def _hint(text: str) -> bool:
    return bool(_BRACKETED.search(text) or _DOT_WORD.search(text) or "@" in text and _APART.search(text))


def hidden(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that show only after normalisation and that no span of their kind in ``found`` contains."""
    odd = not text.isascii() and not _ODD_ONES.isdisjoint(text)
    spelled = _DIGIT_WORD.search(text) is not None and bool(_spelled_edits(text)[0])
    grouped = _GROUPED.search(text) is not None
    if not (odd or spelled or grouped or _hint(text)):
        return []
    tape = Tape(text)
    if odd:
        tape.rewrite([(m.start(), m.end(), LOOKALIKES.get(m[0], "")) for m in _ODD.finditer(text)])
    runs = []
    if _DIGIT_WORD.search(tape.text):
        edits, runs = _spelled_edits(tape.text)
        runs = [tape.source(a, b) for a, b in runs]
        tape.rewrite(edits)
    if _hint(tape.text):
        tape.rewrite(_disguise_edits(tape.text))
    if grouped or odd or spelled or _hint(tape.text):
        tape.rewrite(_number_edits(tape.text))
    if tape.text == text:
        return []
    contains = {kind: _container([(s, e) for k, s, e in found if k == kind]) for kind in KINDS}
    out = []
    for kind, a, b in exact(tape.text):
        s, e = tape.source(a, b)
        if not contains[kind](s, e):
            out.append((kind, s, e))
    within = _container([(s, e) for _, s, e in found + out])
    return out + [("phone", s, e) for s, e in runs if not within(s, e)]


def _container(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether one of the spans contains [s, e), by the furthest end of those that start no later."""
    spans = sorted(spans)
    starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    return lambda s, e: (k := bisect_right(starts, s)) > 0 and ends[k - 1] >= e


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start. Offsets are code points, ends exclusive."""
    text = text or ""
    base = exact(text)
    return base, sorted(base + hidden(text, base), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def mask(text: str | None) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans(text)[1]):
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]]) if out else text


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, has_pii for every whole text.

    The counts and the digest are of the exact patterns; ``spans`` also has what normalisation uncovers. Look-alike
    characters, invisible characters, spelled digits and at/dot disguises are rewritten by transducers that keep, for
    every character they put out, the source span it stands for; a match is thus mapped back to the source text, and
    added unless an exact one of its kind contains it. Spans of a kind may thus overlap; masking joins them.
    ``n_spans`` counts all of them and ``has_pii`` tells whether there are any.

    Limits of the disguises: a local part of up to 64 and labels of up to 63 characters (those of mail itself), and,
    where neither the at sign nor a dot is in brackets, one of the top-level domains in _DOMAINS.

    Null text counts as empty (all counts 0, empty spans). Repeated rows and null ids get a row each, empty tables
    none. Long texts are read whole, in time that grows as their length. Other columns may have any names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "has_pii"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for t in batch.column("text"):
                base, all_ = spans(t.as_py())
                counts = [sum(s[0] == x for s in base) for x in KINDS]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                for col, value in zip(cols, (*counts, digest, _joined(all_), len(all_), bool(all_)), strict=True):
                    col.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, has_pii boolean"
    return text_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` masked and, where it is there, n_chars set anew; null texts stay null."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([mask(t.as_py()) for t in texts], pa.string())

    out = text_batches(docs).withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_pii_spans(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
