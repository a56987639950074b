"""Toxicity: a weighted finite-state grammar over clauses, with a lexicon and clause weights learned from labels."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterator, Sequence
from functools import cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_batches

#: At most so many labelled texts are learned from, the first in the order of a hash of the text.
MAX_TRAINING = 20_000
THRESHOLD = 0.7
#: A term enters the lexicon if the lower bound (so many standard errors) of its log odds ratio is above this.
ERRORS, LEAST_WEIGHT, LEAST_DOCS = 3.0, 0.7, 6
PREFIXES = range(4, 10)

# Fixed word lists of the grammar.
INSULTS = frozenset("idiot idiots moron morons imbecile stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns pig pigs vermin filth bastard bitch asshole dummkopf abschaum dreckskerl connard salaud ordure imbécile idiota imbécil basura escoria".split())
THREATS = frozenset("kill destroy hurt beat smash stab shoot strangle murder burn crush töten vernichten umbringen tuer frapper détruire matar destruir golpear".split())
TARGETS = frozenset("you your yours yourself he she they them him her people everyone du dich dir ihr euch sie tu toi vous ils eux elles tú te usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not no never isn't aren't don't doesn't didn't won't without kein keine nicht nie ne pas jamais sans nunca jamás sin".split())
REPORTS = frozenset("said says say wrote writes called calls claimed claims reported quoted according sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según".split())
INTENSIFIERS = frozenset("such complete completely total totally absolute absolutely utter utterly so really völlig total echt wirklich complètement vraiment tellement totalmente realmente tan".split())
INTENTS = frozenset("will i'll we'll gonna going shall should must werde werden soll vais va allons voy vamos".split())
SPAN = 4  # words that a negation, a target, an intensifier or an intent reaches

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]|[\"“”«»]")
_WORDS = re.compile(r"[^\W\d_]+")

#: What the machines read and write. Words are OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT, INTENSE or INTENT;
#: REPORTED, NEGATED, AIMED and MEANT are what insults and threats become.
OTHER, TARGET, NEGATION, REPORT, END, COLON, QUOTE, INSULT, THREAT, REPORTED, NEGATED, AIMED, MEANT, INTENSE, INTENT = range(15)
SYMBOLS = range(15)
FEATURES = ("plain", "aimed", "negated", "reported", "threat", "best", "density", "count")
_CLASS = {INSULT: 0, AIMED: 1, NEGATED: 2, REPORTED: 3, MEANT: 4}

State = Hashable


class Transducer:
    """A deterministic weighted transducer: arcs (state, symbol) -> (next state, symbol written, weight added)."""

    def __init__(self, start: State, rule: Callable[[State, int], tuple[State, int, float]]) -> None:
        """The states that ``rule`` reaches from ``start``, and their arcs, each once."""
        self.start = start
        self.arcs: dict[tuple[State, int], tuple[State, int, float]] = {}
        todo, seen = [start], {start}
        while todo:
            state = todo.pop()
            for symbol in SYMBOLS:
                arc = rule(state, symbol)
                self.arcs[state, symbol] = arc
                if arc[0] not in seen:
                    seen.add(arc[0])
                    todo.append(arc[0])

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes; weights add up."""

        def rule(state: State, symbol: int) -> tuple[State, int, float]:
            p, middle, w = self.arcs[state[0], symbol]
            q, out, v = other.arcs[state[1], middle]
            return (p, q), out, w + v

        return Transducer((self.start, other.start), rule)

    def table(self) -> tuple[list[int], list[int], list[float]]:
        """Next place, symbol written and weight by place + symbol; the start is at 0."""
        names = [self.start, *({s for s, _ in self.arcs} - {self.start})]
        place = {s: k * len(SYMBOLS) for k, s in enumerate(names)}
        rows = [self.arcs[s, x] for s in names for x in SYMBOLS]
        return [place[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    def run(self, symbols: Sequence[int]) -> tuple[list[int], list[float]]:
        state, out, weights = self.start, [], []
        for x in symbols:
            state, y, w = self.arcs[state, x]
            out.append(y)
            weights.append(w)
        return out, weights


def reported_speech(weight: float = -1.6) -> Transducer:
    """From a word of saying to the end of its clause, or of the quotation, insults and threats are REPORTED."""

    def rule(state: State, x: int) -> tuple[State, int, float]:
        said, quoted = state
        if x == QUOTE:
            return (said, not quoted), x, 0.0
        if x == REPORT:
            return (True, quoted), x, 0.0
        if x in (END, COLON):
            return (said and (quoted or x == COLON), quoted), x, 0.0
        return (state, REPORTED, weight) if said and x in (INSULT, THREAT) else (state, x, 0.0)

    return Transducer((False, False), rule)


def quoted_before(weight: float = -1.6) -> Transducer:
    """Read backwards: insults and threats of a quotation that a word of saying follows, within SPAN words in the same
    clause, are REPORTED. States: words since the word of saying, SPAN + 1 for none, and whether in a quotation, and
    whether in one of that kind."""
    none = SPAN + 1

    def rule(state: State, x: int) -> tuple[State, int, float]:
        since, quoted, said = state
        if x == QUOTE:
            return (none, not quoted, not quoted and since <= SPAN), x, 0.0
        if quoted:
            return (state, REPORTED, weight) if said and x in (INSULT, THREAT, NEGATED, AIMED, MEANT) else (state, x, 0.0)
        if x in (END, COLON):
            return (none, False, False), x, 0.0
        return (0 if x == REPORT else min(since + 1, none), False, False), x, 0.0

    return Transducer((none, False, False), rule)


def _after(opener: int, changes: dict[int, int], weight: float) -> Transducer:
    """Within SPAN words after ``opener``, in its clause, symbols change. States: words since then, SPAN + 1 for none."""

    def rule(state: State, x: int) -> tuple[State, int, float]:
        if x in (END, COLON):
            return SPAN + 1, x, 0.0
        if x == QUOTE:
            return state, x, 0.0
        since = 0 if x == opener else min(state + 1, SPAN + 1)
        return (since, changes[x], weight) if x in changes and since <= SPAN else (since, x, 0.0)

    return Transducer(SPAN + 1, rule)


def insult(weight: float = 0.3) -> Transducer:
    """An insult after an intensifier weighs more."""
    return _after(INTENSE, {INSULT: INSULT}, weight)


def threat(weight: float = 0.3) -> Transducer:
    """A threat after a word of intent weighs more."""
    return _after(INTENT, {THREAT: THREAT}, weight)


def negation(weight: float = -0.9) -> Transducer:
    return _after(NEGATION, {INSULT: NEGATED, THREAT: NEGATED}, weight)


def target(weight: float = 0.4) -> Transducer:
    """An insult after a target is AIMED, and a threat is MEANT. Read backwards, it is before a target."""
    return _after(TARGET, {INSULT: AIMED, THREAT: MEANT}, weight)


@cache
def grammar() -> tuple[tuple, tuple]:
    """The tables of the composed machine, and of the one that reads its output backwards."""
    forwards = insult().then(threat()).then(reported_speech()).then(negation()).then(target())
    return forwards.table(), quoted_before().then(target()).table()


def terms(text: str) -> set[str]:
    """Words, and word beginnings (marked by ``*``) of PREFIXES letters."""
    out = set(_WORDS.findall(text.lower()))
    return out | {w[:k] + "*" for w in out for k in PREFIXES if len(w) > k}


class Grammar:
    """Insult and threat lexica, and the composition of the insult, threat, reported-speech, negation and target
    transducers.

    A text's words become symbols; the composed machine reads them once forwards, and that of quotations and targets
    reads what it wrote backwards, for words of saying and targets that follow. Each insult or meant threat comes out
    as one class, with its weight in the lexicon times the exponential of the weights of its arcs.
    """

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = {w: 2.0 for w in INSULTS} | lexicon
        marks = [(".!?;\n", END), (":", COLON), ('"“”«»', QUOTE)]
        self.known: dict[str, tuple[int, float]] = {c: (x, 0.0) for cs, x in marks for c in cs}
        self.known |= {w: (x, 0.0) for ws, x in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in ws}

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol, and the largest weight among the word and its beginnings."""
        lex = self.lexicon
        w = max([lex.get(word, 0.0), *(lex.get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) > k)])
        got = (INSULT, w) if w > 0 else (THREAT, 2.0) if word in THREATS else (INTENSE if word in INTENSIFIERS else INTENT if word in INTENTS else OTHER, 0.0)
        if len(self.known) < 200_000:
            self.known[word] = got
        return got

    def features(self, text: str | None) -> list[float]:
        """FEATURES of a whole text: weights by class, the heaviest clause, weight per word, matches."""
        sums = [0.0] * 5
        known, symbol = self.known, self.symbol
        read = [known.get(t) or symbol(t) for t in _TOKEN.findall((text or "").lower())]
        matches = best = 0
        if any(w for _, w in read):
            (to, write, weight), (back_to, back_write, back_weight) = grammar()
            state, wrote, gained = 0, [], []
            for x, _ in read:
                at = state + x
                state = to[at]
                wrote.append(write[at])
                gained.append(weight[at])
            state = 0
            clause = 0.0
            for k in range(len(read) - 1, -1, -1):
                at = state + wrote[k]
                state = back_to[at]
                x = back_write[at]
                kind = _CLASS.get(x)
                if kind is not None and read[k][1]:
                    matches += 1
                    sums[kind] += read[k][1]
                    clause = max(clause, read[k][1] * exp(gained[k] + back_weight[at]))
                elif x in (END, COLON):
                    best, clause = max(best, clause), 0.0
            best = max(best, clause)
        words = sum(x != END and x != COLON and x != QUOTE for x, _ in read)
        return [*sums, best, 100 * sum(sums) / (words + 50), float(matches)]


def _design(rows: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(rows, 0))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept first) by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """text, toxic of at most ``most`` different texts of labelled documents outside the held-out fold
    (crc32(doc_id) mod 3 = 1): the first in the order of a hash of the text, toxic if any of its labels is 1.

    Labels without a document take no part, and a doc_id or text that repeats counts once.
    """
    marks = labels.where("doc_id is not null and toxic is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keyed = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("h"))
    met = keyed.select("doc_id", "h").join(marks, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    chosen = cut(met.orderBy("h").limit(most), "toxicity-chosen")
    # the choice has at most ``most`` rows of three numbers, a proven bound
    return keyed.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> tuple[dict[str, float], tuple | None]:
    """The lexicon (term -> weight) and the logistic weights over FEATURES.

    A term's weight is the lower bound of its log odds ratio between toxic and other documents. Terms are counted in
    Spark; what comes to the driver is the lexicon, whose size the number of training rows bounds, and one row of
    FEATURES per training row. Half of the rows, by a hash of the text, give the lexicon, and the other half the
    clause weights, so that neither is fitted to what the other has seen.
    """
    rows = cut(training_rows(text_batches(docs), labels, most).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))), "toxicity-training")
    sizes = {r["toxic"]: r["n"] for r in rows.where("half = 0").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return {}, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text"), batch.column("toxic"), strict=True):
                for t in terms(text.as_py() or ""):
                    a.setdefault(t, [0, 0])[y.as_py() != 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(a)), pa.array([v[0] for v in a.values()], pa.int64()), pa.array([v[1] for v in a.values()], pa.int64())], names=["term", "n", "p"])

    counted = rows.where("half = 0").select("text", "toxic").mapInArrow(run, "term string, n long, p long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).where(f"p >= {LEAST_DOCS}")
    odds = F.expr(f"ln((p + 0.5) / ({pos} - p + 0.5)) - ln((n + 0.5) / ({neg} - n + 0.5)) - {ERRORS} * sqrt(1 / (p + 0.5) + 1 / (n + 0.5))")
    lexicon = {r["term"]: float(r["w"]) for r in counted.withColumn("w", odds).where(f"w > {LEAST_WEIGHT}").collect()}
    got = rows.where("half = 1").select("text", "toxic").mapInArrow(_featured(lexicon, ["toxic"]), "toxic int, f array<double>").collect()
    x, y = np.array([r["f"] for r in got], float), np.array([r["toxic"] for r in got], float)
    if len(set(y.tolist())) < 2:
        return lexicon, None
    return lexicon, fit_logistic(_design(x), y)


def _featured(lexicon: dict[str, float], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            f = [grammar.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(f, pa.list_(pa.float64()))], names=[*keep, "f"])

    return run


def score_column(lexicon: dict[str, float], fitted: tuple | None):
    """A function of a text column that gives the score, 0 to 1. Without fitted weights it counts known insults."""
    grammars: list[Grammar] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not grammars:
            grammars.append(Grammar(lexicon))
        x = np.array([grammars[0].features(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))
        if fitted is None:
            return pa.array(1 - np.exp(-x[:, 5] / 2) if len(x) else [], pa.float64())
        mean, scale, w = fitted
        z = w[0] + ((_design(x) - mean) / scale) @ w[1:]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text; only the text enters a score.

    Learned from the labelled documents whose crc32(doc_id as text) mod 3 is not 1, at most ``most`` different texts. Null
    and empty texts score like a text without a match. Null doc_id: not held out. Repeated rows are scored each.
    Without usable labels the fixed word list alone scores. Empty tables give no rows. Other columns may have any names.
    """
    score = score_column(*train(docs, labels, most))
    held = F.coalesce(F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"), F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
