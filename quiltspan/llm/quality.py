"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_batches

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5

#: Every rule's measure lies in [0, 1] and grows with badness; it is binned in BINS equal steps.
RULES = ("symbols_per_word", "repeated_words", "duplicate_lines", "upper_case", "punctuation", "one_word")
BINS = 200
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{r} double" for r in RULES)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a WINDOW-word window found twice or more in the text, the first included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    codes = ids[: n - WINDOW + 1].copy()
    for k in range(1, WINDOW):  # renumbered after each word, so that equal codes are equal windows
        _, codes = np.unique(codes, return_inverse=True) if k > 1 else (None, codes)
        codes = codes * len(number) + ids[k : n - WINDOW + 1 + k]
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    starts = counts[inverse] > 1
    if not starts.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple:
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeated_words(words)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marks = sum(w[-1] in "!?" and w[-2:-1] == w[-1] for w in words)
    top = Counter(words).most_common(1)[0][1] if n else 0
    share = max(n, 1)
    # occurrences of the commonest word, less what chance adds to so many (two deviations)
    top = max(0.0, top - 2 * math.sqrt(top))
    return n, chars, symbols, dup, repeat, min(1.0, symbols / share), repeat / share, dup / max(lines, 1), upper / share, marks / share, top / share


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the measures of every whole text."""
    id_type, names = docs.schema["doc_id"].dataType.simpleString(), ["doc_id", "lang"] + [x.split()[0] for x in METRICS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(measure(t.as_py()) for t in batch.column("text")), strict=True)) or [[]] * (len(names) - 2)
            arrays = [pa.array(c, pa.int64() if k < 5 else pa.float64()) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *arrays], names=names)

    return text_batches(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, f"doc_id {id_type}, lang string, {METRICS}")


def _beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a binomial share, k of n seen, at confidence 1 - alpha: the share at
    which k or fewer have the probability alpha, which is an incomplete beta function of it."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(50):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if _beta_share(1 - p, n - k, k + 1) > alpha else (lo, p)
    return hi


def least_labels(risk: float, alpha: float, strata: int) -> int:
    """The good labels that a stratum needs for any rule to pass: with so many, none of them rejected bounds the
    risk."""
    return math.ceil(math.log(alpha / (strata * len(RULES))) / math.log1p(-risk / len(RULES)))


def cutoff(good: np.ndarray, bad: np.ndarray, risk: float, alpha: float, cost: float) -> int:
    """The bin from which on one rule rejects documents of one stratum; BINS + 1: none.

    ``good`` and ``bad``: labelled documents by bin. Cutoffs are tested in fixed order from the mildest on, and
    testing stops at the first whose exact upper bound exceeds the risk; that needs no correction among them. Of the
    cutoffs that passed, the one in force rejects most of the bad labels, less ``cost`` times the share of the good
    ones; among equals, the middle one.
    """
    n, above, last, bound, passed = int(good.sum()), 0, -1, 1.0, []
    for b in range(BINS, 0, -1):
        above += int(good[b])
        if above != last:
            bound, last = upper_bound(above, n, alpha) if n else 1.0, above
        if bound > risk:
            break
        passed.append(b)
    if not passed or not bad.sum():
        return BINS + 1
    gain = [bad[b:].sum() / bad.sum() - cost * good[b:].sum() / n for b in passed]
    best = [b for b, x in zip(passed, gain, strict=True) if x >= max(gain) - 1e-12]
    return best[len(best) // 2] if max(gain) > 0 else BINS + 1


def _strata(held: DataFrame, risk: float, alpha: float) -> tuple[DataFrame, bool, int]:
    """(lang, good) of the languages, with ``named`` where they have labels enough for a stratum of their own; whether
    the others have together; and the number of strata."""
    sizes = cut(held.groupBy("lang").agg(F.sum((F.col("_quality") == 1).cast("long")).alias("good")), "languages")
    most = sizes.where(F.col("good") >= least_labels(risk, alpha, 1)).count() + 2
    least = least_labels(risk, alpha, most)
    small = sizes.where(F.col("good") < least).agg(F.sum("good")).first()[0] or 0
    named = sizes.where(F.col("good") >= least).count()
    return sizes.withColumn("named", F.col("good") >= least), small >= least, named + (small >= least) + 1


def cutoffs(m: DataFrame, labels: DataFrame, risk: float, alpha: float, cost: float) -> tuple[DataFrame, DataFrame]:
    """(lang, stratum) of the labelled languages, and per stratum and rule: good, bad, cutoff, rejected_good,
    rejected_bad, bound (the exact upper bound of the share of good documents that the rule rejects).

    The strata are each language with labels enough (``least_labels``), the other labelled ones together if those have
    enough, and all labels, for languages without labels of their own and where the others have too few. Each rule of
    a stratum gets the share ``risk / rules`` of the tolerated false rejections and ``alpha / (strata * rules)`` of
    the error (Bonferroni). Labels are counted by stratum, rule and bin in Spark, and each stratum's counts, which are
    a table of fixed size, select its cutoffs in a task of their own.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    held = cut(m.where("n_words > 0").join(marks, "doc_id").select("lang", "_quality", *RULES), "quality-holdout")
    sizes, pooled, n_strata = _strata(held, risk, alpha)
    own = F.when(F.col("named"), F.concat(F.lit("lang "), "lang")).otherwise(F.lit("small" if pooled else "all"))
    strata = sizes.select("lang", own.alias("stratum"))
    bins = F.array(*[F.struct(F.lit(r).alias("rule"), F.least(F.lit(BINS), F.floor(F.col(r) * BINS)).cast("int").alias("bin")) for r in RULES])
    binned = held.select("lang", "_quality", F.explode(bins).alias("b")).select("lang", "_quality", "b.rule", "b.bin")
    by_lang = binned.groupBy("lang", "_quality", "rule", "bin").agg(F.count(F.lit(1)).alias("n"))
    both = by_lang.join(strata, "lang").select(F.explode(F.array_distinct(F.array("stratum", F.lit("all")))).alias("stratum"), "_quality", "rule", "bin", "n")
    counts = both.groupBy("stratum", "_quality", "rule", "bin").agg(F.sum("n").alias("n"))
    each_risk, each_alpha = risk / len(RULES), alpha / (n_strata * len(RULES))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rule in RULES:
            g, w = np.zeros(BINS + 1, np.int64), np.zeros(BINS + 1, np.int64)
            mine = rows[rows["rule"] == rule]
            is_good = mine["_quality"] == 1
            np.add.at(g, mine["bin"][is_good], mine["n"][is_good])
            np.add.at(w, mine["bin"][~is_good], mine["n"][~is_good])
            at = cutoff(g, w, each_risk, each_alpha, cost)
            lost = int(g[at:].sum())
            out.append((rows["stratum"].iloc[0], rule, int(g.sum()), int(w.sum()), at, lost, int(w[at:].sum()), upper_bound(lost, int(g.sum()), each_alpha)))
        return pd.DataFrame(out, columns=["stratum", "rule", "good", "bad", "cutoff", "rejected_good", "rejected_bad", "bound"])

    kinds = "stratum string, rule string, good long, bad long, cutoff int, rejected_good long, rejected_bad long, bound double"
    return strata, cut(counts.groupBy("stratum").applyInPandas(choose, kinds), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.12, alpha: float = 0.05, cost: float = 20.0) -> DataFrame:
    """All measures and stratum, rejected_by, base_failed, kept for every document.

    The labelled documents are the holdout and the languages the strata (``cutoffs``), so that per stratum the rules
    together reject at most the share ``risk`` of good documents, in all strata at once with confidence 1 - ``alpha``.
    That is what is promised; the cutoffs in force reject far fewer (README), since ``cost`` weighs a good document
    lost as 20 bad ones. The rule ``one_word`` takes the share of the commonest word's occurrences beyond what
    chance gives so few of them (two deviations), so that it means the same in short texts and long ones.

    Null or empty text: no words, base_failed. Null lang: the language ''. Labels without a document, documents
    without a label and null labels are ignored in the holdout; a doc_id labelled more than once counts once, good if
    any of its labels is 1. Without labels nothing is rejected beyond the base. Repeated rows are judged each. Empty
    tables give no rows. Other columns may have any names.
    """
    m = cut(measures(docs), "measures").withColumn("lang", F.coalesce("lang", F.lit("")))
    strata, chosen = cutoffs(m, labels, risk, alpha, cost)
    limits = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    # one row a language, joined by the size that Spark sees; and the cutoffs of all labels, a number for each rule
    rows = m.join(strata.join(limits, "stratum"), "lang", "left")
    known = {r["rule"]: r["cutoff"] for r in chosen.where("stratum = 'all'").collect()}
    all_ = F.create_map(*[F.lit(x) for r in RULES for x in (r, known.get(r, BINS + 1))])
    rows = rows.withColumns({"stratum": F.coalesce("stratum", F.lit("all")), "limits": F.coalesce("limits", all_)})
    over = [F.when(F.floor(F.col(r) * BINS) >= F.col("limits")[r], F.lit(r)) for r in RULES]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.withColumns({"rejected_by": F.array_compact(F.array(*over)), "base_failed": failed}).drop("limits")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op6_quality_rules(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
