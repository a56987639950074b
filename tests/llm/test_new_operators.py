"""Operators 11 to 13 against plain versions, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quiltspan.llm import imatch, lexical_search, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows, more=""):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(*r, "n", 7, True, "k") for r in rows], "doc_id long, text string, word string, n int, key boolean, rid string")


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


# spelling variants


def plain_variants(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    kept = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form, n_near = [], {}, {}
    for w, n in kept.items():
        others = [v for v in kept if near(v, w)]
        n_near[w] = len(others)
        best = min(((-kept[v], v) for v in others), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
    for w, n in kept.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], kept[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("hot", [2_000, 6])
def test_spelling_variants_against_all_pairs(spark, hot):
    rng = random.Random(hot)
    stock = ["".join(rng.choice("abcéñ") for _ in range(rng.randint(5, 7))) for _ in range(60)]
    for w in stock[:50]:
        for _ in range(4):
            k = rng.randrange(len(w))
            stock.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abñ") + w[k + 1 :]]))
    often = [w for w in stock for _ in range(rng.choice([1, 1, 2, 9]))]
    rows = [(k, words(rng, 60, often)) for k in range(80)] + [(k, words(rng, 40, often).title()) for k in range(80, 90)]
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs(spark, rows), hot=hot).collect())
    want = plain_variants(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and len({r[2] for r in want}) < len(want)


def test_spelling_chains_ties_and_odd_rows(spark):
    chain = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "xyxyx": 5, "xyxyz": 9, "zzzzz": 3, "zzzzy": 6, "zzzzx": 6}
    text = " ".join(f"{w} " * n for w, n in chain.items())
    long = "q" * 3_000
    rows = [(1, text), (None, None), (None, ""), (2, f"{long} {long} {long} {long}p {long}p {long}p 12345 ....")]
    rows = [r for r in rows if not r[1] or all(zlib.crc32(f"{r[0]}:{w}".encode()) % 97 for w in re.findall("[a-z]+", r[1]))]
    got = {r["word"]: r for r in spelling.spelling_variants(docs(spark, rows)).collect()}
    assert got["aaaaa"]["form"] == "aaaab" and got["aaaaa"]["root"] == "abbbb"
    assert got["xyxyx"]["form"] is None and got["xyxyx"]["root"] == "xyxyx" and got["xyxyx"]["n_near"] == 1
    assert got["zzzzz"]["form"] == "zzzzx" and got["zzzzz"]["form_n"] == 6  # the first of equals
    assert sorted(tuple(r) for r in got.values()) == plain_variants(rows)
    assert spelling.spelling_variants(docs(spark, rows).limit(0)).count() == 0
    twice = spelling.spelling_variants(docs(spark, [(1, "hello hello"), (1, "hello")])).collect()
    assert [(r["word"], r["n"]) for r in twice] == [("hello", 3)]


def test_one_edit_flips_parities_of_whole_bands(spark):
    """A replaced letter leaves one band of three, an inserted one leaves two; identical masks are no near pair."""
    bits = spelling.letter_bits(spark.createDataFrame([("abcde",), ("éèêzz",)], "word string"))
    assert len({int(bits[ord(c)]) for c in spelling.ALPHABET}) == 90 and bits[[ord(c) for c in spelling.ALPHABET]].max() < 90
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice(spelling.ALPHABET) for _ in range(rng.randint(5, 12)))
        k, c = rng.randrange(len(w)), rng.choice(spelling.ALPHABET)
        masks = spelling.masks_of(spelling.letters_of([w, w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]])[0], bits)
        flips = np.bitwise_count(masks[0] ^ masks[1:])
        assert flips[0].sum() == (2 if c != w[k] else 0) and (flips[0] == 0).any()
        assert flips[1].sum() == 1 and (flips[1] == 0).sum() == 2


# ranked search


def plain_search(rows, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: term.findall((t or "").translate(LOWER))
    bags = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if score > 0:
                scored.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def search(spark, rows, items, **more):
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    return sorted(tuple(r) for r in lexical_search.ranked_search(spark, docs(spark, rows), asked, **more).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("shard", [1 << 20, 300])
@pytest.mark.parametrize("block", [2_000, 3])
def test_search_against_every_document(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical_search, "BLOCK_QUERIES", block)
    rng = random.Random(3)
    stock = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Été", "日本語", "x1", "A-b"]
    texts = [words(rng, rng.choice([1, 5, 30, 200]), stock) for _ in range(300)]
    texts[50:60] = [texts[49]] * 10  # ties
    rows = list(enumerate(texts)) + [(400, None), (401, ""), (402, "-- !!"), (403, words(rng, 20_000, stock))]
    items = [(k, words(rng, rng.choice([1, 3, 12, 40]), stock)) for k in range(12)] + [(20, None), (21, "unheard of"), (22, texts[49])]
    index = lexical_search.build_index
    sized = lexical_search.SHARD_POSTINGS

    def small(d, *a):  # shard bounds go into the tasks with the module's function
        import types

        own = types.FunctionType(index.__code__, {**index.__globals__, "_Shard": type("S", (lexical_search._Shard,), {"full": lambda self: len(self.term) >= shard})}, closure=index.__closure__)
        return own(d, *a)

    if shard < sized:
        monkeypatch.setattr(lexical_search, "build_index", small)
    assert search(spark, rows, items) == plain_search(rows, items)


def test_search_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b c"), (2, "c d e f")]
    got = search(spark, rows, [(1, "a a b"), (1, "c")])
    assert [r[1] for r in got] == [1, 2, 3, 4] and [r[2] for r in got if r[3] == got[1][3]][:2] == [1, 1]
    assert search(spark, [], [(1, "a")]) == [] and search(spark, rows, []) == []
    assert search(spark, [(1, None)], [(1, "a")]) == []


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    for n_docs in (1, 2, 7, 64, 300):
        lists = [np.sort(rng.choice(n_docs, rng.integers(1, n_docs + 1), replace=False)) for _ in range(6)]
        impacts = [rng.integers(1, 9, len(x)) for x in lists]
        order = [np.lexsort((x, -i)) for x, i in zip(lists, impacts, strict=True)]
        seq, imp = (np.concatenate([x[o] for x, o in zip(y, order, strict=True)]) for y in (lists, impacts))
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        depth = max(n_docs - 1, 0).bit_length()
        tree = lexical_search.WaveletTree(imp.astype(np.int32), lexical_search.WaveletTree.build(seq, depth))
        for chosen in ([0], [1, 3], list(range(6))):
            w = rng.integers(1, 5, len(chosen))
            total = Counter()
            for c, x in zip(chosen, w, strict=True):
                for d, i in zip(lists[c], impacts[c], strict=True):
                    total[int(d)] += int(x * i)
            want = sorted((-s, d) for d, s in total.items())[:5]
            assert tree.top(starts[chosen], starts[np.array(chosen) + 1], w, 5) == [(-s, d) for s, d in want]


# I-Match


@pytest.mark.parametrize("bucket_rows", [5_000, 7])
def test_fingerprints_against_sql(spark, bucket_rows):
    rng = random.Random(4)
    stock = [f"w{int(rng.paretovariate(0.4))}" for _ in range(900)]
    rows = [(k * 3 - 40, words(rng, rng.choice([1, 4, 40, 150]), stock)) for k in range(120)]
    rows += [(500, None), (501, ""), (502, rows[3][1]), (503, rows[3][1]), (504, words(rng, 9_000, stock)), (505, "É é\tÉ\nx")]
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs(spark, rows), bucket_rows).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    want = {r[0]: r for r in con.execute(imatch.OP11_SQL).fetchall()}
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == want
    texts = dict(rows)
    ids = sorted(texts)
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        x, y = texts[a] or "", texts[b] or ""
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        assert got[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[a]["n_chars"] == len(x)
    assert got[502]["fingerprint"] == got[503]["fingerprint"] and got[502]["near_next"] == 1.0
    assert got[500]["fingerprint"] == got[501]["fingerprint"] and got[500]["near_next"] == 1.0


def test_fingerprints_odd_rows(spark):
    assert imatch.fingerprints(docs(spark, []).limit(0)).count() == 0
    one = imatch.fingerprints(docs(spark, [(5, "only one here")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    rows = [(1, "same text"), (1, "same text"), (1, "same text"), (None, "a"), (None, None), (2, "other words altogether")]
    got = imatch.fingerprints(docs(spark, rows), bucket_rows=2).collect()
    assert len(got) == 6
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len({r["fingerprint"] for r in by[1]}) == 1 and sorted(r["near_next"] for r in by[1]) == [0.0, 1.0, 1.0]


def test_fingerprints_of_many_copies(spark):
    """A text of which a third are copies does not make its terms look common."""
    rng = random.Random(6)
    stock = [f"t{k}" for k in range(3_000)]
    copy = words(rng, 60, [f"c{k}" for k in range(80)])
    rows = [(k, copy if k % 3 == 0 else words(rng, 60, stock)) for k in range(300)]
    got = imatch.fingerprints(docs(spark, rows)).collect()
    copies = [r for r in got if r["doc_id"] % 3 == 0]
    assert len({r["fingerprint"] for r in copies}) == 1 and len(copies[0]["fingerprint"]) > 8
    near = [r["near_edited"] for r in got]
    assert sum(near) / len(near) > 0.15 and sum(r["near_next"] for r in got) / len(got) < 0.05
