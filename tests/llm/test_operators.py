"""The ten operators against brute force, round trips and held-out labels, and on odd inputs."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quiltspan.llm import embedding, html, mixing, packing, pii, quality, simhash, toxicity, url_filter, warc
from quiltspan.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def docs(spark, texts, **more):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as size", "1 as fp", "2 as key", "3 as score", "4 as length", "5 as rank", "6 as n_words", "7 as stratum", "8 as fingerprint", "9 as target", "10 as salt")


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 450)]
    want = components(450, links)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(k, k) == want[k] for k in range(450))
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}


# 1


def vectors(seed=3, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(0, n // 2, 4):
        x[k + 1] = x[k] + 0.15 * rng.standard_normal(dim)
        x[k + 2] = x[k + 1] + 0.2 * rng.standard_normal(dim)
    x[300] = x[301]
    return x


@pytest.mark.parametrize("block", [1000, 7])
def test_embedding_against_brute_force(spark, block):
    x = vectors()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(y @ y.T >= 0.9, 1)), strict=True)}
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, weight int")
    got = {r["vec_id"]: r for r in embedding.near_duplicates(df, block=block).collect()}
    degree = Counter(int(k) for p in want for k in p)
    found, total = sum(got[k]["n_links"] for k in got), sum(degree.values())
    assert total > 100 and found >= 0.97 * total and all(got[k]["n_links"] <= degree[k] for k in got)
    comp = components(len(x), want)
    assert sum(got[k]["component_id"] == comp[k] for k in got) >= 0.97 * len(x)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("n,dim", [(1_000, 3), (10_000, 8), (100_000, 16), (10_000, 64), (1_000_000, 64), (100_000, 256)])
def test_embedding_filters_find_links_at_the_least_cosine(n, dim):
    """Pairs at a cosine of exactly 0.9 share a filter of those planned for n vectors, whose buckets stay small."""
    rng = np.random.default_rng(n + dim)
    m = 500
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, m, dim)))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    (r, d), (s, e) = embedding.decode(x, n), embedding.decode(y, n)
    both = set(zip(r.tolist(), d.tolist(), strict=True)) & set(zip(s.tolist(), e.tolist(), strict=True))
    assert len({k for k, _ in both}) >= 0.97 * m
    assert len(r) / m <= 60
    height, words = embedding.plan(dim, n)
    if height < embedding.HIGHEST:
        assert n * len(r) / m / (embedding.CODES * words**2) <= 2 * embedding.MEMBERS


def test_embedding_first_shared_direction():
    rng = np.random.default_rng(2)
    for n, most in ((40, 60), (300, 6000)):
        lists = [np.unique(rng.integers(0, most, rng.integers(0, 30))) for _ in range(n)]
        i, j = np.nonzero(np.triu(rng.random((n, n)) < 0.8, 1))
        want = [not set(lists[a]) & set(lists[b]) for a, b in zip(i, j, strict=True)]
        assert embedding._first_here(i, j, lists).tolist() == want
        few = rng.choice(len(i), 50, replace=False)
        assert embedding._first_here(i[few], j[few], lists).tolist() == [want[k] for k in few]


def test_embedding_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *((k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9)), (None, 0, None, False)], key=str)
    assert embedding.near_duplicates(df.where("false")).count() == 0


# 2

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><p>The best site of them all, for all of you. Welcome to it, dear readers.</p></header>
<div class="menu"><a href=x>one</a> <a>two</a></div><div id="content"><h1>Title &eacute;</h1><p>First para graph is a long one, with some words in it.
It has   two sentences.</p><p>Short.</p><div class="ad">Buy now</div><p>Another long paragraph with <b>bo</b>ld, words and <i>other</i> things in it.</p>
<form><p>Subscribe to our letter. It is a good one indeed.</p></form><div class="comments"><p>I am a reader, and I like this one a lot. It is good.</p></div></div>
<aside><p>Side text that is long, with words and a sentence.</p></aside><script>var a = "<p>no</p>";</script><div class=footer>&copy; 2020 x</div>"""


def test_html():
    assert html.main_text(PAGE) == "Title é First para graph is a long one, with some words in it. It has two sentences. Short. Another long paragraph with bold, words and other things in it."
    article = "<nav><a>x</a></nav><article><h1>A</h1><p><b>B.<br><p>C d &amp; e.</p><p>1 &lt; 2</p></article><footer>&copy; z</footer>"
    assert html.main_text(article) == "A B. C d & e. 1 < 2"
    for odd in (None, "", "<", "<p", "<!-- x", "</p></p>", "<script>", "<a 'x>", "<p>" * 3000, "<div>" * 3000 + "x" + "</div>" * 10):
        html.main_text(odd)


LONG = "This paragraph has a good many words in it, so that it is running text, and it ends as sentences do. It goes on for a while, too."


@pytest.mark.parametrize(
    "page",
    [
        f'<article class="post has-comments"><p>{LONG}</p></article><div class="comments"><p>I liked it a lot, and so did all of my friends from the old town.</p></div>',
        f'<nav><a href=x>a</a></nav><div id="share-price"><p>{LONG}</p></div><footer>x</footer>',
        f'<article class="post tag-social comments-open"><p>{LONG}</p></article>',
        f'<div class="has-cookie-notice"><div class="promo"><p>{LONG}</p></div></div>',
        f'<form action="/p"><div class="menu"><a>b</a></div><div><p>{LONG}</p></div></form>',
        f'<article><svg><path d="x"><p>{LONG}</p></article>',
        f'<article><noscript><p>{LONG}</p></article>',
        f'<article><select><option>one<p>{LONG}</p></article>',
        f'<article><p>{LONG}</p></article><div><svg><g>graph</g></div><script>no text',
        f'<article><div><object data=x>old</div><p>{LONG}</p></article><object>y</object>',
        f'<article><button><div>Menu</div></button><svg viewBox="0"><text>pic</text></svg><p>{LONG}</p><textarea>t',
        f'<div class="article-comment" style="display: none"><p>{LONG} {LONG}</p></div><main><p>{LONG}</p></main>',
    ],
)
def test_html_class_words_are_evidence_and_unclosed_elements_lose_nothing(page):
    got = html.main_text(page)
    assert LONG in got and len(got) < len(LONG) + 12 and "liked" not in got


def test_html_templates():
    """Pages put together at random from ten kinds of furniture, with an article that is known."""
    rng = random.Random(13)
    word = lambda: rng.choice("river stone light market paper window garden letter winter bridge music field story water road glass".split())
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    right = 0
    for _ in range(200):
        paragraphs = [" ".join(sentence(rng.randint(9, 18)) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(2, 7))]
        head = sentence(5)[:-1]
        inner = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        ad, comment = f'<div class="{rng.choice(["ad", "advert", "promo-box", "sponsored"])}"><p>{sentence(6)}</p></div>', sentence(14)
        if rng.random() < 0.5:
            inner = inner.replace("</p><p>", f"</p>{ad}<p>", 1)
        body = rng.choice(['<article class="post has-comments">{}</article>', '<div id="content">{}</div>', "<main><div>{}</div></main>", '<div class="entry-content">{}</div>']).format(inner)
        links = "".join(f"<li><a href=/{k}>{word()}</a></li>" for k in range(rng.randint(3, 9)))
        top = rng.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', "<header><ul>{}</ul></header>"]).format(links)
        side = rng.choice(["", "<aside><h3>More</h3><p>{}</p></aside>", '<div class="sidebar"><p>{}</p></div>', '<div class="related-posts"><p>{}</p></div>']).format(sentence(13))
        foot = rng.choice(["<footer><p>{}</p></footer>", '<div id="footer">&copy; 2021 {}</div>']).format(sentence(6))
        below = rng.choice(["", f'<div class="comments"><p>{comment}</p></div>', f'<section id="comment-list"><div class="comment"><p>{comment}</p></div></section>'])
        page = f"<html><head><title>{word()}</title><script>var x='<p>';</script></head><body>{top}{body}{side if rng.random() < 0.5 else ''}{below}{foot}</body></html>"
        right += html.main_text(page) == " ".join([head, *paragraphs])
    assert right >= 190


def test_html_long_pages():
    assert html.main_text(f"<article>{'<p>' + LONG * 40}</article>" * 100).count(LONG) == 4000
    html.main_text("<form>" * 3000 + LONG)
    html.main_text("<svg>" * 20_000 + "</svg>" + "<textarea>" * 20_000 + LONG + "<!--" + "<a '" * 20_000)


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 8)
        t = [rng.uniform(-1, 1) for _ in range(n)]
        e = [(a, b, rng.uniform(0, 1)) for a in range(n) for b in range(a) if rng.random() < 0.6]

        def cost(label, t=t, e=e):
            return sum(abs(x) for x, y in zip(t, label, strict=True) if (x > 0) != y) + sum(w for a, b, w in e if label[a] != label[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        assert abs(cost(html.min_cut(t, e)) - best) < 1e-9


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, "u", PAGE), (None, "u", ""), (1, "u", PAGE)], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html.extract(df).collect()
    assert len(got) == 4 and sorted(r["n_chars"] for r in got) == [0, 0, 155, 155] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(df.where("false")).count() == 0


# 3


def test_url_filter(spark):
    urls = ["http://a.COM/en/x", "http://www.example.com/en/728?q", "http://example.com/en/6", "https://x.example.net/de/8#a", "http://example.net/de/9", "http://org/es/", "http://notorg/es/", "nothing", None, "http://h?x=/en/", "http://com", "://com/en/", "http://" + "a." * 3000 + "com/en/" + "x" * 10000, "http://com/EN/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 as host", "2 as rule")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, url_filter.CONTRACT_RULES).collect()}

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.CONTRACT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, "allow")

    assert got == {k: plain(u) for k, u in enumerate(urls)}
    twice = url_filter.filter_urls(df.union(df), url_filter.CONTRACT_RULES)
    assert twice.count() == 2 * len(urls) and url_filter.filter_urls(df.where("false"), url_filter.CONTRACT_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


# 4


@pytest.mark.parametrize("compression,keep", [("gzip", True), ("none", True), ("gzip", False)])
def test_warc_round_trip(spark, tmp_path, compression, keep):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    texts = ["plain", "plain", None, "", inner, "x" + inner + inner, "WARC/1.1\r\n", "é" * 5000, "WARC/1.1\r\nContent-Length: 999999\r\n\r\n", "WARC/1.1\r\nWARC/1.1\r\nz\r\n\r\n", inner]
    rows = [(k, f"http://a/{k}\r\nX: y é" if k % 2 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n").repartition(2)
    warc.write_warc(df, str(tmp_path / "w"), compression=compression, per_file=4)
    got = {int(r["record_id"].removeprefix("urn:page:")): r for r in warc.read_warc(spark, str(tmp_path / "w"), keep).collect()}
    assert set(got) == set(range(len(texts)))
    last = {t or "": k for k, t in enumerate(texts)}
    for k, t in enumerate(texts):
        raw, r = (t or "").encode(), got[k]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = last[t or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == k else ("revisit", f"urn:page:{first}"))
        if keep and first == k:
            assert bytes(r["payload"]) == raw


def test_warc_shorter_payloads_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (None, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "a"), min_bytes=3)
    got = warc.read_warc(spark, str(tmp_path / "a")).collect()
    assert sorted((r["record_id"].removeprefix("urn:page:"), r["record_type"]) for r in got) == [("", "response"), ("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]
    warc.write_warc(df.where("false"), str(tmp_path / "b"))
    assert warc.read_warc(spark, str(tmp_path / "b")).count() == 0


def foreign_archive(version, inner=b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"):
    """An archive as crawlers write them: an info record, a request, responses, a revisit; and what is in it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 99999\r\n\r\n"
    rows = [
        ("warcinfo", "<urn:uuid:a-0>", "application/warc-fields", b"software: x\r\nformat: WARC\r\n\r\n", None),
        ("request", "<urn:uuid:a-1>", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b""),
        ("response", "<urn:uuid:a-2>", "application/http; msgtype=response", http + b"<p>hello</p>", b"<p>hello</p>"),
        ("response", "<urn:uuid:a-3>", "application/http; msgtype=response", http + inner + b"\xff\x00" + inner, inner + b"\xff\x00" + inner),
        ("metadata", "<urn:uuid:a-4>", "text/plain", b"WARC/1.5\r\nWARC/1.1 no magic", None),
        ("conversion", "<urn:uuid:a-5>", "text/plain", "é".encode() * 300, None),
    ]
    records = []
    for kind, id_, content, block, _ in rows:
        records.append(f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {id_}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\ncontent-type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    return records, {id_[1:-1]: (kind, block if payload is None else payload) for kind, id_, _, block, payload in rows}


@pytest.mark.parametrize("version", ["1.0", "1.1"])
@pytest.mark.parametrize("packed", ["plain", "members", "stream"])
def test_warc_reads_foreign_archives(spark, tmp_path, version, packed):
    import gzip

    records, want = foreign_archive(version)
    raw = {"plain": b"".join(records), "members": b"".join(map(gzip.compress, records)), "stream": gzip.compress(b"".join(records))}[packed]
    (tmp_path / ("a.warc" if packed == "plain" else "a.warc.gz")).write_bytes(raw)
    got = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert {k: (r["record_type"], bytes(r["payload"])) for k, r in got.items()} == want
    assert all(r["payload_digest"] == warc.payload_digest(bytes(r["payload"])) and r["payload_bytes"] == len(r["payload"]) for r in got.values())


def test_warc_members_can_be_read_alone(spark, tmp_path):
    import zlib as z

    texts = ["a" * k for k in range(30)] + ["x" * 17_000_000]
    df = spark.createDataFrame([(k, "u", t) for k, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    raw, found = file.read_bytes(), []
    while raw:
        d = z.decompressobj(31)
        found.append(d.decompress(raw))
        raw = d.unused_data
    found = [x for x in found if x]
    assert len(found) == 31 and all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in found)
    assert warc.read_warc(spark, str(tmp_path / "w"), False).count() == 31


# 5


def toxic_corpus(spark, n=900):
    rng = random.Random(1)
    words = ["the", "sky", "tree", "of", "run", "blue", "to", "house", "and", "river"]
    texts, marks = [], []
    for k in range(n):
        t = [rng.choice(words) for _ in range(40)]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                t[rng.randrange(40)] = rng.choice(["zorgle", "blattik" + rng.choice("abcdef")])
        texts.append(" ".join(t))
        marks.append((k, 1, int(bad)))
    return docs(spark, [*texts, None, ""]), spark.createDataFrame([*marks, (None, 1, 1), (10**6, None, None)], "doc_id long, quality int, toxic int"), marks


def test_toxicity(spark):
    d, labels, marks = toxic_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, labels).collect()}
    truth = {k: t for k, _, t in marks}
    held = [k for k in truth if got[k]["held_out"]]
    assert held and all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in truth)
    assert sum(got[k]["predicted"] == truth[k] for k in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    none = toxicity.score_toxicity(d, labels.where("false")).collect()
    assert len(none) == d.count() and toxicity.score_toxicity(d.where("false"), labels).count() == 0


def test_toxicity_training_rows(spark):
    """The quota counts texts of labelled documents: neither labels without one nor repeated rows use it up."""
    d = docs(spark, [f"text {k}" for k in range(200)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20_000)], "doc_id long, quality int, toxic int")
    free = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 != 1]
    got = {(r["text"], r["toxic"]) for r in toxicity.training_rows(d, labels, most=1000).collect()}
    assert got == {(f"text {k}", k % 2) for k in free}
    assert toxicity.training_rows(d, labels, most=20).count() == 20
    same = spark.createDataFrame([(free[0], "again")], "doc_id long, text string").crossJoin(spark.range(5000)).drop("id")
    rows = same.union(d.select("doc_id", "text"))
    assert sorted(r["text"] for r in toxicity.training_rows(rows, labels, most=1000).collect()).count("again") == 1
    assert toxicity.training_rows(rows, labels, most=10).count() == 10


def test_transducers_compose():
    """The composition writes what the machines write one after the other, and that is what a plain search finds."""
    T = toxicity
    parts = T.reported_speech(), T.negation(), T.target()
    whole = parts[0].then(parts[1]).then(parts[2])
    rng = random.Random(3)
    for _ in range(400):
        line = [rng.choice([T.OTHER, T.OTHER, T.OTHER, T.TARGET, T.NEGATION, T.REPORT, T.END, T.COLON, T.QUOTE, T.INSULT, T.THREAT]) for _ in range(rng.randint(0, 25))]
        at, weights = line, [0.0] * len(line)
        for m in parts:
            at, w = m.run(at)
            weights = [a + b for a, b in zip(weights, w, strict=True)]
        got, total = whole.run(line)
        assert got == at and total == pytest.approx(weights)
        to, write, weight = whole.table()
        state = 0
        for k, x in enumerate(line):
            assert (write[state + x], weight[state + x]) == (got[k], pytest.approx(total[k]))
            state = to[state + x]

        def near(k, what, line=line):
            words = 0
            for x in reversed(line[:k]):
                if x in (T.END, T.COLON):
                    return False
                words += x != T.QUOTE
                if x == what:
                    return words <= T.SPAN
            return False

        said = quoted = False
        for k, x in enumerate(line):
            quoted ^= x == T.QUOTE
            said = True if x == T.REPORT else said and (x not in (T.END, T.COLON) or quoted or x == T.COLON)
            if x in (T.INSULT, T.THREAT):
                want = T.REPORTED if said else T.NEGATED if near(k, T.NEGATION) else {T.INSULT: T.AIMED, T.THREAT: T.MEANT}[x] if near(k, T.TARGET) else x
                assert got[k] == want


def test_grammar():
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.Grammar({}).features(t), strict=True))
    assert f("you are an idiot.")["aimed"] == 2 and f("an idiot, you are.")["aimed"] == 2
    assert f("he is not an idiot.")["negated"] == 2 and f('she said: "idiot".')["reported"] == 2
    assert f("I will kill you.")["threat"] == 2 and f("you I will kill.")["threat"] == 2 and f("to kill time.")["count"] == 0
    assert f("an idiot. you are")["plain"] == 2 and f("idiot " * 50_000)["plain"] == 100_000
    assert f("you idiot.")["best"] > f("idiot.")["best"] > f("no idiot.")["best"] > f("she said: idiot.")["best"] > 0
    assert f("the tree. blue sky.") == dict.fromkeys(toxicity.FEATURES, 0.0)
    # a quotation before its word of saying, and none that only stands beside one
    assert f('"you idiot" she said.')["reported"] == 2 and f('"you idiot!" she said.')["aimed"] == 0
    assert f('she said. "you idiot" he ran.')["aimed"] == 2 and f('"you idiot", and one two three four said.')["aimed"] == 2
    assert f('"a kind word" he wrote, you idiot.')["reported"] == 2 and f('you idiot "a kind word" he wrote.')["aimed"] == 2
    # intensifiers and words of intent weigh in their own clause alone
    assert f("such an idiot.")["best"] > f("an idiot.")["best"] == f("such. an idiot.")["best"]
    assert f("i will kill you.")["best"] > f("i kill you.")["best"] == f("i will. i kill you.")["best"] > 0
    assert f("i will kill time.") == dict.fromkeys(toxicity.FEATURES, 0.0)


def test_insult_and_threat_transducers():
    """The forwards machine of all five, against plain searches for intensifiers and intents."""
    T = toxicity
    rng = random.Random(5)
    parts = T.insult(), T.threat(), T.reported_speech(), T.negation(), T.target()
    whole = parts[0]
    for m in parts[1:]:
        whole = whole.then(m)
    assert len({s for s, _ in whole.arcs}) < 10_000
    kinds = [T.OTHER, T.OTHER, T.TARGET, T.NEGATION, T.REPORT, T.END, T.QUOTE, T.INSULT, T.THREAT, T.INTENSE, T.INTENT]
    for _ in range(300):
        line = [rng.choice(kinds) for _ in range(rng.randint(0, 25))]
        out, weights = whole.run(line)
        rest, plain = line, [0.0] * len(line)
        for m in parts[2:]:
            rest, w = m.run(rest)
            plain = [a + b for a, b in zip(plain, w, strict=True)]
        assert out == rest
        for k, x in enumerate(line):
            words, near = 0, False
            for y in reversed(line[:k]):
                if y == T.END:
                    break
                words += y != T.QUOTE
                if y == {T.INSULT: T.INTENSE, T.THREAT: T.INTENT}.get(x):
                    near = words <= T.SPAN
                    break
            assert weights[k] == pytest.approx(plain[k] + 0.3 * near)


def test_quotations_before_their_word_of_saying():
    """The backwards machine, against a plain search from each closing mark."""
    T = toxicity
    rng = random.Random(6)
    kinds = [T.OTHER, T.OTHER, T.TARGET, T.REPORT, T.END, T.COLON, T.QUOTE, T.QUOTE, T.INSULT, T.AIMED, T.MEANT, T.NEGATED]
    changed = 0
    for _ in range(600):
        line = [rng.choice(kinds) for _ in range(rng.randint(0, 25))]
        got = T.quoted_before().run(line[::-1])[0][::-1]
        want = list(line)
        marks = [k for k, x in enumerate(line) if x == T.QUOTE][::-1]
        for n in range(0, len(marks), 2):
            close, open_ = marks[n], marks[n + 1] if n + 1 < len(marks) else -1
            words = 0
            for y in line[close + 1 :]:
                if y in (T.END, T.COLON, T.QUOTE):
                    break
                if y == T.REPORT:
                    if words <= T.SPAN:
                        want[open_ + 1 : close] = [T.REPORTED if z in (T.INSULT, T.AIMED, T.MEANT, T.NEGATED) else z for z in line[open_ + 1 : close]]
                    break
                words += 1
        assert got == want
        changed += got != line
    assert changed > 50


# 6


def test_quality_measures():
    for text in ("", None, "a b c d e f a b c d e f", "x\nx\n \n \ny", "# $ a|b <c>", "é ü\x0bz\x85w", "a " * 40):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {i for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for i in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality.measure(text)[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))


def test_binomial_bound():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01, abs=1e-9)
    assert quality.upper_bound(5, 100, 0.05) == pytest.approx(0.10225, abs=1e-4)
    assert quality.upper_bound(3, 3, 0.05) == 1.0


def test_binomial_bound_against_exact_sums():
    from fractions import Fraction
    from math import comb

    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 400)
        k, alpha = rng.randint(0, n - 1), rng.choice([0.05, 0.001, 0.0001])
        p = quality.upper_bound(k, n, alpha)
        tail = lambda p, k=k, n=n: float(sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
        assert tail(p) == pytest.approx(alpha, rel=1e-6)
    assert quality.upper_bound(50_000, 10_000_000, 0.001) == pytest.approx(0.005 + 3.09 * (0.005 * 0.995 / 1e7) ** 0.5, rel=1e-3)


def test_cutoffs_against_a_plain_search():
    rng = np.random.default_rng(6)
    for _ in range(40):
        good, bad = (np.zeros(quality.BINS + 1, np.int64) for _ in range(2))
        np.add.at(good, rng.integers(0, rng.integers(5, 150), rng.integers(0, 3000)), 1)
        np.add.at(bad, rng.integers(20, 200, rng.integers(0, 300)), 1)
        n, risk, alpha, cost = int(good.sum()), 0.02, 0.001, 20.0
        passed = []
        for b in range(quality.BINS, 0, -1):
            if not n or quality.upper_bound(int(good[b:].sum()), n, alpha) > risk:
                break
            passed.append(b)
        gain = {b: bad[b:].sum() / bad.sum() - cost * good[b:].sum() / n for b in passed} if bad.sum() else {}
        got = quality.cutoff(good, bad, risk, alpha, cost)
        if not gain or max(gain.values()) <= 0:
            assert got == quality.BINS + 1
        else:
            assert gain[got] >= max(gain.values()) - 1e-12
    n = quality.least_labels(0.12, 0.05, 5)
    assert quality.upper_bound(0, n, 0.05 / 30) <= 0.02 < quality.upper_bound(0, n - 1, 0.05 / 30)


def test_quality_strata(spark):
    """Languages with labels enough are strata, the others one together, those without labels go by all labels."""
    rng = random.Random(5)
    rows, marks = [], []
    for lang, n in (("en", 900), ("de", 900), ("fr", 250), ("es", 250), ("xx", 40), (None, 0), ("zz", 0)):
        for bad in (False, True):
            for _ in range(n if not bad else max(20, n // 4)):
                k = len(rows)
                text = " ".join(rng.choice("ab bc cd de ef fg gh".split()) + str(rng.randrange(1000)) + ("***" if bad else "") for _ in range(30))
                rows.append((k, text, lang, "s", 1))
                if n:
                    marks.append((k, int(not bad), 0))
    d, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(d, labels).collect()}
    strata = {r[2]: got[r[0]]["stratum"] for r in rows}
    assert strata == {"en": "lang en", "de": "lang de", "fr": "small", "es": "small", "xx": "small", None: "all", "zz": "all"}
    for r in rows:
        assert got[r[0]]["kept"] == ("***" not in r[1]), r


def test_quality_rules(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice("ab bc cd de ef fg gh hi ij jk kl lm mn".split()) + str(rng.randrange(1000)) for _ in range(30)) for _ in range(800)]
    bad = [" ".join(w + "***" for w in t.split()) for t in good[:200]]
    d = docs(spark, [*good, *bad, None, "", "too short"])
    labels = spark.createDataFrame([(k, int(k < 800), 0) for k in range(0, 1000, 2)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(d, labels).collect()}
    assert all(got[k]["kept"] for k in range(800)) and not any(got[k]["kept"] for k in range(800, 1003))
    assert not any(got[k]["base_failed"] for k in range(1000)) and all(got[k]["base_failed"] for k in (1000, 1001, 1002))
    assert quality.judge(d, labels.where("false")).where("kept").count() == 1000
    assert quality.judge(d.where("false"), labels).count() == 0


# 7


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(60)]
    texts = [" ".join(t) for t in base]
    for t in base:
        for _ in range(3):
            t = list(t)
            t[rng.randrange(150)] = "changed"
            texts.append(" ".join(t))
    texts += [texts[0], texts[1].upper(), None, "", "one", "One two", "  ", "é É x y"]
    prints = [slow_print(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = components(len(texts), links)
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(d).collect()}
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k]["component_id"] for k in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 20
    assert simhash.near_duplicates(d.where("false")).count() == 0
    assert simhash.near_duplicates(d.union(d)).count() == 2 * len(texts)


def test_tally_is_all_pairs():
    rng = np.random.default_rng(1)
    for n in (2, 30, 400):
        rest = rng.integers(0, 256, (n, 4), dtype=np.uint8)
        rest[n // 2 :] = rest[: n - n // 2] ^ (1 << rng.integers(0, 8, (n - n // 2, 4)) * (rng.random((n - n // 2, 4)) < 0.4)).astype(np.uint8)
        want = [(a, b) for a in range(n) for b in range(a + 1, n) if int((rest[a] == rest[b]).sum()) >= 2 and sum(int(x).bit_count() for x in rest[a] ^ rest[b]) <= 2]
        assert list(zip(*simhash.tally(rest, 4), strict=True)) == want
    for n in (5, 200, 3000):
        v = np.random.default_rng(n).choice(65536, n, replace=False)
        two = np.stack([v & 255, v >> 8], axis=1).astype(np.uint8)
        assert sorted(zip(*simhash._pairs_of_two_bytes(two), strict=True)) == list(zip(*simhash.tally(two, 6), strict=True))


def test_keys_meet_every_pair():
    for two in __import__("itertools").combinations(range(8), 2):
        assert any(not set(two) & set(key) for key in simhash.KEYS)


@pytest.mark.parametrize("hot", [1000, 2])
def test_simhash_links_join_what_all_pairs_join(spark, hot):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:100]:
        for _ in range(3):
            f ^= 1 << rng.randrange(64)
            fps.add(f ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    at = {s: k for k, s in enumerate(signed)}
    got = components(len(fps), [(at[r["a"]], at[r["b"]]) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot).collect()])
    want = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert got == want


# 8


def test_pii_base():
    text = "a.b@c-d.example.com, x@y and 1.2.3.4 300.1.1.1 1.2.3.4.5; 4111 1111 1111 1111, 4111111111111112, +1 (017) 555-7713 +12"
    base, all_ = pii.spans(text)
    assert [text[s:e] for k, s, e in base] == ["a.b@c-d.example.com", "1.2.3.4", "1.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713"]
    assert set(base) <= set(all_)


def test_pii_emails_are_the_pattern_s():
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice("ab.-_@ é%\n") for _ in range(rng.randint(0, 24)))
        assert list(pii.emails(text)) == [m.span() for m in pii.PATTERNS["email"].finditer(text)]
    assert pii.spans("a" * 300_000 + " x@y.z " + "b" * 300_000)[0] == [("email", 300_001, 300_006)]


def test_pii_base_against_the_plain_patterns():
    """All four kinds, as the contract's patterns and tests give them, on random texts."""

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def plain(text):
        for kind in pii.KINDS:
            for m in pii.PATTERNS[kind].finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                    continue
                if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                    continue
                if kind == "phone" and not 8 <= len(digits) <= 15:
                    continue
                yield kind, m.start(), m.end()

    rng = random.Random(8)
    parts = ["4111 1111 1111 1111", "4012-8888-8888-1881", "1.2.3.4", "255.255.255.0", "256.1.1.1", "+49 30 1234567", "+1(555)0100-22", "a@b.c", "x.y@z-w.de", "12", ".", " ", "-", "+", "(", ")", "007", "é", "\n", "word"]
    found = 0
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        got, want = pii.exact(text), list(plain(text))
        assert got == want, text
        found += len(want)
    assert found > 2000


def test_pii_long_texts_take_linear_time():
    import time

    spots = "a@b.de +49 30 1234567 1.2.3.4 "
    for text, n in (("7" * 1_000_000, 0), ("1." * 500_000, 125_000), (spots * 17_000 + "о", 51_000), ("+1" + "(" * 500_000 + "+1" + " " * 500_000, 0), ("eins zwei " * 100_000, 0)):
        began = time.process_time()
        base, all_ = pii.spans(text)
        assert len(base) == n and len(all_) >= n
        assert time.process_time() - began < 60


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("bob at example dot online", "email", "bob at example dot online"),
        ("mail bob [at] example [dot] com now", "email", "bob [at] example [dot] com"),
        ("bob at example dot com", "email", "bob at example dot com"),
        ("bob(at)example.com", "email", "bob(at)example.com"),
        ("аlice@exаmple.com", "email", "аlice@exаmple.com"),
        ("call plus four nine three zero one two three four five six!", "phone", "plus four nine three zero one two three four five six"),
        ("call five five five one two three four five six seven now", "phone", "five five five one two three four five six seven"),
        ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
        ("192​.168.0.1", "ip", "192​.168.0.1"),
        ("host 10[.]0[.]0[.]7 up", "ip", "10[.]0[.]0[.]7"),
        ("10 dot 0 dot 0 dot 7", "ip", "10 dot 0 dot 0 dot 7"),
        ("pay 4111.1111.1111.1111 now", "card", "4111.1111.1111.1111"),
        ("bob @ example . com", "email", "bob @ example . com"),
        ("mail ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("+① ②③④ 555 ⑥⑦⑧⑨", "phone", "+① ②③④ 555 ⑥⑦⑧⑨"),
    ],
)
def test_pii_hidden(text, kind, span):
    found = [(k, text[s:e]) for k, s, e in pii.spans(text)[1]]
    assert (kind, span) in found
    assert span not in pii.mask(text) and f"[{kind.upper()}]" in pii.mask(text)


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("mail jоhn.smith@example.com now", "email", "jоhn.smith@example.com"),
        ("mail john.smith@example.cоm now", "email", "john.smith@example.cоm"),
        ("call +49 30 1234567 eight nine.", "phone", "+49 30 1234567 eight nine"),
        ("call +49 30 1234567 acht", "phone", "+49 30 1234567 acht"),
        ("pay 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("Ruf an: plus vier neun drei null eins zwei drei vier fünf", "phone", "plus vier neun drei null eins zwei drei vier fünf"),
        ("le cinq cinq cinq un deux trois quatre cinq six", "phone", "cinq cinq cinq un deux trois quatre cinq six"),
        ("el cinco cinco cinco uno dos tres cuatro cinco seis", "phone", "cinco cinco cinco uno dos tres cuatro cinco seis"),
    ],
)
def test_pii_hidden_beyond_an_exact_span(text, kind, span):
    base, all_ = pii.spans(text)
    assert (kind, span) in [(k, text[s:e]) for k, s, e in all_] and set(base) <= set(all_)
    assert pii.mask(text) == text.replace(span, f"[{kind.upper()}]")


def test_pii_short_spelled_runs_in_no_number():
    for text in ("1 2 three of 12 345", "un ou deux, 12 un 34", "die acht 2 drei", "10 20 one two 3"):
        assert pii.spans(text) == ([], [])


def test_pii_leaves_clean_text_alone():
    for text in ("look at the dot on it", "one two three go", "at home. dot com", "version 1.2", "nicht ä é ü", "we met at noon at example.com", "see @ the end. Then", "1234.5678", "El 1º de mayo, m² y nº 5"):
        assert pii.spans(text) == ([], []) and pii.mask(text) == text


def test_pii_rows(spark):
    d = docs(spark, ["x a@b.cd y", None, "", "a@b.cd " * 20000])
    got = {r["doc_id"]: r for r in pii.find_pii(d).collect()}
    assert got[0]["spans"] == "email:2:8" and got[0]["base_sha256"] == hashlib.sha256(b"email:2:8").hexdigest()
    assert got[1]["spans"] == got[2]["spans"] == "" and got[3]["n_email"] == 20000
    assert [(got[k]["n_spans"], got[k]["has_pii"]) for k in range(4)] == [(1, True), (0, False), (0, False), (20000, True)]
    masked = {r["doc_id"]: r for r in pii.mask_pii(d).collect()}
    assert masked[0]["text"] == "x [EMAIL] y" and masked[0]["n_chars"] == 11 and masked[1]["text"] is None
    assert pii.find_pii(d.where("false")).count() == 0


# 9


def test_shortest_pack_first():
    rng = random.Random(9)
    h = Counter(rng.randint(1, 1024) for _ in range(5000))
    patterns = packing.shortest_pack_first(dict(h))
    used = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 1024 and count > 0
        for n in lengths:
            used[n] += count
    assert used == h and sum(n * c for n, c in h.items()) / 1024 / sum(c for _, c in patterns) > 0.98
    assert packing.shortest_pack_first({}) == []


def test_shortest_pack_first_fills_packs_of_one_length():
    for n in (1, 342, 400, 512, 513, 1024):
        patterns = packing.shortest_pack_first({n: 1001})
        each = 1024 // n
        assert sum(c for _, c in patterns) == -(-1001 // each) and sum(len(p) * c for p, c in patterns) == 1001


def test_token_ids_are_the_tokenizer_s(monkeypatch):
    """Both ways of encoding, and every cut, give the ids of the whole text by the named tokenizer."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    path = packing.default_tokenizer()
    tok, mine = Tokenizer.from_file(path), packing.encoder(path)
    want = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 0]
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "1", "é", "'s", "...", "\u00a0", "\x1c", "\u3000", "\x85", "<|endoftext|>", "日本", "\r\n", "!", ",", "é.", "'ll", "x:"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    texts += [" " * n + "x" for n in (98, 99, 100, 101, 5000)] + ["y" * n + " z" for n in (1999, 2000, 2001, 9000)]
    for t in [*texts, None, "", " " * 5_000_000 + "x", "\n" * 5_000_000, "a" * 1_000_000, "some words. " * 300_000, " ", "end "]:
        assert mine.ids(t).tolist() == want(t)
    assert not mine.plain(" " * 100) and not mine.plain("a<|endoftext|>") and mine.plain("a b") == (mine.ranks is not None)
    monkeypatch.setattr(packing, "PART", 7)
    for t in texts:
        assert mine.ids(t).tolist() == want(t)


def test_token_ids_of_every_character():
    """Letters, digits and white space are the same ones to both libraries."""
    mine = packing.encoder(packing.default_tokenizer())
    if mine.ranks is None:
        pytest.skip("no ranks beside the tokenizer")
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 64):
        text = "".join(f"a{c}b {c}1{c}{c}, {c} .{c}\n" for c in chars[k : k + 64])
        assert mine.ranks.encode_ordinary(text) == mine.tokenizer.encode(text, add_special_tokens=False).ids, k


def test_packing_one_length_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "same text again " * 130)], "doc_id long, text string").crossJoin(spark.range(600)).drop("id")
    rows = packing.pack(d, rows_per_rank=50).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and len(rows) == 1200
    tokens = sum(r["length"] for r in rows)
    assert tokens == 600 * rows[0]["doc_tokens"] and len({r["sequence_id"] for r in rows}) <= 1.01 * tokens / 1024 + 1


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh é") for _ in range(6)) for _ in range(rng.choice([1, 5, 50, 400, 3000]))) for _ in range(60)] + [None, "", "same text", "same text", "a <|endoftext|> b"]
    d = docs(spark, texts).where("doc_id <> 3")
    rows = packing.pack(d, rows_per_rank=8).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, t in enumerate(texts):
        if k == 3:
            continue
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(d.where("false")).count() == 0
    assert packing.pack(d.union(d), rows_per_rank=8).groupBy("sequence_id", "offset").count().where("count > 1").count() == 0


# 10


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 60))), "en", None if k % 7 == 0 else ("big" if k % 3 else f"s{k % 5}"), 0) for k in range(2000)] + [(5000, None, None, None, None), (None, "a b", "en", "s1", 3)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(d).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, open_, total = {}, set(order), float(sum(sizes.values()))
    while True:
        left = total - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.discard(s)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["size"] * r["repeats"] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    # by the rule itself: rows in their order, taken once more while the words before and half their own are fewer
    draw = lambda r: hashlib.md5(f"mix:{r['doc_id'] if r['doc_id'] is not None else 'null:' + hashlib.md5(b'a b').hexdigest()}".encode()).hexdigest()
    for s in order:
        done, whole = 0, int(target[s] // sizes[s]) if sizes[s] else 0
        for r in sorted((r for r in got if r["source"] == s), key=lambda r: (draw(r), r["size"])):
            assert r["repeats"] == whole + (done + r["size"] / 2 < target[s] - whole * sizes[s]), r
            done += r["size"]
    for n in (1, 100):
        assert sorted(map(str, mixing.mix(d, rows_per_range=n).collect())) == sorted(map(str, got))
    again = mixing.mix(d.repartition(3)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix(d.where("false")).count() == 0 and all(r["taken"] == 0 for r in mixing.mix(d.where("doc_id = 5000")).collect())


def test_mixing_repeated_rows(spark):
    """Equal rows, without ids or with one, are taken so many times as fit."""
    for k in (None, 7):
        d = spark.createDataFrame([(k, "a b c d", "x")], "doc_id long, text string, source string").crossJoin(spark.range(300)).drop("id")
        d = d.union(spark.createDataFrame([(j, "a b c d", "y") for j in range(100, 400)], "doc_id long, text string, source string"))
        got = mixing.mix(d, weights=(3, 5)).collect()
        taken = Counter()
        for r in got:
            taken[r["source"]] += r["taken"]
        assert len(got) == 600 and abs(taken["x"] - 900) <= 2 and abs(taken["y"] - 1500) <= 2
        assert Counter(r["repeats"] for r in got if r["source"] == "x") == {0: 75, 1: 225}


# pipeline


def test_pipeline_removes_copies_at_a_similarity_of_0_8(spark, tmp_path):
    import corpus_pipeline
    from quiltspan.llm import near_copies

    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for n in [40, 60, 100, 100, 200, 400] * 10:
        t = [rng.choice(words) for _ in range(n)]
        edited = list(t)
        edited[rng.randrange(5, n - 5)] = "changed"
        far = list(t)
        for k in range(0, n, 8):
            far[k] = "other"
        texts += [" ".join(t), " ".join(edited), " ".join(far)]
    texts += [None, "", "one two", "One  two", "one three"]

    def plain(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [plain(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    want = components(len(texts), links)
    assert sum(len(sets[a] & sets[b]) < len(sets[a]) for a, b in links) >= 50
    d = docs(spark, texts)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect()}
    assert got == set(want)
    assert corpus_pipeline.drop_near_duplicates(spark, d.where("false"), str(tmp_path)).count() == 0
    assert near_copies.similarity(near_copies.shingles("a b c d e f"), near_copies.shingles("A b c d e f g")) == pytest.approx(2 / 3)


def test_near_copies_in_long_lists(spark, tmp_path):
    """Chains and clusters of many near copies, of which the lists hold more than three: components are those of all
    pairs at the similarity."""
    import corpus_pipeline

    rng = random.Random(14)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(8):
        t = [rng.choice(words) for _ in range(120)]
        for _ in range(14):  # each near the one before, the ends far apart
            t = list(t)
            t[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(t))
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.choice([1, 2, 3])):
                t[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(t))
    plain = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    sets = [plain(t.split()) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(len(texts), links)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), str(tmp_path)).collect()}
    assert got == set(want)


def test_pipeline_stages_on_empty_tables_and_long_texts(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    long = "a word or two, and more of them. " * 30_000
    d = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, "x" * 1_000_000, "en", None, 1), (3, None, None, "s", None), (4, "", "en", "s", 0)], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.where("false"), str(tmp_path)).count() == 0, name
        out = stage(spark, d, str(tmp_path))
        assert out.count() >= 2, name
        if name != "packing":
            assert {r["doc_id"] for r in out.collect()} <= {1, 2, 3, 4} and out.columns == d.columns


def test_long_texts_of_measures_and_fingerprints():
    text = "one two three four five six\n" * 100_000
    n, *_ , repeated = quality.measure(text)[:5]
    assert n == repeated == 600_000
    assert simhash.fingerprint(text) == simhash.fingerprint(text[: len(text) // 2]) and simhash.fingerprint("x" * 5_000_000) != 0


def test_pipeline_keeps_one_row_of_a_group_whatever_its_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, c, e = (" ".join(f"w{rng.randrange(1000)}" for _ in range(50)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (None, a), (None, c), (None, c), (None, e), (7, e), (9, b), (9, b)]
    d = spark.createDataFrame([(k, t, "en", f"s{n}", 1) for n, (k, t) in enumerate(rows)], DOCS)
    for x in (d, d.repartition(3), d.union(d)):
        got = corpus_pipeline.drop_near_duplicates(spark, x, str(tmp_path)).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(3, a), (5, b), (None, c), (7, e)], key=str)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d, labels, marks = toxic_corpus(spark, 400)
    clean = d.select("doc_id", "text", "lang", "source", "n_chars")
    extra = spark.createDataFrame([(900, "write to a@b.example now, it is a good thing to do for all of you", "en", None, 66), (901, "write to a@b.example now, it is a good thing to do for all of you", "en", "s1", 66), (None, "no id here", "en", "s1", 10)], DOCS)
    clean = clean.union(extra)
    clean.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs_, truth = clean, {k for k, _, t in marks if t}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs_
        docs_ = stage(spark, docs_, str(tmp_path)).cache()
        assert docs_.columns == before.columns, name
        seen.append([r.asDict() for r in docs_.collect()])
    ids = [{r["doc_id"] for r in x} for x in seen]
    assert len(truth & ids[0]) <= 0.05 * len(truth) and {900, 901, None} <= ids[0]
    assert 900 in ids[1] and 901 not in ids[1] and None in ids[1]
    assert all("a@b.example" not in (r["text"] or "") for r in seen[2])
    assert max(Counter(r["doc_id"] for r in seen[3]).values()) <= 3
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.where("length > 1024").count() == 0 and packed.select("doc_id").distinct().count() <= len(ids[2])


def test_mixing_rows_of_one_id(spark):
    """Rows of one doc_id and size with different texts, over any partitions: reruns choose the same ones."""
    rows = [(7, f"w{k % 9} x", "a") for k in range(600)] + [(k, "one two three", "b") for k in range(100, 1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = None
    for n, per_range in ((1, 50_000), (5, 50_000), (7, 40)):
        out = mixing.mix(d.repartition(n), weights=(1, 3), whole_rows=True, rows_per_range=per_range)
        got = sorted((r["row"]["text"], r["source"], r["repeats"]) for r in out.collect())
        assert len(got) == len(rows) and (want is None or got == want)
        want = got
        for source in "ab":
            taken = sum(r["taken"] for r in out.where(f"source = '{source}'").collect())
            target = out.where(f"source = '{source}'").first()["target"]
            assert abs(taken - target) <= 1.5
