"""Short articles beside long furniture, pages without an article, and columns of the user's in the pipeline's stages."""

import os
import random

import pytest

from quiltspan.llm import html, quality

WORDS = "river stone light market paper window garden letter winter bridge music field story water road glass".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


LONG = ["comments", "comment-list", "cookie-consent", "gdpr-notice", "newsletter", "promo", "related-posts", "sidebar", "footer", "disqus_thread", "breadcrumbs", "sponsored"]
FURNITURE = [*(f'<div class="{c}"><p>{{}}</p></div>' for c in LONG), "<footer><p>{}</p></footer>", "<nav><p>{}</p></nav>", "<aside><p>{}</p></aside>", "<form><p>{}</p></form>", '<section id="comments"><div class="comment"><p>{}</p></div></section>']
ARTICLES = ["<article>{}</article>", "<main>{}</main>", '<div class="entry-content">{}</div>', '<div id="content"><div>{}</div></div>', '<article class="post has-comments">{}</article>']


def test_short_articles_beside_long_furniture():
    """500 pages with articles of one to three sentences; the furniture holds many times as much text."""
    rng = random.Random(31)
    right = 0
    for _ in range(500):
        parts = [sentence(rng, rng.randint(4, 12)) for _ in range(rng.randint(1, 3))]
        title = sentence(rng, 4)[:-1]
        body = rng.choice(ARTICLES).format(f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in parts))
        around = [rng.choice(FURNITURE).format(" ".join(sentence(rng, 14) for _ in range(rng.randint(2, 5)))) for _ in range(rng.randint(1, 3))]
        at = rng.randint(0, len(around))
        page = f"<html><body>{''.join(around[:at])}{body}{''.join(around[at:])}</body></html>"
        right += html.main_text(page) == " ".join([title, *parts])
    assert right >= 490


@pytest.mark.parametrize("place", ['<div class="comments">{}</div>', "<footer>{}</footer>", '<div class="cookie-notice">{}</div>', "<nav>{}</nav>", '<form><div class="comment">{}</div></form>', '<div class="comment">{}</div><div class="comment">{}</div>'])
def test_pages_without_an_article_are_empty(place):
    rng = random.Random(3)
    text = "".join(f"<p>{sentence(rng, 20)}</p>" for _ in range(3))
    assert html.main_text(f"<body>{place.replace('{}', text)}</body>") == ""


def test_bare_pages_keep_their_text():
    assert html.main_text("<body><p>Yes.</p><p>Hello world</p></body>") == "Yes. Hello world"
    assert html.main_text("<body><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul><p>Hi there</p></body>") == "Hi there"
    assert html.main_text('<body><ul><li><a href="x">Home</a></ul></body>') == ""


def test_text_in_nested_boilerplate_is_found():
    text = "This paragraph stands alone on its page and has a good many words, so that it is content all the same."
    assert html.main_text("<form>" * 40 + f"<div><p>{text}</p></div>") == text
    assert html.main_text(f'<div class="promo"><form><p>{text}</p></form><div class="comments"><p>{text} {text}</p></div></div>') == text


def test_many_separate_places_take_linear_time():
    block = "<div class=comment><p>I liked this one very much and so did all the others here.</p></div>"
    assert html.main_text(block * 20_000) == ""


def test_the_commonest_word_counts_alike_in_short_and_long_texts():
    last = lambda t: quality.measure(t)[-1]
    assert last("") == last("one") == last("one two three four five") == 0
    assert last("no " * 19) > 0.4 and abs(last("no " * 19) - last("no " * 21)) < 0.05
    assert last("a b c d e f g h i j " * 50) < last("a " * 300 + "b c d e " * 50)


STAGE_COLUMNS = ["row_key", "__score", "row", "key", "repeats", "taken", "fp", "least", "draw", "rid", "root"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_leave_other_columns_alone(spark, tmp_path, stage):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    rng = random.Random(stage)
    rows = []
    for k in range(40):
        text = " ".join(sentence(rng, 12) for _ in range(3)) + f" number {k} of these."
        rows.append((k, text, "en", f"src{k % 3}", len(text), *(f"{c}-{k}" for c in STAGE_COLUMNS)))
    kinds = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in STAGE_COLUMNS)
    docs = spark.createDataFrame(rows, kinds)
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(tmp_path, "labels.parquet"))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = out.collect()
    assert got
    for r in got:
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in STAGE_COLUMNS)
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def _template_pages(n, rng, planted):
    """n texts of one template (similarity near 0.5) and ``planted`` near copies of some; the pairs of places."""
    words = [f"w{k}" for k in range(20_000)]
    common = [rng.choice(words) for _ in range(100)]
    texts = [common + [rng.choice(words) for _ in range(46)] for _ in range(n)]
    pairs = []
    for k in range(planted):
        t = list(texts[k])
        t[-1] = "changed"
        t[130] = "other"
        pairs.append((k, len(texts)))
        texts.append(t)
    return [" ".join(t) for t in texts], pairs


def test_left_apart_posts_a_hot_list_anew(spark):
    """A list that all texts of a template share: with longer keys the planted links are met, and few other pairs."""
    import random

    import numpy as np
    from quiltspan.llm import near_copies as nc

    texts, pairs = _template_pages(2_900, random.Random(5), 100)
    sets = [nc.shingles(t) for t in texts]
    assert all(nc.similarity(sets[a], sets[b]) >= 0.8 for a, b in pairs) and nc.similarity(sets[0], sets[1]) < 0.6
    rows = [(k, bytearray(nc.positions(s).astype(np.uint8).tobytes()), bytearray(nc._low(s).tobytes())) for k, s in enumerate(sets)]
    marks = spark.createDataFrame(rows, "fp long, marks binary, shingles binary")
    posts = marks.select(nc.F.lit(7).cast("long").alias("key"), "fp")
    roots = spark.createDataFrame([], "node long, root long")
    want = {(b, a) for a, b in pairs}
    whole = {(r["a"], r["b"]) for r in nc.left_apart(posts, roots, marks, block=500).collect()}
    split = {(r["a"], r["b"]) for r in nc.left_apart(posts, roots, marks, hot=1_000).collect()}
    assert want == whole and split <= whole
    assert len(want & split) >= 0.99 * len(want)


def test_longer_keys_keep_lists_short_and_pairs_together():
    from quiltspan.llm import near_copies as nc

    before = 0
    for n in (600, 10_000, 1_000_000, 10**8):
        drawn = nc.longer_keys(n)
        keys, length = drawn.shape
        assert length >= before and all(len(set(x)) == length for x in drawn.tolist())
        assert n * nc.UNLIKE**length <= nc.LIST and (1 - nc.SIMILARITY**length) ** keys <= max(nc.MISSED, 1e-3)
        before = length


def test_left_apart_tries_every_member_of_a_component(spark):
    """The member with most shared marks need not be the one that passes; long shingles are dealt in blocks by bytes."""
    import numpy as np
    from quiltspan.llm import near_copies as nc

    width = nc.BANDS * nc.ROWS

    def row(fp, unlike, start, n=1000):
        m = np.zeros(width, np.uint8)
        m[:unlike] = 9
        return fp, bytearray(m.tobytes()), bytearray(np.arange(start, start + n, dtype="<u4").tobytes())

    # 1 shares most marks with 2, whose shingles are too unlike, fewer with 3, which passes, and too few with 4
    rows = [row(1, 0, 0), row(2, 5, 300), row(3, 30, 50), row(4, 60, 0), row(5, 0, 5000)]
    prints = spark.createDataFrame(rows, "fp long, marks binary, shingles binary")
    posts = spark.createDataFrame([(7, k) for k in range(1, 6)], "key long, fp long")
    roots = spark.createDataFrame([(k, 2) for k in (2, 3, 4)], "node long, root long")
    assert {(r["a"], r["b"]) for r in nc.left_apart(posts, roots, prints).collect()} == {(3, 1)}
    many = [row(k, 0, 4 * k, 300_000) for k in range(12)]
    prints = spark.createDataFrame(many, "fp long, marks binary, shingles binary")
    posts = spark.createDataFrame([(7, k) for k in range(12)], "key long, fp long")
    links = [(r["a"], r["b"]) for r in nc.left_apart(posts, roots.where("false"), prints, mbytes=1).collect()]
    assert nc.connected_components(spark.createDataFrame(links, "a long, b long")).where("root = 0").count() == 12


def test_near_copies_of_a_template_are_found_and_no_others(spark, tmp_path):
    """The stage itself, on pages of one template with planted near copies."""
    import random

    import corpus_pipeline

    texts, pairs = _template_pages(400, random.Random(6), 60)
    d = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect()}
    assert got == set(range(len(texts))) - {b for _, b in pairs}
