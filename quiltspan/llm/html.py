"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, text_batches

# Fixed word lists: elements and attribute words.
BLOCK = frozenset("html body head title article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre header footer nav aside form fieldset figure figcaption address details summary hr center dialog menu search hgroup".split())
VOID = frozenset("hr".split())
#: Elements whose text is no text of the page; of RAW ones the content is not even markup, BREAKABLE ones hold no blocks,
#: so that a block's beginning ends them.
DROPPED = frozenset("script style noscript template iframe object svg math select textarea button canvas audio video map title".split())
RAW = frozenset("script style textarea title iframe".split())
BREAKABLE = frozenset("svg math select button audio video canvas map".split())
AUTO_CLOSED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
CLOSES_P = BLOCK - {"html", "body", "head", "title"}
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav header footer aside form head menu dialog search fieldset".split())
GOOD_WORDS = frozenset("article content entry story post main maincontent articlebody postbody text".split())
BAD_WORDS = frozenset("ad ads adbox advert advertisement advertising sponsor sponsored promo comment comments commentlist discussion reply replies respond disqus related recommended recommendations share sharing social cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login register paywall breadcrumb breadcrumbs pagination pager copyright legal disclaimer widget teaser outbrain taboola".split())
#: Words of the page's frame; an article or main element inside such an element is content all the same.
FRAME_WORDS = frozenset("nav navbar navigation menu header masthead footer sidebar aside banner topbar toolbar".split())
#: Text in such a place is never the article's, however much it is and however little there is elsewhere.
FIRM_WORDS = frozenset("comment comments commentlist discussion reply replies respond disqus cookie cookies consent gdpr nav navbar navigation menu footer breadcrumb breadcrumbs pagination pager copyright legal disclaimer".split())
FIRM_TAGS = frozenset("nav footer menu head".split())
#: Beside one of these a word says nothing of the element itself: has-comments, tag-social, share-price, comments-open.
NEUTRAL = frozenset("has no not with without is tag tags category topic enabled disabled open closed price prices count layout wrapper page".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>)", re.S)
_LOOSE_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DROPPED_END = re.compile(r"</(script|style|noscript|template|iframe|object|svg|math|select|textarea|button|canvas|audio|video|map|title)\s*>", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_LEGAL = re.compile(r"©|\(c\) ?\d{4}|all rights reserved|alle rechte|tous droits|todos los derechos", re.I)

# Costs in log-odds units.
IN_GOOD, IN_BAD, BASE, LINKS, LEGAL, HEADING, SENTENCE = 3.0, -5.0, -0.9, -3.0, -2.5, 0.8, 0.5
NEXT_TO, NEXT_ACROSS, SIBLING = 0.6, 0.15, 0.4


#: What is added to BASE where nothing else on the page is content: plain text of a bare page.
BARE = 1.2


def _words(attrs: str) -> tuple[set[str], bool]:
    """The words of class, id and role, but for those beside a NEUTRAL one, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = {w.lower() for w in _SPLIT.split(token) if w}
                if parts.isdisjoint(NEUTRAL):
                    words |= parts
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return words, hidden


def _region(tag: str, attrs: str, above: int, trusted: bool) -> int:
    """1 content, -1 frame of the page, -2 beside the content, -3 hidden, 0 none; above: that of the parent.

    ``trusted``: neither the element's words nor its tag are held against it, unless they are firm."""
    words, hidden = _words(attrs) if attrs and attrs.strip() else (set(), False)
    if tag in ("html", "body"):
        return 0
    trusted = trusted and tag not in FIRM_TAGS and words.isdisjoint(FIRM_WORDS)
    if hidden or tag == "head" or above == -3:
        return -3
    if above == -2 or not trusted and words & BAD_WORDS:
        return -2
    if tag in GOOD_TAGS:
        return 1
    if tag == "header" and above == 1:  # the head of the article, not of the page
        return 1
    if tag in BAD_TAGS and not trusted:
        return -2 if tag in ("nav", "form", "aside", "footer") else -1
    if words & FRAME_WORDS and not trusted:
        return -1
    if above:
        return above
    return 1 if words & GOOD_WORDS else 0


class Block:
    __slots__ = ("text", "region", "parent", "holder", "tag", "link")

    def __init__(self, text: str, region: int, parent: int, holder: int, tag: str, link: int) -> None:
        self.text, self.region, self.parent, self.holder, self.tag, self.link = text, region, parent, holder, tag, link


def blocks(page: str, trusted: frozenset[int] = frozenset(), parents: dict[int, int] | None = None, firm: set[int] | None = None) -> list[Block]:
    """The text blocks of a page in page order. Malformed and unfinished markup is read as far as it goes: a dropped
    element that nothing ends drops its tag alone (of scripts and styles, the rest of the page). ``trusted``: the
    numbers of elements whose words and tags are not held against them. ``parents`` gets each element's parent,
    ``firm`` the boilerplate elements that are never trusted."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, region, element, the element that set the region
    open_: Counter[str] = Counter()
    pieces: list[str] = []
    link_chars = n = at = 0
    in_link = False
    muted = 0  # dropped elements that are open
    size = len(page)
    tags = _TAG
    ends = {m[1].lower(): m.start() for m in _DROPPED_END.finditer(page)}  # where each one's last end tag is

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag, region, element, holder = stack[-1]
                out.append(Block(text, region, stack[-2][2] if len(stack) > 1 else element, holder, tag, min(link_chars, len(text))))
            pieces.clear()
        link_chars = 0

    def pop_to(name: str) -> None:
        while True:
            tag = stack.pop()[0]
            open_[tag] -= 1
            muted_less(tag)
            if tag == name:
                return

    def muted_less(tag: str) -> None:
        nonlocal muted
        muted -= tag in DROPPED

    def say(raw: str) -> None:
        nonlocal link_chars
        if muted:
            return
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            link_chars += len(text)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = tags.match(page, lt)
        if m is None and tags is _TAG and lt + 1 < size and (page[lt + 1].isalpha() and page[lt + 1].isascii() or page[lt + 1] == "/"):
            loose = _LOOSE_TAG.match(page, lt)
            if loose:  # an unclosed quote: quotes mean nothing from here on
                tags, m = _LOOSE_TAG, loose
        if m is None:
            if page.startswith("</", lt) and page.find(">", lt) < 0:
                say(page[at:lt])
                break
            say(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            say(page[at:lt])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = False
            elif name in DROPPED:
                if open_[name] > 0:
                    pop_to(name)
            elif name in BLOCK:
                flush()
                if open_[name] > 0:
                    pop_to(name)
            continue
        if name in DROPPED:
            if name == "title":
                flush()
            if m[3].rstrip().endswith("/") and name not in RAW:
                continue
            if name in RAW:
                end = _RAW_END[name].search(page, at) if ends.get(name, -1) >= at else None
                at = end.end() if end else size if name in ("script", "style") else at
            elif ends.get(name, -1) >= at:
                stack.append((name, *stack[-1][1:]))
                open_[name] += 1
                muted += 1
        elif name == "a":
            in_link = True
        elif name == "br" or name == "img" or name == "input":
            pieces.append(" ")
        elif name in BLOCK:
            flush()
            while stack[-1][0] in BREAKABLE and not (stack[-1][0] == "button" and name == "div"):
                pop_to(stack[-1][0])
            for other in AUTO_CLOSED.get(name, ()):
                if stack[-1][0] == other:
                    pop_to(other)
                    break
            if name in CLOSES_P and stack[-1][0] == "p":
                pop_to("p")
            if name in VOID:
                continue
            n += 1
            above = stack[-1]
            region = _region(name, m[3], above[1], n in trusted)
            if parents is not None:
                parents[n] = above[2]
                if region < 0 and region != above[1] and (name in FIRM_TAGS or not _words(m[3] or "")[0].isdisjoint(FIRM_WORDS)):
                    firm.add(n)
            stack.append((name, region, n, n if region != above[1] else above[3]))
            open_[name] += 1
    flush()
    return out


def evidence(b: Block, base: float = BASE) -> float:
    """The classifier's log odds that a block is content."""
    words = b.text.count(" ") + 1
    s = base + min(2.2, 0.4 * math.log1p(words))
    s += IN_GOOD if b.region == 1 else IN_BAD * (1.0, 1.6, 3.0)[-1 - b.region] if b.region < 0 else 0.0
    s += LINKS * b.link / len(b.text)
    s += HEADING if b.tag in ("h1", "h2", "h3") else 0.0
    s += SENTENCE if b.text[-1] in ".!?:;…\"”»" or words > 12 else 0.0
    if words < 40 and _LEGAL.search(b.text):
        s += LEGAL
    return s


def min_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of |terminal| over nodes labelled against their sign (positive: True) and of the
    weights of edges whose ends differ.

    A node whose terminal outweighs its edges keeps its sign in every minimum; such nodes are settled first, and
    their edges become terminals of their neighbours. Maximum flow (Dinic) decides what remains.
    """
    n = len(terminal)
    t = list(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if label[k] is None and abs(t[k]) >= sum(near[k].values()):
            label[k] = t[k] > 0
            for j, w in near[k].items():
                t[j] += w if label[k] else -w
                del near[j][k]
                if label[j] is None:
                    queue.append(j)
            near[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        place = {k: i for i, k in enumerate(rest)}
        source, sink = len(rest), len(rest) + 1
        head: list[list[int]] = [[] for _ in range(len(rest) + 2)]
        to: list[int] = []
        cap: list[float] = []

        def add(a: int, b: int, c: float, back: float) -> None:
            head[a].append(len(to))
            to.append(b)
            cap.append(c)
            head[b].append(len(to))
            to.append(a)
            cap.append(back)

        for k in rest:
            if t[k] > 0:
                add(source, place[k], t[k], 0.0)
            elif t[k] < 0:
                add(place[k], sink, -t[k], 0.0)
            for j, w in near[k].items():
                if j > k:
                    add(place[k], place[j], w, w)
        while True:
            level = [-1] * (len(rest) + 2)
            level[source] = 0
            wave = deque([source])
            while wave:
                a = wave.popleft()
                for e in head[a]:
                    if cap[e] > 1e-12 and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        wave.append(to[e])
            if level[sink] < 0:
                break
            next_ = [0] * (len(rest) + 2)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    f = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= f
                        cap[e ^ 1] += f
                    first = next(i for i, e in enumerate(path) if cap[e] <= 1e-12)
                    a = to[path[first] ^ 1]
                    del path[first:]
                while next_[a] < len(head[a]):
                    e = head[a][next_[a]]
                    if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                        break
                    next_[a] += 1
                if next_[a] < len(head[a]):
                    path.append(head[a][next_[a]])
                    a = to[path[-1]]
                elif a == source:
                    break
                else:
                    level[a] = -1
                    a = to[path.pop() ^ 1]
        for k in rest:  # the source's side of the cut
            label[k] = level[place[k]] >= 0
    return [bool(x) for x in label]


def weighed(page: str) -> list[Block]:
    """The blocks, after weighing class words and tags against the text they stand for. Where no block is in a place
    of content and none in a plain place looks like content, the boilerplate element with the most text that is not
    links (a form around the page, an article of class ``promo``) is trusted, with the elements that hold all of that
    text; and so on within it. Comments, cookie notices, footers and navigation are never trusted."""
    trusted: frozenset[int] = frozenset()
    parents: dict[int, int] = {}
    firm: set[int] = set()

    def chain(n: int) -> list[int]:
        out = [n]
        while parents.get(n, n) != n:
            n = parents[n]
            out.append(n)
        return out[::-1]

    while True:
        parents.clear()
        firm.clear()
        found = blocks(page, trusted, parents, firm)
        if any(b.region == 1 or b.region == 0 and evidence(b) > 0 for b in found):
            return found
        held: dict[int, list[Block]] = {}
        for b in found:
            if -3 < b.region < 0 and b.holder not in firm and b.holder not in trusted and evidence(b) - IN_BAD * (1.0, 1.6)[-1 - b.region] > 0:
                held.setdefault(b.holder, []).append(b)
        if not held:
            return found
        holder, own = min(held.items(), key=lambda x: (-sum(len(b.text) for b in x[1]), x[0]))
        shared = chain(own[0].parent)
        for b in own[1:]:
            other = chain(b.parent)
            shared = shared[: next((k for k, (x, y) in enumerate(zip(shared, other, strict=False)) if x != y), min(len(shared), len(other)))]
        trusted |= {holder, *shared}


def main_text(page: str | None) -> str:
    found = weighed(page or "")
    if not found:
        return ""
    edges, last = [], {}
    for k, b in enumerate(found):
        if k:
            edges.append((k - 1, k, NEXT_TO if found[k - 1].holder == b.holder else NEXT_ACROSS))
        if b.parent in last and last[b.parent] != k - 1:
            edges.append((last[b.parent], k, SIBLING))
        elif b.parent in last:
            edges.append((k - 1, k, SIBLING))
        last[b.parent] = k
    keep = min_cut([evidence(b) for b in found], edges)
    if not any(keep):
        keep = min_cut([evidence(b, BASE + BARE) for b in found], edges)
    return " ".join(b.text for b, yes in zip(found, keep, strict=True) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page's whole html.

    The page is cut into blocks of text at block-level elements. A classifier of region (elements and class words),
    length, sentences, headings and links gives each block the log odds of being content; they are the capacities to
    the two terminals. Edges between neighbours in the page and between neighbours with the same parent make a
    labelling smooth; the minimum cut is the best one. Scripts, styles and form controls are no text at all. A class
    word is evidence, not a verdict: words beside a neutral one (``has-comments``) do not count, and where a page has no
    content elsewhere, the words and tag of the boilerplate element with its text are not held against it, unless they
    are those of comments, cookie notices, footers or navigation. A page of plain short lines keeps them. The costs are set by hand in log-odds units: no table labels pages to learn them from.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by one.
    Null or empty html, and pages without content: empty text, 0 characters. Unfinished markup is read as far as it
    goes, long pages whole. Repeated rows and null ids get a row each, empty tables none. Other columns are ignored.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return text_batches(pages).select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op2_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
