"""HTML extraction: the maximum-scoring run of words and tags.

A page is read as a row of tokens: words score positive, tags negative, with weights learned from the
labelled pages below; a linear scan finds the contiguous run with the largest sum, the content region.
Where it starts or ends inside an article, it is widened to the whole of it. Its text is returned by
blocks.

Elements that look like menus, headers, footers, sidebars, notices, adverts, forms or comments, by name,
role, class or id, are judged by what else they are like: whether they hold the article or lie in it, their
share of the page's words, how much of them is links. The evidence for each of these is learned from the
same pages. Elements judged to stand beside the article score nothing, so that they neither draw the
region nor split an article, and are left out of the text. So do elements without words.

Elements are nested as HTML nests them: end tags that authors may omit are implied, those without a
start are ignored, and an element ends with its parent.

Nulls and edges: a null or empty page has no text; unclosed comments, scripts and tags reach to the
page's end; a page may be of any length and is read whole; repeated rows and pages without any word are
ordinary; of runs with equal sums the first and then shortest counts; an empty table gives an empty
result. Columns named as those added here are replaced.
"""

from __future__ import annotations

import html
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

#: Elements of HTML by what they do to text and to other elements.
HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe", "canvas", "textarea", "select", "title")
ASIDE = frozenset(("nav", "footer", "aside", "form", "button", "dialog", "menu", "header"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
INLINE_BLOCK = frozenset(("td", "th"))
SPACE = frozenset(("br", "td", "th"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NEVER = frozenset(("html", "head", "body", "main"))
#: Which open elements a start tag closes, and which ones it doesn't look beyond.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption"), ("table",)), "thead": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption"), ("table",)), "tfoot": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption"), ("table",)),
}
#: Words of class, id and role that mark parts beside the article, and words that add nothing to those.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu navbar nav navigation breadcrumb breadcrumbs "
    "footer masthead comment comments disqus respond reaction reactions opinions replies discussion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share "
    "sharing social related recommended pagination pager widget toolbar skip complementary contentinfo dialog".split()
)
FILL = frozenset(
    "site page main global top bottom left right inner outer header head area bar box block container wrap wrapper section slot unit panel list item items link links form button buttons posts post articles stories "
    "content widgets thread reply reader readers user users visitor visitors title text primary secondary local sub small mobile desktop js id fixed sticky floating".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(HIDDEN) + r")(?=[\s/>]|\Z)(?P<rawattrs>[^>]*?)(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
MARKED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Fewer words than these, and less than a tenth of a page's, make no article of their own.
TEASER = 15
#: Marks that a single paragraph of an article may carry.
CALLOUTS = frozenset(("notice", "alert"))
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
LEGAL = re.compile(r"\s*(?:©|&copy;|&#169;|\(c\)|copyright\b|all rights reserved)", re.I)


class Part:
    """An element: its tokens [start, end), its words and how many of them are in links."""

    __slots__ = ("article", "end", "heading", "holds", "link", "open", "parent", "start", "tag", "why", "words", "linked")

    def __init__(self, tag: str, parent: Part | None, start: int, why: str | None) -> None:
        self.tag, self.parent, self.start, self.end, self.why = tag, parent, start, -1, why
        self.words = self.linked = 0
        self.open, self.holds = True, False
        self.article: Part | None = self if tag in ("article", "main") else parent.article if parent else None
        self.heading = tag in HEADING or bool(parent and parent.heading)
        self.link = tag == "a" or bool(parent and parent.link and parent.open)


def reason(tag: str, attrs: str) -> str | None:
    """What lets an element look like a part beside the article: its name, or "mark" where all of a class, an id or
    the role say so, "partly" where some of it does."""
    if tag in ASIDE:
        return tag
    if "=" not in attrs or tag in NEVER:
        return None
    found = None
    for name, *values in MARKED.findall(attrs):
        for token in "".join(values).split():
            words = [p.lower() for p in PARTS.findall(token)]
            if any(w in MARKS and not (tag == "p" and w in CALLOUTS) for w in words):
                if all(w in MARKS or w in FILL or w.isdigit() for w in words):
                    return "mark"
                found = "partly"
    return found


def parse(page: str) -> tuple[list[tuple[str, str, Part, int]], list[Part]]:
    """Tokens (kind, value, element, place in the page), kind "text", "tag" or "raw" ("/" before the name of a closing
    tag), and the elements in the order of their starts."""
    root = Part("", None, 0, None)
    parts, stack, out = [root], [root], []
    named: dict[str, list[Part]] = {}

    def pop() -> None:
        p = stack.pop()
        if p.open:
            p.open, p.end = False, len(out)
            named[p.tag].remove(p) if named[p.tag][-1] is not p else named[p.tag].pop()
        up = p.parent
        up.words += p.words
        up.linked += p.linked
        up.holds = up.holds or p.holds or p.tag in ("article", "main")

    def tidy() -> None:
        while not stack[-1].open and len(stack) > 1:
            pop()

    def close_above(k: int) -> None:
        while len(stack) > k:
            pop()
        tidy()

    def implied(tag: str) -> None:
        if named.get("head") and tag not in HEAD and tag not in ("head", "html"):
            close_above(stack.index(named["head"][-1]))
        if tag in BLOCK and named.get("p"):
            k = len(stack) - 1
            while stack[k].tag not in BLOCK and stack[k].tag not in ("button", "object", ""):
                k -= 1
            if stack[k].tag == "p":
                close_above(k)
        if tag in HEADING and stack[-1].tag in HEADING:
            close_above(len(stack) - 1)
        if tag == "a" and named.get("a"):
            named["a"][-1].open, named["a"][-1].end = False, len(out)
            named["a"].pop()
            tidy()
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            if any(named.get(c) for c in closes):
                k, last = len(stack) - 1, None
                while stack[k].tag and stack[k].tag not in stops:
                    if stack[k].tag in closes and stack[k].open:
                        last = k
                    k -= 1
                if last is not None:
                    close_above(last)

    def text(value: str, at: int) -> None:
        n = len(value.split())
        p = stack[-1]
        p.words += n
        p.linked += n * linked(p)
        out.append(("text", value, p, at))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()], at)
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                out.append(("raw", m["raw"].lower(), stack[-1], m.start()))
            continue
        if m["end"]:
            if not named.get(tag):
                continue
            p = named[tag][-1]
            if tag in BLOCK or stack[-1] is p:
                while stack[-1] is not p:
                    pop()
                out.append(("tag", "/" + tag, p, m.start()))
                pop()
                tidy()
            else:  # an inline element ends, whatever is open inside it
                out.append(("tag", "/" + tag, p, m.start()))
                p.open, p.end = False, len(out)
                named[tag].pop()
            continue
        implied(tag)
        p = Part(tag, stack[-1], len(out), reason(tag, m["attrs"]))
        parts.append(p)
        out.append(("tag", tag, p, m.start()))
        if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCK:
            p.open, p.end = False, len(out)
        else:
            named.setdefault(tag, []).append(p)
            stack.append(p)
    if at < len(page):
        text(page[at:], at)
    while len(stack) > 1:
        pop()
    root.end = len(out)
    return out, parts


def linked(p: Part | None) -> bool:
    """Whether the text of an element stands in a link that is still open."""
    while p is not None and p.link:
        if p.tag == "a" and p.open:
            return True
        p = p.parent
    return False


@dataclass
class Weights:
    """Scores of a word by its kind and of a tag by name, and the evidence that an element stands beside the article."""

    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)
    beside: dict[tuple[str, object], float] = field(default_factory=dict)
    prior: float = 0.0
    other: float = -1.0


def traits(p: Part, total: int) -> list[tuple[str, object]]:
    """What speaks for or against an element's standing beside the article. total: the words of the page."""
    share, within = p.words / max(1, total), p.parent is not None and p.parent.article is not None
    top = p.parent is not None and p.parent.tag in ("body", "html", "")
    return [("why", p.why), ("holds", (p.why, p.holds)), ("share", 0 if share < 0.5 else 1 if share < 0.8 else 2), ("within", (p.why, within)), ("top", (p.why, top)), ("links", 2 * p.linked > p.words)]


def beside(parts: list[Part], weights: Weights) -> set[int]:
    """The ids of the elements beside the article, those inside such elements included."""
    total, out = parts[0].words, set()
    for p in parts:
        if p.tag == "head" or p.parent is not None and id(p.parent) in out:
            out.add(id(p))
        elif p.why and weights.prior + sum(weights.beside.get(t, 0.0) for t in traits(p, total)) > 0:
            out.add(id(p))
    return out


def main_articles(parts: list[Part], off: set[int]) -> tuple[bool, set[int]]:
    """Whether articles hold half of the words that stand beside nothing and in no link, so that what lies outside them is no content;
    and, where they don't, the ids of those that only point elsewhere: articles that are links for the most part, that have
    a link for a heading, or that have a few words among many."""
    whole = [p for p in parts if p.tag in ("article", "main") and id(p) not in off and p.article is p and (p.parent is None or p.parent.article is None)]
    words = lambda p: p.words - p.linked
    hidden = sum(words(p) for p in parts if id(p) in off and (p.parent is None or id(p.parent) not in off))
    total, inside = words(parts[0]) - hidden, sum(words(p) for p in whole)
    if 2 * inside >= total:
        return bool(whole), set()
    heads = {id(p.article) for p in parts if p.tag == "a" and p.heading and p.article is not None}
    teaser = lambda p: 2 * p.linked > p.words or id(p) in heads or p.words < TEASER and 10 * p.words < total
    return False, {id(p) for p in whole if teaser(p)}


def word_kind(p: Part, value: str, has_article: bool, teasers: set[int] = frozenset()) -> str:
    """A word's kind: in a heading, link, legal line or plainly; outside the article of a page that has one, or not."""
    kind = "heading" if p.heading else "legal" if LEGAL.match(value) else "link" if p.link else "plain"
    outside = has_article if p.article is None else id(p.article) in teasers
    return kind + " outside" if outside else kind


def scored(page: str, weights: Weights) -> tuple[list[tuple[str, str, Part, int]], list[float], set[int]]:
    out, parts = parse(page)
    off = beside(parts, weights)
    has_article, teasers = main_articles(parts, off)
    scores = []
    for kind, value, p, _ in out:
        if id(p) in off or kind == "raw":
            scores.append(0.0)
        elif kind == "tag":
            scores.append(weights.tag.get(value.lstrip("/"), weights.other) if p.words else 0.0)
        else:
            scores.append(len(value.split()) * weights.word.get(word_kind(p, value, has_article, teasers), 0.2))
    return out, scores, off


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, one past the last) of the contiguous run with the largest positive sum, the first and then
    shortest of equals; (0, 0) if none is positive."""
    best, run, low, out = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if run <= 0:
            run, low = 0.0, k
        run += s
        if run > best:
            best, out = run, (low, k + 1)
    return out


def region(tokens: list[tuple[str, str, Part, int]], scores: list[float]) -> tuple[int, int]:
    """The best run; where its first or last word stands in an article (else in main), from that one's start or to its end."""
    low, high = best_run(scores)
    if low == high:
        return low, high
    words = [k for k in range(low, high) if tokens[k][0] == "text" and scores[k]]
    for k in (words[0], words[-1]) if words else ():
        if (a := tokens[k][2].article) is not None:
            low, high = min(low, a.start), max(high, a.end)
    return low, high


def unmarked(page: str) -> tuple[str, list[tuple[int, int, bool]]]:
    """A labelled page without its brackets, and the places where content begins or ends: ⟦content⟧, ⟪not content⟫ inside it."""
    text, spans, inside = "", [(0, False)], []
    for piece in re.split("([⟦⟧⟪⟫])", page):
        if piece in ("⟦", "⟪"):
            inside.append(piece == "⟦")
        elif piece in ("⟧", "⟫"):
            inside.pop()
        else:
            spans.append((len(text), bool(inside) and inside[-1]))
            text += piece
    return text, [(a, b, on) for (a, on), (b, _) in zip(spans, [*spans[1:], (len(text), False)])]


def is_content(at: int, spans: list[tuple[int, int, bool]]) -> bool:
    return any(on for a, b, on in spans if a <= at < b)


def train(pages=None) -> Weights:
    """Log-odds of lying in the content, smoothed: of elements that may stand beside the article, by their traits; then of
    words and tags outside those. Words of content kinds keep a small positive score at least, tags a small negative one at most."""
    pages = LABELLED if pages is None else pages
    weights, read = Weights(), []
    off, on = Counter(), Counter()
    for page in pages:
        text, spans = unmarked(page)
        tokens, parts = parse(text)
        content = [is_content(at, spans) for *_, at in tokens]
        read.append((tokens, parts, content))
        for p in parts:
            if p.why and p.end > p.start:
                own = [(len(v.split()), c) for (k, v, *_), c in zip(tokens[p.start : p.end], content[p.start : p.end]) if k == "text"]
                good = sum(n for n, c in own if c)
                side = on if 2 * good > sum(n for n, _ in own) else off
                side.update([("all", None), *traits(p, parts[0].words)])
    n_on, n_off = on["all", None], off["all", None]
    weights.prior = math.log((n_off + 1) / (n_on + 1))
    weights.beside = {t: math.log((off[t] + 0.3) / (n_off + 1)) - math.log((on[t] + 0.3) / (n_on + 1)) for t in {*on, *off} if t[0] != "all"}
    inside, outside = Counter(), Counter()
    for tokens, parts, content in read:
        apart = beside(parts, weights)
        has_article, teasers = main_articles(parts, apart)
        for (kind, value, p, _), good in zip(tokens, content):
            if id(p) in apart or kind == "raw":
                continue
            side = inside if good else outside
            if kind == "text":
                side["word", word_kind(p, value, has_article, teasers)] += len(value.split())
            elif p.words:
                side["tag", value.lstrip("/")] += 1
    odds = lambda k: math.log((inside[k] + 0.5) / (outside[k] + 0.5))
    kinds = {k[1] for k in {*inside, *outside} if k[0] == "word"}
    floor = lambda k: -5.0 if "outside" in k or k == "legal" else 0.2
    weights.word = {k: min(3.0, max(floor(k), odds(("word", k)))) for k in kinds}
    weights.tag = {k[1]: max(-1.2, min(-0.2, odds(k) - 1.0)) for k in {*inside, *outside} if k[0] == "tag"}
    weights.tag |= dict.fromkeys(("html", "head", "body", ""), 0.0)
    return weights


def extract(page: str | None, weights: Weights) -> str:
    tokens, scores, off = scored(page or "", weights)
    low, high = region(tokens, scores)
    blocks, now = [], []

    def close() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for kind, value, p, _ in tokens[low:high]:
        if kind == "tag":
            tag = value.lstrip("/")
            if tag in SPACE:
                now.append(" ")
            elif tag in BLOCK:
                close()
        elif kind == "text" and id(p) not in off:
            now.append(html.unescape(value))
    close()
    return "\n\n".join(blocks)


def extract_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """All columns of ``pages``, text (string) and n_chars (long)."""
    weights = weights or train()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([extract(p, weights) for p in b], dtype=object)

    return pages.withColumn("text", run(F.col("html"))).withColumn("n_chars", F.char_length("text").cast("long"))


#: The labelled pages are every one of these articles in every one of the frames below. What lies in ⟦⟧ is content, in ⟪⟫ inside it is not.
ARTICLES = (
    "<h1>The long way home</h1><p>We walked for hours along the river and no one said a word until the bridge came into view.</p><p>It was <b>late</b> when we came back.</p>",
    "<h2>Notes on bread</h2><p>Flour, water, salt and time are all it takes to bake a loaf worth eating.<ul><li>Mix the flour with the water and wait.<li>Fold the dough every hour.</ul><p>Bake it hot.",
    '<header><h1><a href="/plan">The committee met</a></h1><p>By A. Writer</p></header><p>The committee met on Tuesday to discuss the plan, which had been <a href="z">announced</a> in spring.</p><p>Nothing was decided, but members agreed to meet again within the month.<br>Minutes will follow.</p><blockquote>We have time, said the chair.</blockquote>',
    '<h1>Rain expected</h1><p>Heavy rain is expected in the north by the evening, with winds from the west.</p>⟪<div class="ad">Buy a new coat today</div>⟫<p>Drivers should take care on the coast roads.</p><table><tr><td>North<td>rain<tr><td>South<td>sun</table>',
    '<h1>Old maps</h1><p>Maps of the town from three centuries hang in the hall.</p>⟪<aside>See also: <a href="g">guides</a></aside>⟫<p>The oldest shows the bridge with its <i>five</i> arches.</p><section class="related-work"><h2>Visits</h2><p>Open daily, and on Sundays with a guide who knows every street.</p></section>',
    '<h1>What we changed</h1><p id="comment-policy">Readers asked us why comments close after a week, so here is the reason in full.</p><figure><img src="a.png"></figure><figure><img src="b.png"><figcaption>The old form</figcaption></figure><p>They close because nobody reads them later.</p><p><a href="r">The full report of the editors</a></p>',
    '<h1>Ad hoc tables</h1><div class="ad-hoc"><p>An ad hoc table holds what a report needs on one day, and nobody keeps it longer than that.</p></div><div></div><div></div><p>It is dropped at night.</p>⟪<div class="share-buttons"><a href="s">Share</a> <a href="t">Tell</a></div>⟫',
)
#: Frames: {} is where the article goes.
FRAMES = (
    '<html><head><title>A</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav>⟦<article>{}</article>⟧<footer>Copyright 2020 by us</footer></body></html>',
    '<body><div class="menu"><a href="a">One</a><a href="b">Two</a><a href="c">Three</a></div><div id="content">⟦{}⟧</div><div class="sidebar"><h3>Tags</h3><ul><li><a href="t">bread</a></li><li><a href="u">oven</a></li></ul></div></body>',
    '<body><header><a href="/">Logo</a><form><input name="q"><button>Go</button></form></header><main>⟦{}⟧</main><aside><p>Read next: <a href="n">a story</a></p></aside><footer><p><a href="c">Contact</a> <a href="i">Imprint</a></p></footer></body>',
    '<html><body><ul><li><a href="1">News</a></li><li><a href="2">Sport</a></li><li><a href="3">Mail</a></li></ul><div class="ad">Buy now</div><div>⟦{}⟧</div><div class="comments"><p>First! I have read all of this and I agree with most of what it says.</p><p>So true.</p></div><script>track(1)</script></body></html>',
    '<html><body><a href="/">Start</a> <a href="/a">About</a><div>⟦<article>{}</article>⟧</div><p>&copy; 2021 The Town</p><div>Printed on paper by hand since the town was small</div><a href="/c">Contact</a> <a href="/p">Privacy</a></body></html>',
    '<html><head><meta charset="utf-8"><title>B</title><body class="has-sidebar"><div class="has-sidebar layout"><div class="post comments-open">⟦{}⟧</div><div id="sidebar"><h3>Latest</h3><p>Ten things about the town that you did not know before today.</p></div></div><div id="footer">All rights reserved</div>',
    '<body><header><h1>The Daily Town</h1><p>News for all who live here</p></header><div class="wrap"><div>⟦{}⟧</div></div><footer>Printed weekly in the town</footer></body>',
    '<body><header>The Daily Town</header><section>⟦<article>{}</article>⟧</section><aside class="related">Two more stories about this</aside></body>',
    '<body><form action="/page"><div class="with-banner"><div class="cookie-notice">We use cookies to make this page better. <button>Fine</button></div>⟦<article>{}</article>⟧</div><div class="site-footer"><a href="t">Terms</a></div></form></body>',
    '<body><div role="banner"><h1><a href="/">The Paper</a></h1></div><div role="navigation"><a href="n">News</a> <a href="o">Opinion</a></div><p class="ad">Buy this<div class="widget-layout"><div class="story">⟦{}⟧</div></div><section id="comments"><h2>Comments</h2><article class="comment"><p>I do not think that this is right at all.</p></article><article class="comment"><p>Nor do I, but it is well said.</p></article></section></body>',
    '<body><div class="navbar"><ul><li class="menu"><a href="a">A</a><li class="menu"><a href="b">B</a></ul></div><main>⟦<article>{}</article>⟧<div class="related-posts"><h2>Related</h2><ul><li><a href="p">One more story</a><li><a href="q">And another one</a></ul></div><div class="newsletter-box">Get our letter each week. <form><input></form></div></main><div class="page-footer">Made in town. Copyright 2022</div></body>',
)
LABELLED = tuple(frame.replace("{}", article) for frame in FRAMES for article in ARTICLES)

cloudpickle.register_pickle_by_value(sys.modules[__name__])
