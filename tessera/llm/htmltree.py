"""Main text of web pages: a tree-structured graphical model on the DOM's block elements.

Each block element is content (1) or not (0).  Its own log-odds come from its tag, the words of its class, id and role,
its length and the share of its text in links; a potential of the two states couples it with its parent.  Sum-product
messages go from the leaves to the root and back, which gives each element's exact marginal, and the text of elements
whose marginal passes one half is the page's text.  The weights maximise the likelihood of labelled pages; the gradient
needs the same marginals.  labelled_pages() makes such pages; any others of that form may be given.

Defined results.  Null or empty html: empty text.  Broken markup is read as browsers do in the common cases (unclosed
p, li, td; stray ends; unclosed comments).  Text in no block belongs to the body.  White space of any kind inside a
block becomes one space, line-break elements included; a block without ink is left out.  Rows are independent; extra
columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Formulas stand in lines of text.
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source object map".split()) | MATH
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
FOREIGN = frozenset(("svg", "math"))  # in these, and only there, a trailing slash ends an element
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("html table td th caption".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@dataclass
class Element:
    tag: str
    names: str
    parent: int
    size: int = 0  # characters of its own text
    linked: int = 0  # of them in links
    label: bool = False


@dataclass
class Page:
    """Block elements (parents first) and blocks of text as (element, text), in page order."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page([Element("body", "", -1)])
    # the open elements: tag, and its block element (an inline one has that of its parent)
    stack: list[tuple[str, int]] = [("html", 0)]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                e = page.elements[stack[-1][1]]
                e.size += len(text)
                e.linked += min(linked, len(text))
                page.blocks.append((stack[-1][1], text))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        if any(t not in INLINE for t, _ in stack[at:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[at:])
        open_tags.subtract(t for t, _ in stack[at:])
        del stack[at:]

    def innermost(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int:
        if not any(open_tags[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stop:
                break
        return 0

    comment = source.find("<!--", source.rfind("-->") + 1)
    if comment >= 0:  # it has no end, and hides all that follows
        source = source[:comment]
    at, last = 0, source.rfind(">") + 1  # no tag ends past it: what looks like one there is not tried
    while True:
        m = TOKEN.search(source, at, last)
        text = source[at : m.start() if m else len(source)]
        if text:
            parts.append(text)
            if links > 0:
                linked += len(text.strip())
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in INLINE or tag == "p" or tag in SIBLINGS:
                i = innermost({tag}, SCOPE if tag in INLINE or tag == "p" else {"table"} if tag[0] == "t" else {"ul", "ol", "dl", "table"})
            else:
                i = innermost({tag}, set())
            if i:
                close(i)
            continue
        if tag == "br" or tag in VOID:
            if tag in INLINE:
                parts.append(" ")
            elif tag == "hr":
                if i := innermost({"p"}, SCOPE):
                    close(i)
                flush()
            continue
        if m[3].endswith("/") and (tag in FOREIGN or any(open_tags[t] for t in FOREIGN)):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in ("html", "head", "body"):
            flush()
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            open_tags[tag] += 1
            links += tag == "a"
            continue
        if tag in CLOSES_P and (i := innermost({"p"}, SCOPE)):
            close(i)
        if tag in SIBLINGS:
            same, stop = SIBLINGS[tag]
            i = j = 0
            while j := innermost(same, stop):  # td inside tr, and the like
                i = j
                close(i)
        flush()
        names = " ".join("".join(x) for x in NAMES.findall(m[3])) if "=" in m[3] else ""
        page.elements.append(Element(tag, names, stack[-1][1]))
        stack.append((tag, len(page.elements) - 1))
        open_tags[tag] += 1
    flush()
    return page


@lru_cache(maxsize=1 << 16)
def kind(tag: str, names: str) -> tuple[str, ...]:
    """Features of an element that its text doesn't change."""
    return (f"tag={tag}", *(f"name={w.lower()}" for w in dict.fromkeys(WORD.findall(names)) if len(w) > 1))


def shape(e: Element) -> tuple[str, str]:
    """Features of an element's own text."""
    return f"size={min(9, e.size.bit_length())}", f"links={'none' if not e.size else int(4 * e.linked / e.size)}"


@dataclass
class Model:
    weights: dict[str, float]
    couple: list[list[float]]  # potential of (parent's state, own state)


def marginals(page: Page, model: Model, unary: list[float]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(content) of each element, and the joint of (parent, own) states 00, 01, 10, 11 for each edge (element 0: none)."""
    els, ((w00, w01), (w10, w11)) = page.elements, model.couple
    exp, log = math.exp, math.log
    n = len(els)
    below, up = list(unary), [0.0] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        a = max(-30.0, min(30.0, below[i]))
        x = exp(a)
        up[i] = log((exp(w10) + exp(w11) * x) / (exp(w00) + exp(w01) * x))
        below[els[i].parent] += up[i]
    odds, joint = list(below), [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(1, n):
        q = max(-30.0, min(30.0, odds[els[i].parent] - up[i]))  # the parent's odds without this child
        a = max(-30.0, min(30.0, below[i]))
        y, x = exp(q), exp(a)
        j = exp(w00), exp(w01) * x, exp(w10) * y, exp(w11) * x * y
        z = sum(j)
        joint[i] = (j[0] / z, j[1] / z, j[2] / z, j[3] / z)
        odds[i] = log((j[1] + j[3]) / (j[0] + j[2]))
    return [1 / (1 + exp(-max(-30.0, min(30.0, o)))) for o in odds], joint


def unaries(page: Page, weights: dict[str, float]) -> list[float]:
    get = weights.get
    return [sum(get(f, 0.0) for f in (*kind(e.tag, e.names), *shape(e))) for e in page.elements]


def fit(pages: list[Page], steps: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Gradient ascent (Adagrad) on the log-likelihood of labelled elements."""
    model = Model({}, [[0.0, 0.0], [0.0, 0.0]])
    feats = [[(*kind(e.tag, e.names), *shape(e)) for e in p.elements] for p in pages]
    past: dict[object, float] = {}
    for _ in range(steps):
        grad: dict[object, float] = {}
        for p, fs in zip(pages, feats, strict=True):
            prob, joint = marginals(p, model, [sum(model.weights.get(f, 0.0) for f in x) for x in fs])
            for i, e in enumerate(p.elements):
                d = e.label - prob[i]
                for f in fs[i]:
                    grad[f] = grad.get(f, 0.0) + d
                if i:
                    for k, pr in enumerate(joint[i]):
                        grad[k] = grad.get(k, 0.0) + ((2 * p.elements[e.parent].label + e.label == k) - pr)
        for k, g in grad.items():
            now = model.weights.get(k, 0.0) if isinstance(k, str) else model.couple[k >> 1][k & 1]
            g = g / len(pages) - decay * now
            past[k] = past.get(k, 0.0) + g * g
            now += rate * g / math.sqrt(past[k] + 1e-8)
            if isinstance(k, str):
                model.weights[k] = now
            else:
                model.couple[k >> 1][k & 1] = now
    return model


def extract(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = parse(source)
    prob, _ = marginals(page, model, unaries(page, model.weights))
    return "\n".join(t for i, t in page.blocks if prob[i] > 0.5)


#: What labelled pages are made of: (markup before, markup after, block tags inside).
_CHROME = [
    ('<nav class="{n}">', "</nav>", "links"), ('<div class="menu {n}">', "</div>", "links"), ('<ul id="nav">', "</ul>", "items"), ("<header>", "</header>", "short"), ('<div id="header" class="{n}">', "</div>", "short"),
    ("<footer>", "</footer>", "short"), ('<div class="footer">', "</div>", "links"), ('<div role="contentinfo">', "</div>", "short"), ('<aside class="sidebar">', "</aside>", "mixed"), ('<div class="sidebar widget">', "</div>", "mixed"),
    ('<div class="ad">', "</div>", "bare"), ('<div class="ads banner">', "</div>", "bare"), ('<div class="advert promo sponsored">', "</div>", "mixed"), ('<div class="cookie notice">', "</div>", "mixed"), ('<div class="consent banner">', "</div>", "bare"), ('<div class="alert notice">', "</div>", "bare"),
    ('<form class="search">', "</form>", "bare"), ('<form class="newsletter subscribe">', "</form>", "mixed"), ('<div class="share social">', "</div>", "links"), ('<div class="related">', "</div>", "links"), ('<div class="breadcrumb">', "</div>", "links"), ("<aside>", "</aside>", "long"),
    ('<section class="comments">', "</section>", "comments"), ('<div id="comments">', "</div>", "comments"), ('<ol class="comment list">', "</ol>", "items"), ('<div class="related posts">', "</div>", "mixed"), ('<p class="ad">', "</p>", "bare"), ('<p class="notice">', "</p>", "bare"), ('<div role="navigation">', "</div>", "links"),
]
_MAIN = ["<article>", '<article class="post">', "<main>", '<main id="content">', '<div class="content">', '<div class="article body">', '<div class="entry">', '<div id="main"><section>', '<div class="post text">', '<div role="main">']


def labelled_pages(n: int = 160, seed: int = 11) -> list[Page]:
    """Pages of invented prose in common layouts; each element says whether it is content."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g l m n p r s t v".split() for b in "a e i o u an er is".split()]
    words = lambda k: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(k))
    mark = "\x00"  # ends the tag of an element that is content

    def chrome(how: str) -> str:
        if how == "links":
            return "<ul>" + "".join(f'<li><a href="#">{words(rng.randint(1, 3))}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"
        if how == "items":
            return "".join(f'<li><a href="#">{words(rng.randint(1, 3))}</a></li>' if rng.random() < 0.7 else f"<li>{words(rng.randint(5, 40))}</li>" for _ in range(rng.randint(2, 6)))
        if how == "comments":
            return "<h3>" + words(2) + "</h3>" + "".join(f'<div class="comment"><p>{words(rng.randint(4, 80))}</p></div>' for _ in range(rng.randint(1, 4)))
        if how == "mixed":
            return rng.choice(["<h2>" + words(2) + "</h2>", "<h4>" + words(1) + "</h4>", ""]) + "".join(f"<p>{words(rng.randint(3, 40))}</p>" for _ in range(rng.randint(1, 3)))
        if how == "short":
            return rng.choice([f"&copy; {words(4)}", f"<p>{words(5)}</p>", f"<h1>{words(2)}</h1>", f"<h2><a>{words(2)}</a></h2><p>{words(6)}</p>", words(rng.randint(3, 30))])
        return words(rng.randint(3, 80 if how == "long" else 30))

    def piece() -> str:
        before, after, how = rng.choice(_CHROME)
        return before.format(n=words(1)) + chrome(how) + after

    def main() -> str:
        opening = re.sub(">", mark + ">", rng.choice(_MAIN))
        out = [opening]
        if rng.random() < 0.85:
            h = f"<h1{mark}>{words(rng.randint(1, 9))}</h1>"
            out.append(h)
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.7:
                out.append(f"<p{mark}>{rng.choice(['', '<b>'])}{words(rng.choice([1, 2, 5, 20, 60, 150]))} <a>{words(1)}</a>{rng.choice(['</p>', '</p>', '<br>'])}")
            elif r < 0.78:
                out.append(f"<h{(k := rng.randint(2, 4))}{mark}>{words(rng.randint(1, 6))}</h{k}>")
            elif r < 0.84:
                out.append(f"<ul{mark}>" + "".join(f"<li{mark}>{words(rng.randint(2, 25))}</li>" for _ in range(3)) + "</ul>")
            elif r < 0.9:
                tag = rng.choice(["blockquote", "pre", "div", "section", "figcaption"])
                out.append(f"<{tag}{mark}>{words(rng.randint(3, 40))}</{tag}>")
            elif r < 0.93:
                out.append(f"<table{mark}><tr{mark}><td{mark}>{words(2)}<td{mark}>{words(9)}</table>")
            else:
                out.append(piece())
        if rng.random() < 0.2:
            out.append(piece())
        return "".join(out) + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))

    pages = []
    for _ in range(n):
        body = [piece() for _ in range(rng.randint(1, 4))] + [main()] + [piece() for _ in range(rng.randint(0, 3))]
        wrap = rng.choice(["", '<div id="wrapper">', '<div class="container">'])
        if wrap:
            wrap = wrap[:-1] + mark + ">"
        source = f"<body>{wrap}{''.join(body)}{'</div>' if wrap else ''}</body>"
        page = parse(source.replace(mark, ' class="_content_"'))
        page.elements[0].label = True
        for e in page.elements[1:]:
            e.label = "_content_" in e.names
        clean = parse(source.replace(mark, ""))
        for e, c in zip(page.elements, clean.elements, strict=True):
            c.label = e.label
        pages.append(clean)
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages())


def extractor(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                texts = [extract(h, model) for h in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*part.schema.names[1:], "text", "n_chars"])

    return run


def main_text(pages: DataFrame, keep: list[str], model: Model | None = None) -> DataFrame:
    """The columns `keep` of pages with text and n_chars (its code points), from the column html."""
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"])
    return pages.select("html", *keep).mapInArrow(extractor(model or default_model()), schema)
