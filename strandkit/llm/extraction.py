"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

A tolerant parser builds a tree of elements with runs of text. Every element gets features of its subtree (text, links, density,
paragraphs), its tag and attribute tokens, its depth, place and siblings. Boosted trees, trained in numpy on generated pages whose
article is known, give each element a probability of being main text. Decoding gives every element one of three states, outside,
main or excluded, that along any path from the root can only go on in that order, and takes the most likely whole assignment:
an article inside a menu's ancestor, or a comment inside an article, cannot contradict the choice above it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: Comments, declarations, and tags. A value is quoted only where the quote follows the sign; any other quote is part of a name or value.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*+)(>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg select option button".split())
_CDATA = frozenset("script style textarea title iframe".split())
_BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul br".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, up to the nearest of its bounds.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}
_ENDS_P = _BLOCK - {"br", "html", "body", "head"}
_P_BOUNDS = frozenset("div section article main aside nav header footer li td th form blockquote body figure details".split())
#: Attribute tokens, by what they speak for; fixed words of web practice.
_WORDS = (
    frozenset("article content main post entry story text body prose read news".split()),
    frozenset("nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs".split()),
    frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo promotion".split()),
    frozenset("comment comments disqus reply replies discussion respond".split()),
    frozenset("sidebar side aside widget related recommended rail trending".split()),
    frozenset("footer copyright legal foot colophon".split()),
    frozenset("header masthead top site logo".split()),
    frozenset("cookie consent notice popup modal alert newsletter subscribe gdpr overlay login signup".split()),
    frozenset("share social form search tags byline meta author".split()),
)
_TAGS = ("article", "main", "section", "div", "p", "h", "ul", "li", "nav", "aside", "header", "footer", "form", "table", "blockquote", "a", "inline", "pre")
_TAG_NO = {t: i for i, t in enumerate(_TAGS)} | {f"h{i}": 5 for i in range(1, 7)} | {"ol": 6, "dl": 6, "tr": 13, "td": 13, "th": 13, "tbody": 13}
N_FEATURES = 44


class Node:
    __slots__ = ("tag", "parent", "kids", "words", "parts", "dead")

    def __init__(self, tag: str, parent: Node | None, words: frozenset, dead: bool):
        self.tag, self.parent, self.kids, self.words, self.dead = tag, parent, [], words, dead
        self.parts: list = []  # text runs and children, in order


class _Open:
    """The open elements, and where those of each tag stand, so that no tag has to look through all of them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.bounds = [root], {}, []

    def push(self, node: Node) -> None:
        if node.tag in _P_BOUNDS:
            self.bounds.append(len(self.nodes))
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Closes the element at a place and all in it."""
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            if tag in _P_BOUNDS:
                self.bounds.pop()

    def last(self, tag: str) -> int:
        """Where the innermost open element of a tag stands; 0 if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def end(self, tag: str) -> None:
        """An end tag closes the innermost element of its tag, but an inline one none outside of the table it stands in."""
        place = self.last(tag)
        if place and (tag in _BLOCK or place > self.last("table")):
            self.close(place)

    def before(self, tag: str) -> None:
        """Closes what a start tag ends: a paragraph, or cells, rows and items up to the list or table that holds them."""
        if tag in _ENDS_P and self.last("p") > (self.bounds[-1] if self.bounds else 0):
            self.close(self.last("p"))
        if tag in _CLOSES:
            shut, bounds = _CLOSES[tag]
            bound = max([self.last(t) for t in bounds], default=0)
            outer = [p[i] for p in (self.at.get(t, []) for t in shut) if (i := bisect_right(p, bound)) < len(p)]
            if outer:
                self.close(min(outer))


def parse(html: str) -> Node:
    """Builds the tree in time proportional to the page. A tag cut off by the end of the page is markup and dropped; a `<` that begins no
    tag is text."""
    root = Node("#root", None, frozenset(), False)
    open_, at, n = _Open(root), 0, len(html)
    while at < n:
        cur, m = open_.nodes[-1], _TOKEN.search(html, at)
        if m is None:
            cur.parts.append(html[at:])
            break
        if m.start() > at:
            cur.parts.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        if not m[4]:
            break
        tag = tag.lower()
        if m[1]:
            open_.end(tag)
            continue
        open_.before(tag)
        cur = open_.nodes[-1]
        attrs = m[3]
        words = frozenset(w for a in _ATTR.findall(attrs) for w in _SPLIT.split(_CAMEL.sub(" ", a).lower()) if w) if "=" in attrs else frozenset()
        kid = Node(tag, cur, words, cur.dead or tag in _RAW or tag == "head")
        cur.parts.append(kid)
        cur.kids.append(kid)
        if tag in _VOID or attrs.rstrip().endswith("/"):
            continue
        if tag in _CDATA:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        open_.push(kid)
    return root


def _order(root: Node) -> list[Node]:
    """The live elements, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if not k.dead)
    return out


def features(root: Node) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """Elements, features and the characters of text that each element holds directly."""
    nodes = _order(root)
    index = {id(x): i for i, x in enumerate(nodes)}
    n = len(nodes)
    parent = [index[id(x.parent)] if x.parent is not None else -1 for x in nodes]
    own, marks = [0.0] * n, [0.0] * n
    for i, x in enumerate(nodes):
        for part in x.parts:
            if part.__class__ is str:
                own[i] += len(part.strip())
                marks[i] += part.count(".") + part.count(",")
    total, count = own[:], [1.0] * n
    links = [o if x.tag == "a" else 0.0 for x, o in zip(nodes, own)]
    ps, lis = [float(x.tag == "p") for x in nodes], [float(x.tag in ("li", "a")) for x in nodes]
    hits = [[float(not x.words.isdisjoint(w)) for w in _WORDS] if x.words else [0.0] * len(_WORDS) for x in nodes]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if nodes[i].tag == "a":
            links[i] = total[i]
        total[p] += total[i]
        links[p] += links[i]
        ps[p] += ps[i]
        lis[p] += lis[i]
        count[p] += count[i]
        marks[p] += marks[i]
    # attribute words and tags of what stands above: the tag stands for the word too
    as_word = {"article": 0, "main": 0, "nav": 1, "aside": 4, "footer": 5, "header": 6, "form": 8}
    for i, x in enumerate(nodes):
        if x.tag in as_word:
            hits[i][as_word[x.tag]] = 1.0
    depth, above = [0.0] * n, [[0.0] * len(_WORDS)] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = [a or b for a, b in zip(above[p], hits[p])] if any(hits[p]) else above[p]
    sib, at, same = [1.0] * n, [0.0] * n, [1.0] * n
    for i, x in enumerate(nodes):
        tags: dict[str, int] = {}
        for k in x.kids:
            tags[k.tag] = tags.get(k.tag, 0) + 1
        for j, k in enumerate(x.kids):
            if not k.dead:
                g = index[id(k)]
                sib[g], at[g], same[g] = len(x.kids), j, tags[k.tag]
    own, total, links, count, ps, lis, marks, depth, sib, at, same = (np.array(v) for v in (own, total, links, count, ps, lis, marks, depth, sib, at, same))
    parent = np.array(parent)
    f = np.zeros((n, N_FEATURES))
    tag_no = np.array([_TAG_NO.get(x.tag, 3 if x.tag in _BLOCK else 16) for x in nodes])
    f[np.arange(n), tag_no] = 1
    whole = max(1.0, total[0])
    par = np.maximum(parent, 0)
    rest = np.stack([np.log1p(total), links / np.maximum(1, total), total / np.maximum(1, count), ps, marks / np.maximum(1, total / 20), total / whole, total / np.maximum(1, total[par]), depth], 1)
    f[:, 18:26] = rest
    f[:, 26:35] = hits
    f[:, 35:44] = above
    f[:, 21] = np.minimum(ps, 20)
    extra = np.stack([np.log1p(sib), at / np.maximum(1, sib), same / np.maximum(1, sib), np.minimum(lis, 30) / np.maximum(1, count)], 1)
    return nodes, np.concatenate([f, extra], 1).astype(np.float32), own


@dataclass
class Trees:
    """Boosted trees of a fixed depth as flat arrays; feature -1 marks a leaf that repeats downward."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for t in range(len(self.leaf)):
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, self.feature[t][at]] > self.cut[t][at])
            out += self.leaf[t][at - (self.leaf.shape[1] - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 28, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss with exact splits among up to 24 cuts a feature."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 26)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    width = max(len(c) for c in cuts) + 1
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    p0 = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    z = np.full(len(x), base)
    flat = (np.arange(x.shape[1]) * width)[None, :] + binned
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(len(x), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = None
            if len(rows) > 20:
                G = np.bincount(flat[rows].ravel(), np.repeat(g[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                H = np.bincount(flat[rows].ravel(), np.repeat(h[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                GT, HT = G[:, -1:], H[:, -1:]
                gain = G**2 / (H + ridge) + (GT - G) ** 2 / (HT - H + ridge) - GT**2 / (HT + ridge)
                for j, c in enumerate(cuts):
                    gain[j, len(c) :] = -1
                k = int(gain.argmax())
                if gain.flat[k] > 1e-6:
                    best = divmod(k, width)
            if best is None:
                at[rows] = 2 * node + 1
            else:
                feature[t, node], cut[t, node] = best[0], cuts[best[0]][best[1]]
                at[rows] = 2 * node + 1 + (binned[rows, best[0]] > best[1])
        for k in range(leaves):
            rows = at == inner + k
            leaf[t, k] = -rate * g[rows].sum() / (h[rows].sum() + ridge)
        z += leaf[t][at - inner]
    return Trees(feature, cut, leaf, base)


def decode(nodes: list[Node], logit: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether each element's own text is main: the best assignment of outside (0), main (1) or excluded (2), never falling along a path.

    An element weighs by its text, at least a little, so empty containers follow their contents.
    """
    p = (np.clip(logit, -6, 6) * (np.log1p(own) + 0.3) / 2).tolist()
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    parent = [index[id(x.parent)] if x.parent is not None else -1 for x in nodes]
    out, main, shut = [-v for v in p], [v - 0.5 for v in p], [-v - 0.5 for v in p]
    first, second = [0] * n, [1] * n  # the best state under a parent that is outside, or main
    switch = 1.5  # entering or leaving the main text inside a subtree costs a little
    for i in range(n - 1, -1, -1):
        o, m, x = out[i], main[i] - switch, shut[i] - switch
        first[i], best_o = (0, o) if o >= m and o >= x else (1, m) if m >= x else (2, x)
        second[i], best_m = (1, main[i]) if main[i] >= x else (2, x)
        k = parent[i]
        if k >= 0:
            out[k] += best_o
            main[k] += best_m
            shut[k] += shut[i]
    state = [0] * n
    for i in range(n):
        above = state[parent[i]] if i else 0
        state[i] = first[i] if above == 0 else second[i] if above == 1 else 2
    return np.array(state) == 1


def text_of(root: Node, nodes: list[Node], main: np.ndarray) -> str:
    """Blocks in page order, white space made single, joined by one space, character references decoded."""
    chosen = {id(x) for x, m in zip(nodes, main) if m}
    out: list[str] = []
    stack: list = [root]
    while stack:
        x = stack.pop()
        if x.__class__ is str:
            out.append(x)
            continue
        if x.__class__ is tuple:
            keep, part = x
            out.append(part if keep else " ")
            continue
        if x.dead:
            continue
        block = x.tag in _BLOCK
        if block:
            out.append(" ")
            stack.append(" ")
        keep = id(x) in chosen
        stack.extend((keep, p) if p.__class__ is str else p for p in reversed(x.parts))
    return " ".join(unescape("".join(out)).split())


class Maker:
    """Generates pages whose main elements are known. Everything comes from the seed."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def one(self, *xs):
        return xs[self.r.integers(len(xs))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.r.integers(low, high + 1))
        ws = ["".join(self.r.choice(list("aeiounrstlmdkpbg"), int(self.r.integers(2, 10)))) for _ in range(min(n, 40))]
        ws = [ws[int(self.r.integers(len(ws)))] for _ in range(n)]
        s = " ".join(w + ("," if self.chance(0.06) else "." if self.chance(0.08) else "") for w in ws)
        return s[:1].upper() + s[1:] + "."

    def attr(self, *names: str) -> str:
        if not self.chance(0.8):
            return ""
        return f' {self.one("class", "id", "class")}="{self.one(*names)}{self.one("", "-wrap", " box", "-1")}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)[:-1]}</a>' for i in range(int(self.r.integers(low, high + 1)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else " | ".join(items)

    def paragraph(self) -> str:
        t = self.words(*((4, 15) if self.chance(0.3) else (15, 120)))
        if self.chance(0.2):
            t = self.one("<b>{}</b> ", "<em>{}</em> ", '<a href="#">{}</a> ', "<strong>{}</strong>: ").format(self.words(1, 4)[:-1]) + t
        return t if self.chance(0.1) else t + self.one("", "", "<br>" + self.words(3, 20))

    def article(self) -> str:
        out = [f"<h1>{self.words(3, 10)}</h1>"] if self.chance(0.85) else []
        for _ in range(int(self.r.integers(1, 14))):
            kind = self.r.random()
            if kind < 0.75:
                out.append(f"<p>{self.paragraph()}" + ("</p>" if self.chance(0.92) else ""))
            elif kind < 0.83:
                out.append(f"<h2>{self.words(2, 7)}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.words(3, 20)}</li>" for _ in range(int(self.r.integers(2, 6)))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote>{self.words(10, 50)}</blockquote>")
            else:
                out.append(f"<p><b>{self.words(3, 60)}<br>")
            if self.chance(0.07):
                out.append("<!--x-->" + self.junk())
        return "".join(out)

    def junk(self) -> str:
        """A piece that is never main; marked by data-x."""
        kind = int(self.r.integers(9))
        if kind == 0:
            return f"<{(t := self.one('nav', 'div', 'nav'))} data-x{self.attr('menu', 'nav', 'navbar', 'breadcrumbs')}>{self.links(3, 9)}</{t}>"
        if kind == 1:
            return f"<div data-x{self.one(*(f' class={q}{w}{q}' for q in [chr(34)] for w in ('ad', 'advert', 'ads banner', 'sponsored', 'promo')))}>{self.words(3, 30)}</div>"
        if kind == 2:
            return f"<{(t := self.one('aside', 'div'))} data-x class=\"{self.one('sidebar', 'widget', 'related', 'side-bar')}\"><h3>{self.words(1, 3)}</h3>{self.links(2, 6) if self.chance(0.6) else '<p>' + self.words(5, 40) + '</p>'}</{t}>"
        if kind == 3:
            body = "".join(f'<{(t := self.one("div", "li", "p"))} class="comment">{self.words(5, 40)}</{t}>' for _ in range(int(self.r.integers(1, 5))))
            return f"<{(t := self.one('section', 'div', 'div'))} data-x {self.one('class', 'id')}=\"{self.one('comments', 'comment-list', 'discussion', 'replies')}\">{'<h3>' + self.words(1, 2) + '</h3>' if self.chance(0.5) else ''}{body}</{t}>"
        if kind == 4:
            return f'<div data-x class="{self.one("cookie-notice", "notice", "consent", "newsletter popup", "alert")}">{"<p>" if self.chance(0.5) else ""}{self.words(5, 30)}<button>{self.words(1, 1)}</button></div>'
        if kind == 5:
            return f'<form data-x{self.attr("search", "login", "subscribe")}><label>{self.words(1, 4)}</label><input name="q"><button>{self.words(1, 2)}</button></form>'
        if kind == 6:
            return f"<footer data-x>&copy; {self.words(2, 20)}{self.links(0, 4) if self.chance(0.4) else ''}</footer>"
        if kind == 7:
            return f"<header data-x{self.attr('header', 'masthead', 'site-header')}><h2>{self.words(1, 4)}</h2>{self.links(0, 5) if self.chance(0.6) else ''}</header>"
        return f'<div data-x class="{self.one("share", "social", "tags", "footer", "copyright", "header", "top-bar")}">{self.links(1, 5) if self.chance(0.6) else self.words(2, 12)}</div>'

    def page(self) -> str:
        t, a = self.one(("article", self.attr("post", "story", "entry")), ("main", self.attr("content")), ("div", f' class="{self.one("article", "content", "post-body", "entry-content", "story", "main-content", "article-text")}"'), ("div", f' id="{self.one("content", "main", "article", "story-text")}"'), ("section", self.attr("article", "content")), ("article", ""))
        inner = f"<{t}{a} data-m>{self.article()}{self.junk() if self.chance(0.25) else ''}</{t}>"
        for _ in range(int(self.r.integers(0, 3))):
            inner = f"<div{self.attr('wrap', 'container', 'row', 'page', 'layout')}>{self.junk() if self.chance(0.3) else ''}{inner}{self.junk() if self.chance(0.3) else ''}</div>"
        before, after = "".join(self.junk() for _ in range(int(self.r.integers(0, 4)))), "".join(self.junk() for _ in range(int(self.r.integers(0, 4))))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{before}{inner}{after}</body></html>"


#: Generated pages that the trees learn from.
TRAIN_PAGES = 200
_MODEL: list[Trees] = []


def labels_of(nodes: list[Node], marks: list[tuple[bool, bool]]) -> np.ndarray:
    """1 where the nearest marked ancestor or self is the article."""
    out, index = np.zeros(len(nodes)), {id(x): i for i, x in enumerate(nodes)}
    for i, (x, (m, j)) in enumerate(zip(nodes, marks)):
        up = out[index[id(x.parent)]] if x.parent is not None else 0
        out[i] = 1 if m else 0 if j else up
    return out


def train(pages: int = TRAIN_PAGES, seed: int = 11) -> Trees:
    maker, xs, ys, ws = Maker(seed), [], [], []
    for _ in range(pages):
        # the marks ride in attribute words the features do not look at
        html = maker.page().replace(" data-m", ' role="zzmain"').replace(" data-x", ' role="zzjunk"')
        nodes, x, own = features(parse(html))
        marks = [("zzmain" in k.words, "zzjunk" in k.words) for k in nodes]
        xs.append(x)
        ys.append(labels_of(nodes, marks))
        ws.append(np.log1p(own) + 0.3)
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def model() -> Trees:
    """Trained once a process; the same everywhere."""
    if not _MODEL:
        _MODEL.append(train())
    return _MODEL[0]


def extract_many(pages: list[str | None], trees: Trees) -> list[str]:
    made = [features(root) + (root,) if (root := parse(p)) else None for p in ((q or "") for q in pages)]
    logits = trees.logit(np.concatenate([m[1] for m in made])) if made else []
    out, at = [], 0
    for nodes, x, own, root in made:
        z = logits[at : at + len(nodes)]
        at += len(nodes)
        out.append(text_of(root, nodes, decode(nodes, z, own)))
    return out


def extractor(trees: Trees, block: int = 256):
    @F.pandas_udf("string")
    @tidied
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            rows = list(pages)
            yield pd.Series([t for a in range(0, len(rows), block) for t in extract_many(rows[a : a + block], trees)], dtype=object)

    return apply


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row. Null and empty pages, and pages without main text, have an empty text.

    Truncated pages and unclosed tags are read as far as they go, pages of any length and depth in proportional time. Repeated rows give
    equal rows, other columns are ignored, and an empty table gives an empty result.
    """
    return pages.select("page_id", "url", extractor(model())("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
