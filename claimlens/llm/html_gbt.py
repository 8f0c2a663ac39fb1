"""Main text of web pages by gradient-boosted trees over DOM nodes.

A small tokenizer builds the node tree (void elements, implied end tags, raw scripts and styles,
comments, character references). Each element is described by its tag, words in its
attributes, depth, siblings, and the text, links and tags of its subtree; boosted regression trees, grown here on
templates made by pages_of(), say how likely it is part of the article. Decoding is hierarchical: log-odds add up
from the root down, an element inside a dropped one is dropped, and what is inside the article stays unless it
is itself dropped, so an ancestor and a descendant never contradict each other.

Text of kept nodes forms blocks: block elements part them, white space in a block becomes one space.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short, text_of

#: Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
FORMAT = set("a b big code em font i small span strike strong tt u".split())
#: Never text, whatever the trees say.
UNSEEN = {"script", "style", "head", "title", "noscript", "template", "iframe", "textarea", "select", "button", "svg", "object"}

TAGS = "article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form table tr td blockquote pre figure figcaption a b span body html dl button input label".split()
#: Words in class, id and role that stand for a kind of part.
HINTS = {
    "main": "article content main post entry story body text prose page".split(),
    "menu": "nav menu navbar breadcrumb breadcrumbs tabs toolbar pagination pager".split(),
    "head": "header masthead banner top brand logo".split(),
    "foot": "footer foot bottom copyright legal colophon".split(),
    "side": "sidebar side aside widget rail related recommended popular trending promo".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promoted".split(),
    "note": "cookie cookies notice consent alert popup modal overlay newsletter subscribe signup gdpr warning".split(),
    "talk": "comment comments reply replies discussion respond disqus thread".split(),
    "share": "share social sharing follow meta byline tags author date".split(),
    "form": "form search login contact".split(),
}
HINT_OF = {w: k for k, words in enumerate(HINTS.values()) for w in words}
N_TAGS, N_HINTS = len(TAGS) + 1, len(HINTS)
TAG_OF = {t: k for k, t in enumerate(TAGS)}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SPECIAL = re.compile(r"[>\"']")
#: Elements beyond which an open paragraph is not closed.
BOUNDS = {"td", "th", "table", "button", "object"}
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Ends:
    """Where tags end. Each quote and each > is looked at once, however many tags before it fail, so a page takes linear time."""

    def __init__(self, source: str):
        self.source, self.known, self.run = source, {}, (0, -1)
        self.last = {c: source.rfind(c) for c in ">\"'"}

    def _next(self, at: int) -> int:
        """The next > or quote from at on; -1 if there is none."""
        lo, hi = self.run
        if lo <= at <= hi:
            return hi
        if at > max(self.last.values()):
            return -1
        found = SPECIAL.search(self.source, at)
        self.run = (at, found.start())
        return found.start()

    def __call__(self, at: int) -> int:
        """The > that ends the tag whose attributes begin at `at`, outside quotes; -1 if there is none."""
        passed: list[int] = []
        while True:
            k = self._next(at)
            if k < 0 or k in self.known:
                end = self.known.get(k, -1)
                break
            passed.append(k)
            c = self.source[k]
            if c == ">":
                end = k
                break
            if k >= self.last[c]:
                end = -1
                break
            at = self.source.find(c, k + 1) + 1
        self.known.update(dict.fromkeys(passed, end))
        return end


class Tree:
    """Elements of a page in document order: tag, hint counts, parent; and its texts with their element."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.hints: list[dict[int, int]] = [{}]
        self.parent: list[int] = [-1]
        #: (element, text), (element, None) where an element begins, (-element, None) where it ends.
        self.parts: list[tuple[int, str | None]] = []
        self.open = [0]
        #: For each tag, and for blocks, the places in `open` where it stands; for each open element whether a paragraph is open in its bounds.
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.in_p = [False]
        self._read(source)

    def _text(self, text: str) -> None:
        if text:
            self.parts.append((self.open[-1], entities.unescape(text) if "&" in text else text))

    def _nearest(self, tags: set[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P and self.in_p[-1]:
            self._end("p")
        if tag in SAME:
            while (k := self._nearest(SAME[tag])) > self._nearest(SCOPE[tag]):
                self._close(k)
        hints: dict[int, int] = {}
        if attributes:
            for found in ATTRIBUTE.finditer(attributes):
                for word in SPLIT.split((found[1] or found[2] or found[3] or "").lower()):
                    if (k := HINT_OF.get(word)) is not None:
                        hints[k] = hints.get(k, 0) + 1
        self.tag.append(tag)
        self.hints.append(hints)
        self.parent.append(self.open[-1])
        self.parts.append((len(self.tag) - 1, None))
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.in_p.append(tag == "p" or tag not in BOUNDS and self.in_p[-1])
            self.open.append(len(self.tag) - 1)

    def _close(self, k: int) -> None:
        for own in reversed(self.open[k:]):
            self.parts.append((-own, None))
            self.at[self.tag[own]].pop()
            if self.tag[own] in BLOCK:
                self.blocks.pop()
        del self.open[k:], self.in_p[k:]

    def _end(self, tag: str) -> None:
        k = self._nearest({tag})
        if k > 0 and not (tag in FORMAT and self.blocks and self.blocks[-1] > k):  # a stray end of formatting does not end a block
            self._close(k)

    def _read(self, source: str) -> None:
        ends, at, begin = Ends(source), 0, 0
        while True:
            at = source.find("<", at)
            if at < 0:
                return self._text(source[begin:])
            close, tag, attributes = -1, "", ""
            if source.startswith(("<!--", "<![CDATA["), at):
                mark = "-->" if source[at + 2] == "-" else "]]>"
                close = source.find(mark, at + 4)
                close = len(source) if close < 0 else close + 3
            elif source[at + 1 : at + 2] in ("!", "?") and at + 1 < len(source):
                close = source.find(">", at) + 1 if at < ends.last[">"] else -1
            elif name := NAME.match(source, at + 2 if source.startswith("/", at + 1) else at + 1):
                close = ends(name.end()) + 1 or -1
                tag, attributes = name[0].lower(), source[name.end() : close - 1] if close > 0 else ""
            if close <= 0:
                at += 1
                continue
            self._text(source[begin:at])
            is_end, at, begin = source[at + 1] == "/", close, close
            if not tag:
                continue
            if is_end:
                self._end(tag)
                continue
            self._begin(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                inside = source[at : found.start() if found else len(source)]
                if tag in ("textarea", "title"):
                    self._text(inside)
                at = begin = found.end() if found else len(source)
                self._end(tag)


def describe(tree: Tree) -> np.ndarray:
    """A row of features for each element."""
    n = len(tree.tag)
    parent = np.array(tree.parent)
    tag = np.array([TAG_OF.get(t, N_TAGS - 1) for t in tree.tag])
    hints = np.zeros((n, N_HINTS))
    for k, own in enumerate(tree.hints):
        for h, c in own.items():
            hints[k, h] = c
    chars, words, marks = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, text in tree.parts:
        if text:
            chars[k] += len(text)
            words[k] += text.count(" ") + 1
            marks[k] += text.count(".") + text.count(",")
    unseen = np.array([t in UNSEEN for t in tree.tag])
    chars[unseen] = words[unseen] = marks[unseen] = 0
    link = np.array([t == "a" for t in tree.tag])
    depth = np.zeros(n)
    in_link, place, siblings = link.astype(float), np.zeros(n), np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        in_link[k] = max(in_link[k], in_link[p])
        place[k] = siblings[p]
        siblings[p] += 1
    sub = np.stack([chars, words, marks, chars * in_link, np.ones(n), np.array([t == "p" for t in tree.tag], float), link.astype(float), np.array([t == "li" for t in tree.tag], float)], 1)
    for k in range(n - 1, 0, -1):
        sub[parent[k]] += sub[k]
    above = hints.copy()
    for k in range(1, n):
        above[k] += above[parent[k]]
    up = np.maximum(parent, 0)
    size = np.maximum(sub[:, 0], 1)
    out = np.zeros((n, N_TAGS * 2 + N_HINTS * 2 + 14), np.float32)
    out[np.arange(n), tag] = 1
    out[np.arange(n), N_TAGS + tag[up]] = 1
    at = 2 * N_TAGS
    out[:, at : at + N_HINTS] = hints
    out[:, at + N_HINTS : at + 2 * N_HINTS] = above
    at += 2 * N_HINTS
    out[:, at:] = np.stack([
        np.log1p(sub[:, 0]), np.log1p(sub[:, 1]), sub[:, 2] / size * 20, sub[:, 3] / size, np.log1p(sub[:, 4]), sub[:, 0] / sub[:, 4] / 100,
        np.log1p(sub[:, 5]), np.log1p(sub[:, 6]), np.log1p(sub[:, 7]), depth, place, siblings[up], sub[:, 0] / max(sub[0, 0], 1), np.arange(n) / n,
    ], 1)
    return out


class Boosted:
    """Binary gradient boosting with depth-limited regression trees on binned features; a leaf has at least a sum of `least` of the curvature."""

    def __init__(self, trees: int = 80, depth: int = 5, rate: float = 0.25, bins: int = 32, least: float = 1.0):
        self.size, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut, value = (np.zeros(2 ** (self.depth + 1) - 1, t) for t in (np.int64, np.float32, np.float32))
            feature[:] = -1
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth + 1):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if not len(rows):
                        continue
                    value[k] = -g[rows].sum() / (h[rows].sum() + 1)
                    if level == self.depth or h[rows].sum() < 2 * self.least:
                        continue
                    best = self._split(binned[rows], g[rows], h[rows])
                    if best:
                        feature[k], b = best
                        cut[k] = self.edges[feature[k]][b]
                        node[rows] = 2 * k + 1 + (binned[rows, feature[k]] > b)
            self.trees.append((feature, cut, value))
            score += self.rate * value[node]
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        n, width = binned.shape
        at = (binned + np.arange(width) * self.bins).ravel()
        total = lambda v: np.bincount(at, np.repeat(v, width), width * self.bins).reshape(width, self.bins).cumsum(1)
        gl, hl = total(g), total(h)
        gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
        gain[(hl < self.least) | (hr < self.least)] = -1
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        return (int(f), int(b)) if gain[f, b] > 1e-3 and b < len(self.edges[f]) else None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]))
            out += self.rate * value[node]
        return out


def pages_of(n: int, seed: int = 3) -> Iterator[tuple[str, str]]:
    """Labelled pages: html in which each element of the article has the attribute keep, and its text."""
    rng = Random(seed)
    pick = lambda *x: rng.choice(x)
    syllables = "an be co da el fi go hu in ka lo mi no or pa qui re su ta un ve wo ya zu ß é ñ".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 5)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b))).capitalize() + pick(".", ".", ",", "!", "", "&amp;", "%%%", "***")
    prose = lambda: " ".join(say(3, 14) for _ in range(rng.randrange(1, 7)))
    links = lambda a, b, tag="li": "".join(f"<{tag}><a href='/{word()}'>{say(1, 3)}</a></{tag}>" for _ in range(rng.randrange(a, b)))
    attr = lambda *names: pick("", "", f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{word()} {pick(*names)} box"')
    surely = lambda *names: pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{word()} {pick(*names)}"')

    def paragraph() -> str:
        k = "keep"
        kind = rng.random()
        if kind < 0.6:
            return f"<p {k}>{prose()}</p>"
        if kind < 0.68:
            return f"<p {k}><b {k}>{prose()}<br><p {k}>{prose()}</p>"
        if kind < 0.74:
            return "<h{0} {1}>{2}</h{0}>".format(pick(2, 3), k, say(1, 8))
        if kind < 0.8:
            return f"<ul {k}>" + "".join(f"<li {k}>{say(2, 14)}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>"
        if kind < 0.84:
            return f"<blockquote {k}><p {k}>{prose()}</p></blockquote>"
        if kind < 0.88:
            return f"<p {k}>{prose()} <a {k} href='/x'>{say(1, 5)}</a> <em {k}>{say(1, 4)}</em> {prose()}</p>"
        if kind < 0.92:
            return f"<div {k}>{prose()}</div>"
        if kind < 0.95:
            return f"<table {k}><tr {k}><td {k}>{say(1, 5)}</td><td {k}>{say(1, 5)}</td></tr></table>"
        return pick(f'<div{surely("ad", "advert", "sponsored")}>{prose()}</div>', f"<aside>{prose()}</aside>", f'<div{surely("share", "social")}>{links(2, 5, "span")}</div>', f"<form><label>{say(1, 4)}</label><input></form>")

    for _ in range(n):
        before, after = [], []
        if rng.random() < 0.5:
            before.append(pick("<header{0}>{1}</header>", "<div{2}>{1}</div>").format(attr("header", "masthead"), pick(f"<h1>{say(1, 4)}</h1>", f"<a href='/'>{say(1, 3)}</a>", f"<p>{say(2, 9)}</p>"), surely("header", "masthead", "site-header", "banner")))
        if rng.random() < 0.8:
            before.append(pick("<nav{0}><ul>{1}</ul></nav>", "<nav>{2}</nav>", "<div{3}><ul>{1}</ul></div>", "<ul{3}>{1}</ul>").format(attr("nav", "menu"), links(3, 9), links(3, 9, "span"), surely("nav", "menu", "navbar", "breadcrumb")))
        for p, side, what in (
            (0.5, before, lambda: f'<div{surely("ad", "ads", "advert", "ad-banner", "sponsored", "promo")}>{pick(prose(), say(2, 9))}</div>'),
            (0.3, before, lambda: "<{0}{1}><p>{2}</p><button>{3}</button></{0}>".format(pick("div", "section"), surely("cookie", "cookie-notice", "consent", "notice", "alert", "gdpr"), prose(), say(1, 2))),
            (0.35, after, lambda: pick(f"<aside{attr('sidebar', 'related')}><h3>{say(1, 3)}</h3><ul>{links(2, 7)}</ul></aside>", f"<aside{attr('sidebar')}><p>{prose()}</p></aside>", f'<div{surely("sidebar", "related", "widget")}><p>{prose()}</p><ul>{links(1, 5)}</ul></div>')),
            (0.3, after, lambda: "<{0}{1}><h2>{2}</h2>{3}</{0}>".format(pick("div", "section"), surely("comments", "comment-list", "discussion", "replies"), say(1, 3), "".join(f'<div{attr("comment", "reply")}><p>{prose()}</p></div>' for _ in range(rng.randrange(1, 5))))),
            (0.3, after, lambda: pick(f"<form{attr('form', 'newsletter')}><label>{say(1, 5)}</label><input><button>{say(1, 2)}</button></form>", f'<div{surely("newsletter", "subscribe", "signup")}><p>{prose()}</p></div>', f"<form><p>{prose()}</p><textarea>{word()}</textarea></form>")),
            (0.75, after, lambda: pick(f"<footer{attr('footer')}>&copy; {say(2, 9)} &middot; {say(2, 9)}</footer>", f"<footer><p>{prose()}</p><ul>{links(1, 5)}</ul></footer>", f'<div{surely("footer", "foot", "copyright")}>&copy; {say(2, 12)}</div>')),
        ):
            if rng.random() < p:
                side.append(what())
        k = "keep"
        body = (f"<h1 {k}>{say(2, 9)}</h1>" if rng.random() < 0.8 else "") + "".join(paragraph() for _ in range(rng.randrange(1, 14)))
        shell = rng.random()
        main = (
            f"<article {k}>{body}</article>" if shell < 0.5 else f"<main {k}>{body}</main>" if shell < 0.62
            else f"<main {k}><article {k}>{body}</article></main>" if shell < 0.72 else f'<div {k} class="{pick("content", "post", "article-body", "entry", "story")}">{body}</div>'
            if shell < 0.88 else f'<div {k} id="main"><div {k} class="post">{body}</div></div>'
        )
        if rng.random() < 0.15 and after:
            main = main.replace("</article>", after.pop(0) + "</article>", 1) if "</article>" in main else main
        rng.shuffle(after)
        page = "".join(before) + main + "".join(after)
        yield f"<html><head><title>{say(1, 5)}</title></head><body>{page}</body></html>", body


@lru_cache(maxsize=1)
def model(pages: int = 1500) -> Boosted:
    """Trees grown on `pages` made pages, as said by pages_of(); grown on the driver."""
    x, y = [], []
    for source, _ in pages_of(pages):
        tree = Labelled(source)
        x.append(describe(tree)[tree.use])
        y.append(np.array(tree.keep, float)[tree.use])
    return Boosted().fit(np.concatenate(x), np.concatenate(y))


class Labelled(Tree):
    """A tree of which the attribute keep says what belongs to the article; its shells are left out."""

    def __init__(self, source: str):
        self.keep: list[bool] = [False]
        super().__init__(source)
        self.use = [t not in ("#root", "html", "body", "br") and t not in UNSEEN for t in self.tag]

    def _begin(self, tag: str, attributes: str) -> None:
        super()._begin(tag, attributes.replace("keep", ""))
        self.keep.append(" keep" in f" {attributes}")


NEUTRAL = {"#root", "html", "body"}
#: Log odds within which neighbours of the best block are taken with it where nothing else is kept.
CLOSE = 1.0


def decode(tree: Tree, odds: np.ndarray) -> list[bool]:
    """Whether each element's own text is kept.

    A block's odds add to half of its parent's sum, and a block whose sum is negative is out; inline
    elements go with their parent, and all below a dropped element is out. Text right in the body is in none of the
    parts that are left out, so it stays. If nothing that holds text is kept, the block with the best odds of its own is, with
    those of its parent that come within CLOSE of it.
    """
    n = len(tree.tag)
    keep, total = [t in NEUTRAL for t in tree.tag], np.zeros(n)
    dropped = [False] * n
    for k in range(1, n):
        p, tag = tree.parent[k], tree.tag[k]
        if tag in NEUTRAL:
            continue
        inline = tag not in BLOCK
        total[k] = total[p] if inline and p and tree.tag[p] not in NEUTRAL else odds[k] + 0.5 * total[p]
        dropped[k] = dropped[p] or tag in UNSEEN or (total[k] < 0 and tag not in VOID)
        keep[k] = not dropped[k]
    told = {k for k, text in tree.parts if text is not None and text.strip()}
    if not any(keep[k] for k in told):
        hidden = [False] * n
        for k in range(1, n):
            hidden[k] = hidden[tree.parent[k]] or tree.tag[k] in UNSEEN
        owner = {}  # the block that an element's text belongs to
        for k in told:
            b = k
            while tree.tag[b] not in BLOCK and tree.parent[b] and tree.tag[tree.parent[b]] not in NEUTRAL:
                b = tree.parent[b]
            if not hidden[k]:
                owner[k] = b
        if owner:
            best = max(owner.values(), key=lambda b: (odds[b], -b))
            for k, b in owner.items():
                keep[k] = b == best or (tree.parent[b] == tree.parent[best] and odds[b] >= odds[best] - CLOSE)
    return keep


def blocks(tree: Tree, keep: list[bool]) -> str:
    """The kept text: one line per block."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        line = " ".join("".join(now).split())
        if line:
            out.append(line)
        now.clear()

    for k, text in tree.parts:
        if text is not None:
            if keep[k]:
                now.append(text)
        elif tree.tag[abs(k)] in BLOCK:
            flush()
        elif tree.tag[k] == "br":
            now.append(" ")
    flush()
    return "\n".join(out)


def main_text(source: str) -> str:
    """The article's text of one page."""
    return main_texts([source])[0]


def main_texts(sources: list[str], trained: Boosted | None = None) -> list[str]:
    trees = [Tree(s) for s in sources]
    rows = [describe(t) for t in trees]
    odds = (trained or model())(np.concatenate(rows)) if rows else np.zeros(0)
    ends = np.cumsum([0] + [len(r) for r in rows])
    return [blocks(t, decode(t, odds[a:b])) for t, a, b in zip(trees, ends[:-1], ends[1:], strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row for each row of pages.

    A null or empty html gives an empty text; a null page_id or url stays null. Other columns are
    dropped; an empty table gives an empty result. Repeated rows give repeated results.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            texts = main_texts(b["html"].to_pylist(), shared.value)
            yield pa.RecordBatch.from_pydict({"page_id": b["page_id"], "url": b["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
