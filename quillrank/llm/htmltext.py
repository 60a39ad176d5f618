"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements whose leaves are runs of inline text.  Each node is content or not.  Node potentials
come from tags, words of class and id, text length and link share; edge potentials tie a node to its parent.  Sum-product
messages, up to the root and down again, give every run its marginal; runs that are rather content than not are the text.
Weights maximise the likelihood of labelled pages, whose expected counts come from the same messages.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_OPEN = re.compile(r"<!--.*|<[!?].*", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")

#: Elements whose text is never shown or never prose.
SILENT = frozenset("script style noscript template iframe svg math canvas object head title textarea select button audio video map datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section div nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure "
    "figcaption address details summary dialog hr center".split())
_P, _NOT_P = frozenset("p"), BLOCK - {"p"}
#: A start tag ends an open element of these, unless one of the others stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
TAG_GROUPS = {
    "root": "html body", "article": "article", "main": "main", "section": "section", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form fieldset",
    "list": "ul ol dl", "item": "li dt dd", "table": "table thead tbody tfoot tr", "cell": "td th caption", "p": "p", "heading": "h1 h2 h3 h4 h5 h6",
    "quote": "blockquote pre", "figure": "figure figcaption", "address": "address", "details": "details summary",
}
#: Words in class, id and role that say what a part is.
NAME_GROUPS = {
    "ad": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion", "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs toolbar pagination pager",
    "side": "sidebar side aside widget rail complementary", "foot": "footer foot copyright legal contentinfo colophon", "head": "header masthead logo branding topbar",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay dialog", "comment": "comment comments reply replies discussion respond disqus",
    "share": "share social sharing follow", "related": "related recommended recommendations more trending popular", "form": "form subscribe subscription newsletter login signup search",
    "content": "content article post entry story main body text prose",
}
_GROUP_OF_TAG = {t: g for g, ts in TAG_GROUPS.items() for t in ts.split()}
_GROUP_OF_NAME = {w: g for g, ws in NAME_GROUPS.items() for w in ws.split()}
LENGTHS, LINKS = (1, 4, 10, 25, 60, 150), (0.05, 0.3, 0.6, 0.95)
FEATURES = {name: i for i, name in enumerate(
    ["bias", "run", "other", *[f"tag:{g}" for g in TAG_GROUPS], *[f"name:{g}" for g in NAME_GROUPS], *[f"length:{i}" for i in range(len(LENGTHS) + 1)], *[f"links:{i}" for i in range(len(LINKS) + 1)],
     "run_stop", *[f"run_length:{i}" for i in range(len(LENGTHS) + 1)], *[f"run_links:{i}" for i in range(len(LINKS) + 1)]])}
#: Kinds of edges by the child: a text run, a part that a tag or a name sets off, any other element, a part named as content.
EDGES = 4
_SET_OFF = {f"tag:{g}" for g in ("nav", "header", "footer", "aside", "form")} | {f"name:{g}" for g in NAME_GROUPS if g != "content"}
_CONTENT = {"tag:article", "tag:main", "name:content"}


@dataclass
class Tree:
    """Nodes in page order.  ``text`` is None for elements; ``label`` is for training only."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    named: list[str] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, named: str, text: str | None, words: int = 0, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.named.append(named)
        self.text.append(text)
        self.words.append(words)
        self.linked.append(linked)
        return len(self.parent) - 1


def parse(page: str) -> Tree:
    """The tree of a page, however badly it is nested.  A run's text is decoded, its white space collapsed."""
    tree = Tree()
    tree.add(-1, "html", "", None)
    open_blocks: list[tuple[str, int]] = [("html", 0)]  # tag, node
    open_tags = Counter()  # of the blocks above
    pieces: list[str] = []
    linked = [0]  # words inside links of the current run
    depth_a = depth_silent = 0
    silent: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        if pieces:
            words = "".join(pieces).split()
            if words:
                tree.add(open_blocks[-1][1], "#", "", " ".join(words), len(words), min(linked[0], len(words)))
            pieces.clear()
        linked[0] = 0

    def say(raw: str) -> None:
        if raw and not silent:
            text = html_lib.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if depth_a:
                linked[0] += len(text.split())

    def close(tags: frozenset[str], stops: frozenset[str]) -> None:
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(open_blocks) - 1, 0, -1):
            if open_blocks[i][0] in tags:
                flush()
                open_tags.subtract(t for t, _ in open_blocks[i:])
                del open_blocks[i:]
                return
            if open_blocks[i][0] in stops:
                return

    last = page.rfind(">")  # behind it no tag ends
    while at < end:
        m = _TOKEN.search(page, at) if at <= last else _OPEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5)) if m.re is _TOKEN else None
        if not name:
            continue
        name, closing, attributes = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if closing:
            if silent:
                if name == silent[-1]:
                    silent.pop()
            elif name == "a":
                depth_a = max(0, depth_a - 1)
            elif name in BLOCK:
                if name == "p":
                    close(_P, _NOT_P)
                elif open_tags[name]:
                    close(frozenset((name,)), frozenset())
                flush()
            continue
        if name in VOID:
            if name == "br":
                say(" ")
            elif name == "hr":
                flush()
            continue
        if attributes.endswith("/") and name not in BLOCK and name != "a":
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if silent or name in SILENT:
            if name == "body":
                silent.clear()
            elif not silent or name == silent[-1]:
                silent.append(name)
                continue
            else:
                continue
        if name == "a":
            depth_a = 1
        elif name in BLOCK and name != "html":
            flush()
            if name != "body":
                close(_P, _NOT_P)
            if name in CLOSES:
                close(*CLOSES[name])
            if name == "body" and open_tags["body"]:
                continue
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower() if "=" in attributes else ""
            open_blocks.append((name, tree.add(open_blocks[-1][1], name, named, None)))
            open_tags[name] += 1
    flush()
    return tree


class Forest:
    """Several trees as arrays, with the features of their nodes."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.page = np.repeat(np.arange(len(trees)), sizes)
        parent = np.concatenate([np.array(t.parent, np.int64) for t in trees]) if trees else np.zeros(0, np.int64)
        self.parent = np.where(parent < 0, -1, parent + np.repeat(starts, sizes))
        n = len(parent)
        self.text = [x for t in trees for x in t.text]
        words = np.array([w for t in trees for w in t.words], np.int64)
        linked = np.array([w for t in trees for w in t.linked], np.int64)
        self.run = np.array([x is not None for x in self.text], bool)
        self.depth = np.zeros(n, np.int64)
        for i in range(n):  # parents come first
            if self.parent[i] >= 0:
                self.depth[i] = self.depth[self.parent[i]] + 1
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max(initial=0)) + 1)] if n < 5000 else self._levels()
        for level in self.levels[:0:-1]:
            np.add.at(words, self.parent[level], words[level])
            np.add.at(linked, self.parent[level], linked[level])
        length = np.searchsorted(LENGTHS, words, "right")
        share = np.searchsorted(LINKS, linked / np.maximum(words, 1), "right")
        stop = np.array([x is not None and x[-1:] in ".!?:\"'”»…)" for x in self.text], bool)
        node, feature = [np.arange(n)], [np.full(n, FEATURES["bias"])]
        set_off, content = np.zeros(n, bool), np.zeros(n, bool)
        names = [x for t in trees for x in t.named]
        tags = [x for t in trees for x in t.tag]
        own: list[tuple[int, int]] = []
        for i in range(n):
            if self.run[i]:
                continue
            key = (tags[i], names[i])
            for f, off, of_content in _own_features(*key):
                own.append((i, f))
                set_off[i] |= off
                content[i] |= of_content
        if own:
            a, b = np.array(own).T
            node.append(a)
            feature.append(b)
        runs, elements = np.flatnonzero(self.run), np.flatnonzero(~self.run)
        for at, f in ((runs, np.full(len(runs), FEATURES["run"])), (runs, FEATURES["run_length:0"] + length[runs]), (runs, FEATURES["run_links:0"] + share[runs]),
                      (runs[stop[runs]], np.full(int(stop[runs].sum()), FEATURES["run_stop"])), (elements, FEATURES["length:0"] + length[elements]), (elements, FEATURES["links:0"] + share[elements])):
            node.append(at)
            feature.append(f)
        self.node, self.feature = np.concatenate(node), np.concatenate(feature)
        self.edge = np.where(self.run, 0, np.where(set_off, 1, np.where(content, 3, 2)))
        self.label = np.array([x for t in trees for x in t.label], np.int64) if trees and trees[0].label else None

    def _levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max()) + 1)))

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the joint (parent, child) distribution of each edge; ``edges`` is kinds x 2 x 2."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = np.bincount(self.node, weights[self.feature], n)
        message, down = np.zeros((n, 2)), np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            m = edges[self.edge[level]] + up[level][:, None, :]
            message[level] = np.logaddexp(m[:, :, 0], m[:, :, 1])
            np.add.at(up, self.parent[level], message[level])
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            cavity = up[p] + down[p] - message[level]
            cavity -= cavity.max(1, keepdims=True)
            m = edges[self.edge[level]] + cavity[:, :, None]
            down[level] = np.logaddexp(m[:, 0, :], m[:, 1, :])
            full = m + up[level][:, None, :]
            full = np.exp(full - full.max((1, 2), keepdims=True))
            joint[level] = full / full.sum((1, 2), keepdims=True)
        total = up + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700))), joint


@lru_cache(maxsize=1 << 16)
def _own_features(tag: str, named: str) -> tuple[tuple[int, bool, bool], ...]:
    group = _GROUP_OF_TAG.get(tag)
    found = [f"tag:{group}" if group else "other"] + sorted({f"name:{_GROUP_OF_NAME[w]}" for w in _PART.findall(named) if w in _GROUP_OF_NAME})
    return tuple((FEATURES[f], f in _SET_OFF, f in _CONTENT) for f in found)


@dataclass(frozen=True)
class HtmlParams:
    """How many labelled pages are made, and how the weights are fitted to them."""

    pages: int = 400
    rounds: int = 300
    rate: float = 1.0
    decay: float = 0.00003
    threshold: float = 0.5
    seed: int = 23


def fit(trees: list[Tree], params: HtmlParams) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge weights by gradient ascent on the likelihood of labelled trees."""
    forest = Forest(trees)
    n, y = len(forest.parent), forest.label
    child = np.flatnonzero(forest.parent >= 0)
    truth = np.bincount(forest.feature, y[forest.node], len(FEATURES))
    edge_truth = np.zeros((EDGES, 2, 2))
    np.add.at(edge_truth, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
    w, e = np.zeros(len(FEATURES)), np.zeros((EDGES, 2, 2))
    sums = [np.full_like(w, 1e-8), np.full_like(e, 1e-8)]
    for _ in range(params.rounds):
        p, joint = forest.marginals(w, e)
        expected = np.bincount(forest.feature, p[forest.node], len(FEATURES))
        edge_expected = np.zeros_like(e)
        np.add.at(edge_expected, forest.edge[child], joint[child])
        for x, g, s in ((w, (truth - expected) / n - params.decay * w, sums[0]), (e, (edge_truth - edge_expected) / n - params.decay * e, sums[1])):
            s += g * g
            x += params.rate * g / np.sqrt(s)
    return w, e


# Labelled pages: templates written for this, filled with made-up words.  "\x01" and "\x02" enclose what is content.

_SYLLABLES = "ba co di fu ge ha ji ko lu me na po ri sa te vo wi ya zu".split()


def _say(rng: random.Random, low: int, high: int, stop: bool = True) -> str:
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(low, high + 1))]
    if len(words) > 8:
        for i in range(5, len(words), rng.randrange(6, 14)):
            words[i] += rng.choice([",", ".", ""])
    return (" ".join(words).capitalize() + ("." if stop else "")).replace("ba", rng.choice(["ba", "ba", "&amp;", "bä"]), 1)


def _links(rng: random.Random, low: int = 3, high: int = 9) -> list[str]:
    return [f'<a href="/{i}">{_say(rng, 1, 4, False)}</a>' for i in range(rng.randrange(low, high + 1))]


def _furniture(rng: random.Random, kind: str) -> str:
    items = "".join(f"<li>{x}</li>" for x in _links(rng))
    short, long = _say(rng, 2, 8), _say(rng, 6, 40)
    pick = rng.choice
    if kind == "menu":
        return pick([f"<nav><ul>{items}</ul></nav>", f"<div class='{pick(['menu', 'navbar', 'breadcrumbs'])}'><ul>{items}</ul></div>", f"<ul>{items}</ul>", f"<div id=nav>{' | '.join(_links(rng))}</div>"])
    if kind == "header":
        return pick([f"<header><div class=logo>{short}</div></header>", f"<div id='header'><a href='/'>{short}</a><p>{long}</p></div>", f"<header><h1>{short}</h1><p>{long}</p></header>"])
    if kind == "ad":
        return pick([f"<div class='{pick(['ad', 'ads', 'banner', 'sponsored', 'promo box'])}'>{pick([short, long])}</div>", f"<aside class=advert><p>{long}</p></aside>", f"<div id='ad-{rng.randrange(9)}'><a href='#'>{long}</a></div>", f"<section class='sponsor'><p>{long}</p></section>"])
    if kind == "notice":
        return pick([f"<div class='{pick(['cookie-consent', 'notice', 'popup modal'])}'><p>{long}</p><button>ok</button></div>", f"<div role='dialog' id=cookies>{long}</div>", f"<dialog><p>{long}</p></dialog>"])
    if kind == "side":
        return pick([f"<aside><h3>{short}</h3><ul>{items}</ul></aside>", f"<div class='{pick(['sidebar', 'widget', 'right-rail'])}'><h3>{short}</h3><p>{long}</p><ul>{items}</ul></div>", f"<aside><p>{long}</p><p>{long}</p></aside>"])
    if kind == "related":
        return pick([f"<div class='{pick(['related', 'more-stories', 'trending'])}'><h3>{short}</h3><ul>{items}</ul></div>", f"<section class=recommended>{items}</section>"])
    if kind == "share":
        return f"<div class='{pick(['share', 'social-links'])}'>{' '.join(_links(rng, 2, 4))}</div>"
    if kind == "form":
        return pick([f"<form action='/s'><label>{short}</label><input name=q><p>{long}</p></form>", f"<div class='newsletter'><p>{long}</p><form><input></form></div>", f"<form class=login><fieldset><p>{short}</p></fieldset></form>"])
    if kind == "comments":
        one = "".join(f"<div class=comment><p class=author>{_say(rng, 1, 2, False)}</p><p>{_say(rng, 4, 50)}</p></div>" for _ in range(rng.randrange(1, 5)))
        other = "".join(f"<li><p>{_say(rng, 4, 50)}</p></li>" for _ in range(rng.randrange(1, 5)))
        return pick([f"<section id='comments'><h2>{short}</h2>{one}</section>", f"<div class='comments-area'><ol>{other}</ol></div>", f"<ul class='replies'>{other}</ul>"])
    return pick([f"<footer>&copy; {short} &middot; {long}</footer>", f"<div id='footer'><p>{long}</p><ul>{items}</ul></div>", f"<footer><p>{short}</p></footer>", f"<div class='copyright'>{long}</div>"])


def _article(rng: random.Random) -> str:
    pick = rng.choice
    most = pick([8, 30, 70, 70])  # some articles are short all through
    parts = [f"<h{rng.randrange(1, 3)}>{_say(rng, 2, 12, rng.random() < 0.4)}</h1>" if rng.random() < 0.85 else ""]
    for _ in range(rng.randrange(1, pick([3, 12]))):
        roll = rng.random()
        if roll < 0.72:
            parts.append(f"<p>{_say(rng, pick([1, 4, min(12, most)]), most)}" + pick(["</p>", "</p>", ""]))
        elif roll < 0.78:
            parts.append(f"<h{rng.randrange(2, 4)}>{_say(rng, 1, 7, False)}</h2>")
        elif roll < 0.84:
            parts.append("<ul>" + "".join(f"<li>{_say(rng, 2, 20, rng.random() < 0.5)}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>")
        elif roll < 0.88:
            parts.append(f"<blockquote><p>{_say(rng, 6, 40)}</p></blockquote>")
        elif roll < 0.91:
            parts.append(f"<p><b>{_say(rng, 3, most)}<br><p>{_say(rng, 3, most)}</p>")
        elif roll < 0.94:
            parts.append("<table>" + "".join(f"<tr><td>{_say(rng, 1, 5, False)}</td><td>{_say(rng, 1, 5, False)}</td></tr>" for _ in range(rng.randrange(1, 4))) + "</table>")
        elif roll < 0.96:
            parts.append(f"<p>{_say(rng, 3, 20)} <a href='#'>{_say(rng, 1, 4, False)}</a> {_say(rng, 3, 30)}</p>")
        elif roll < 0.98:
            parts.append(f"<figure><img src=x><figcaption>{_say(rng, 3, 15)}</figcaption></figure>")
        else:
            parts.append(f"\x02{_furniture(rng, pick(['ad', 'related', 'share', 'form', 'notice']))}\x01")
    return "".join(parts)


def labelled_page(rng: random.Random) -> str:
    body = _article(rng)
    pick = rng.choice
    around = pick(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='main-content'>{}</div>", "<div class='post-body entry'>{}</div>", "<section>{}</section>",
                   "<div>{}</div>", "<main><article>{}</article></main>", "<div class=wrapper><div class=story>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "{}"])
    before = [_furniture(rng, k) for k in ("header", "menu", "notice", "ad", "form") if rng.random() < 0.5]
    after = [_furniture(rng, k) for k in ("share", "related", "comments", "ad", "side", "form") if rng.random() < 0.35]
    if rng.random() < 0.3:
        before.append(_furniture(rng, "side"))
    inner = "".join(before) + around.replace("{}", f"\x01{body}\x02") + "".join(after)
    if rng.random() < 0.3:
        inner = f"<div class='{pick(['page', 'wrap', 'container'])}'>{inner}</div>"
    end = _furniture(rng, "footer") if rng.random() < 0.8 else ""
    return f"<!DOCTYPE html><html><head><title>{_say(rng, 2, 6)}</title><style>p{{}}</style></head><body>{inner}{end}" + pick(["</body></html>", ""])


def labelled_tree(page: str) -> Tree:
    """The tree of a labelled page.  Content are the runs between the marks, the innermost element that holds them all with
    the wrappers that hold nothing else, and what below it holds some of them."""
    tree = parse(page.replace("\x01", "<hr>\x01<hr>").replace("\x02", "<hr>\x02<hr>"))
    inside, out, number, held = False, Tree(), {}, []
    for i, text in enumerate(tree.text):
        if text in ("\x01", "\x02"):
            inside = text == "\x01"
            continue
        p = tree.parent[i]
        number[i] = out.add(-1 if p < 0 else number[p], tree.tag[i], tree.named[i], text, tree.words[i], tree.linked[i])
        held.append(int(inside and text is not None))
    total = sum(held)
    out.label = list(held)
    runs = [int(x is not None) for x in out.text]
    for i in range(len(held) - 1, 0, -1):
        held[out.parent[i]] += held[i]
        runs[out.parent[i]] += runs[i]
    top = max((i for i in range(len(held)) if held[i] == total and out.text[i] is None), default=0) if total else -1
    while top > 0 and runs[out.parent[top]] == runs[top]:  # wrappers of nothing else
        top = out.parent[top]
    below = [False] * len(held)
    for i in range(len(held)):
        below[i] = i == top or (i > 0 and below[out.parent[i]])
        if out.text[i] is None:
            out.label[i] = int(below[i] and held[i] > 0)
    return out


@lru_cache(maxsize=2)
def trained(params: HtmlParams = HtmlParams()) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(params.seed)
    return fit([labelled_tree(labelled_page(rng)) for _ in range(params.pages)], params)


def main_texts(pages: list[str | None], model: tuple[np.ndarray, np.ndarray], threshold: float = 0.5) -> list[str]:
    """The main text of each page: its content runs in order, two line ends between them."""
    forest = Forest([parse(p or "") for p in pages])
    p, _ = forest.marginals(*model)
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(forest.run & (p >= threshold)):
        out[forest.page[i]].append(forest.text[i])
    return ["\n\n".join(x) for x in out]


def extract_main_text(pages: DataFrame, params: HtmlParams = HtmlParams(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row.

    A null or empty page has an empty text.  Rows are taken one by one, whole, so repeated rows and null ids stay.  White
    space is what Unicode says it is.  An empty table gives no rows.
    """
    model = trained(params)
    step = 1 << 20  # characters of pages whose trees are held at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_, at = batch.column(2).to_pylist(), 0
            texts: list[str] = []
            while at < len(pages_):
                to, size = at, 0
                while to < len(pages_) and (to == at or size < step):
                    size += len(pages_[to] or "")
                    to += 1
                texts += main_texts(pages_[at:to], model, params.threshold)
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
