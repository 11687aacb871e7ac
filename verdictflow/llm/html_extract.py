"""Main-text extraction by a tree-structured graphical model over the DOM.

A page becomes a tree of its block elements, with a leaf for each run of text inside a block. Each
node has one of three states: mixed (holds both), content, boilerplate. Parent-child potentials (by the
child's tag) and naive Bayes node potentials (words of class, id and role; what a block's whole inside is like: its
share of the page's text, of links, the length of its runs, form controls, whether it lies on the way from the page to
its largest part; text statistics of leaves) are learned by
counting on labelled pages; sum-product messages, once upward and once downward, give each leaf its exact
content marginal. Leaves above one half are the main text. All pages of an Arrow batch are solved
together, level by level.

The labelled pages come from labelled_pages(), which lays out pages in many styles, tables, blocks with meaningless
names and articles directly in the body among them, and marks each part as content or boilerplate; no page of the input is labelled, and
none is learned from.

Defined results: null html is an empty page with empty text; character references are decoded; white
space inside a block becomes one space; br is white space; blocks are joined by one line break in
page order; unclosed and misnested tags are closed as browsers do for p, li, dt, dd, tr, td, th and
option; a formula is text of its paragraph, a drawing is skipped without ending it; what is hidden (by the hidden
attribute or an inline style), buttons, selections and noscript are never read, since no reader of the page sees them
as its text;
null ids and repeated rows are kept; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIXED, CONTENT, BOILER = 0, 1, 2
TRAIN_PAGES = 1000
#: Text statistics of neighbours depend on each other, and so do those of a block, so they count for less.
LEAF_WEIGHT, BLOCK_WEIGHT, WAY_WEIGHT = 0.5, 0.25, 0.6
#: Words of class, id and role that fewer labelled blocks have say nothing.
LEAST_SEEN = 4
LEAST_RUNS = 2
GROUP_CHARS = 4 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_DRAWING = re.compile(r"<(/?)svg(?=[\s/>])[^>]*+>", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden|style|data-label)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Raw elements and embedded documents never hold readable blocks.
UNREAD = frozenset("script style textarea title iframe noembed noframes noscript xmp template head datalist object canvas audio video button select dialog".split())
CONTROLS = frozenset("input textarea button select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A formula is text of its paragraph; what only describes it to programs is not read.
FORMULA = frozenset("math merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
DESCRIBES = frozenset(("annotation", "annotation-xml"))
#: An opening tag closes these if they are open above the nearest barrier.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "optgroup": {"option", "optgroup"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "optgroup": {"select"}}


@dataclass
class Tree:
    """Nodes in page order: parent index, features; leaves also have text. label is for training pages."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    feature: list[tuple] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)

    def add(self, parent: int, feature: tuple, text: str | None, label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.feature.append(feature)
        self.text.append(text)
        self.label.append(label)
        self.linked.append(0)
        self.controls.append(0)
        return len(self.parent) - 1

    def measure(self) -> None:
        """Add to each block's feature what its inside is like; children stand behind their parents.

        Blocks of fewer than LEAST_RUNS runs of text get nothing: their leaves say it all, and a hundred short
        paragraphs must not outweigh the article around them.
        """
        chars = [len(t) if t else 0 for t in self.text]
        runs = [int(t is not None) for t in self.text]
        linked, controls = list(self.linked), list(self.controls)
        for i in range(len(chars) - 1, 0, -1):
            up = self.parent[i]
            for sums in (chars, runs, linked, controls):
                sums[up] += sums[i]
        total = max(1, chars[0])
        largest: dict[int, int] = {}  # of each block, the child with the most text
        for i in range(1, len(chars)):
            if self.text[i] is None and chars[i] > chars[largest.get(self.parent[i], i)] - (self.parent[i] not in largest):
                largest[self.parent[i]] = i
        on_way = [True] * len(chars)  # from the page to its largest part
        for i in range(1, len(chars)):
            on_way[i] = on_way[self.parent[i]] and largest.get(self.parent[i]) == i
        for i, text in enumerate(self.text):
            if text is None and runs[i] < LEAST_RUNS:
                self.feature[i] = (*self.feature[i], ())
            elif text is None:
                share, links, run = chars[i] / total, linked[i] / max(1, chars[i]), chars[i] / max(1, runs[i])
                inside = (_step(share, (0.001, 0.03, 0.1, 0.25, 0.5, 0.8)), _step(links, (0.01, 0.15, 0.5, 0.9)), _step(run, (1, 15, 40, 90, 200)), _step(runs[i], (1, 2, 3, 6, 12)), controls[i] > 0, on_way[i])
                self.feature[i] = (*self.feature[i], inside)


def _step(value: float, bounds: tuple) -> int:
    return sum(value >= b for b in bounds)


def _attributes(raw: str) -> tuple[tuple[str, ...], str | None, bool]:
    """Words of class, id and role, the label of a training page, and whether the element is hidden."""
    if "=" not in raw and "hidden" not in raw.lower():
        return (), None, False
    words, label, hidden = set(), None, False
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-label":
            label = value
        elif name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= _UNSEEN.search(value) is not None
        else:
            words.update(w.lower() for w in _WORD.findall(unescape(value)))
    return tuple(sorted(words)), label, hidden


def _leaf_feature(text: str, linked: int) -> tuple:
    n = text.count(" ") + 1
    size = 0 if n <= 2 else 1 if n <= 6 else 2 if n <= 15 else 3 if n <= 40 else 4
    share = linked / max(1, len(text))
    return ("leaf", size, 0 if share == 0 else 1 if share < 0.5 else 2, text[-1] in ".!?…", "©" in text)


def _after_drawing(html: str, at: int) -> int:
    """The place behind the drawing that has been opened before `at`; drawings may hold others."""
    depth = 1
    for m in _DRAWING.finditer(html, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return len(html)


def parse_html(html: str | None) -> Tree:
    """The block tree of a page. Cost is linear in its length."""
    tree = Tree()
    html = html or ""
    root = tree.add(-1, ("html", ()), None, MIXED)
    stack: list[tuple[str, int, bool]] = [("html", root, False)]
    opened: Counter = Counter()
    pieces: list[str] = []
    linked = links = unread = 0
    veil: list[str] = []  # open inline elements of one name, the first of which is hidden

    def lift() -> None:
        nonlocal unread
        if veil:
            unread -= 1
            veil.clear()

    def flush() -> None:
        nonlocal linked
        lift()
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                at = stack[-1][1]
                leaf = tree.add(at, _leaf_feature(text, linked), text, CONTENT if tree.label[at] == CONTENT else BOILER)
                tree.linked[leaf] = linked
            pieces.clear()
        linked = 0

    def pop() -> str:
        nonlocal unread, links
        name, _, unseen = stack.pop()
        opened[name] -= 1
        unread -= unseen
        links = 0
        return name

    def close(name: str) -> None:
        if opened[name] > 0:
            flush()
            while pop() != name:
                pass

    def say(raw: str) -> None:
        nonlocal linked
        if not unread:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text.strip())

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        end, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "svg":  # a drawing is no text, and does not end its paragraph
            if not end and not (raw or "").endswith("/"):
                at = _after_drawing(html, at)
            continue
        if name in INLINE or name in FORMULA or name in DESCRIBES:
            if name == "br":
                say(" ")
            elif name == "a":
                links = 0 if end else 1
            if veil:
                if end and name == veil[0]:
                    veil.pop()
                    unread -= not veil
                elif not end and name == veil[0] and name not in VOID:
                    veil.append(name)
            elif not end and name not in VOID and (name in DESCRIBES or (raw and _attributes(raw)[2])):
                veil.append(name)
                unread += 1
            continue
        if end:
            close(name)
            continue
        if name in ("html", "body") and name in opened:
            continue
        flush()
        if name in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in BARRIER[name]:
                    break
                if stack[i][0] in CLOSES[name]:
                    while len(stack) > i:
                        pop()
                    break
        elif opened["p"] > 0 and name not in ("object", "option", "optgroup"):
            close("p")
        if name == "body" and opened["head"] > 0:
            close("head")
        words, label, hidden = _attributes(raw) if raw else ((), None, False)
        up = stack[-1][1]
        tree.controls[up] += name in CONTROLS
        state = {"content": CONTENT, "boiler": BOILER, "mixed": MIXED}.get(label, tree.label[up])
        if name in VOID:
            continue
        if name in RAW:
            tail = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
            at = tail.end() if tail else n
            continue
        node = tree.add(up, (name, words), None, state)
        unseen = hidden or name in UNREAD
        stack.append((name, node, unseen))
        opened[name] += 1
        unread += unseen
        links = 0
    flush()
    tree.measure()
    return tree


class DomModel:
    """Log potentials of the tree model, learned by counting.

    The parent-child potential is that of the child's state given its parent's, for the child's tag,
    smoothed by that of all tags. Words of class, id and role, and text statistics, are naive Bayes.
    """

    def __init__(self, trees: list[Tree]):
        every, edge = np.ones((3, 3)), defaultdict(lambda: np.zeros((3, 3)))
        word, leaf = defaultdict(lambda: np.full(3, 0.5)), [defaultdict(lambda: np.ones(3)) for _ in range(4)]
        leaves, named, blocks = np.zeros(3), np.zeros(3), np.zeros(3)
        inside = [defaultdict(lambda: np.ones(3)) for _ in range(6)]
        for t in trees:
            for up, f, state in zip(t.parent, t.feature, t.label):
                if up >= 0:
                    edge[f[0]][t.label[up], state] += 1
                if f[0] == "leaf":
                    leaves[state] += 1
                    for k, x in enumerate(f[1:]):
                        leaf[k][x][state] += 1
                else:
                    every[t.label[up], state] += up >= 0
                    named[state] += bool(f[1])
                    blocks[state] += 1
                    for k, x in enumerate(f[2]):
                        inside[k][x][state] += 1
                    for w in f[1]:
                        word[w][state] += 1
        every /= every.sum(axis=1, keepdims=True)
        self.edge = {k: np.log((v + 2 * every) / (v + 2 * every).sum(axis=1, keepdims=True)) for k, v in edge.items() if k != "leaf"}
        self.other = np.log(every)
        own = edge["leaf"] + 1
        own[:, MIXED] = 1e-9  # a leaf is one thing or the other
        self.edge["leaf"] = np.log(own / own.sum(axis=1, keepdims=True))
        self.word = {k: np.log(v / (named + 20)) for k, v in word.items() if v.sum() - 1.5 >= LEAST_SEEN}
        self.inside = [{k: np.log(v / (blocks + 8)) for k, v in d.items()} for d in inside]
        self.leaf = [{k: np.log(v / (leaves + 5)) for k, v in d.items()} for d in leaf]
        self.cache: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def node(self, feature: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Log potential of a node, and that with its parent; words that training pages lack say nothing."""
        out = self.cache.get(feature)
        if out is None:
            if feature[0] == "leaf":
                own = sum(d.get(x, np.zeros(3)) for d, x in zip(self.leaf, feature[1:])) * LEAF_WEIGHT
            else:
                own = sum((self.word[w] for w in feature[1] if w in self.word), np.zeros(3))
                own = own + sum(d.get(x, np.zeros(3)) * w for d, x, w in zip(self.inside, feature[2], [BLOCK_WEIGHT] * 5 + [WAY_WEIGHT]))
            out = own, self.edge.get(feature[0], self.other)
            if len(self.cache) < 100_000:
                self.cache[feature] = out
        return out

    def content(self, trees: list[Tree]) -> list[np.ndarray]:
        """The content marginal of every node of each tree, by sum-product upward and downward."""
        sizes = [len(t.parent) for t in trees]
        start = np.cumsum([0, *sizes])
        total = int(start[-1])
        up = np.concatenate([np.array(t.parent) + s for t, s in zip(trees, start)])
        depth = np.concatenate([t.depth for t in trees])
        nodes = [self.node(f) for t in trees for f in t.feature]
        inner, edge = np.array([x[0] for x in nodes]), np.array([x[1] for x in nodes])
        message, outer = np.zeros((total, 3)), np.zeros((total, 3))
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        for at in reversed(levels[1:]):
            message[at] = np.logaddexp.reduce(edge[at] + inner[at][:, None, :], axis=2)
            np.add.at(inner, up[at], message[at])
        outer[levels[0]] = np.log([0.98, 0.01, 0.01])
        for at in levels[1:]:
            rest = outer[up[at]] + inner[up[at]] - message[at]
            outer[at] = np.logaddexp.reduce(edge[at] + rest[:, :, None], axis=1)
        joint = inner + outer
        p = np.exp(joint[:, CONTENT] - np.logaddexp.reduce(joint, axis=1))
        return [p[a:b] for a, b in zip(start, start[1:])]

    def extract(self, pages: list[str | None]) -> list[str]:
        """Main texts, a few MB of pages at a time."""
        out: list[str] = []
        group: list[Tree] = []
        held = 0

        def solve() -> None:
            for t, p in zip(group, self.content(group) if group else ()):
                out.append("\n".join(x for x, c in zip(t.text, p) if x is not None and c > 0.5))
            group.clear()

        for html in pages:
            group.append(parse_html(html))
            held += len(html or "")
            if held > GROUP_CHARS:
                solve()
                held = 0
        solve()
        return out


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 7) -> Iterator[str]:
    """Pages in many layouts, whose elements carry their label in data-label."""
    r = random.Random(seed)
    meaningless = 0.0  # the share of blocks of a page whose names say nothing
    syllables = [a + b for a in "bdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def prose(low: int = 1, high: int = 90) -> str:
        return (words(low, high).capitalize() + r.choice([".", ".", ".", "?", "", "!"])).replace(" ", r.choice([" ", " ", ", "]), 1)

    def link(text: str) -> str:
        return f'<a href="/{words(1, 1)}">{text}</a>'

    def menu() -> str:
        return "<ul>" + "".join(f"<li>{link(words(1, 3))}</li>" for _ in range(r.randint(2, 9))) + "</ul>"

    def named(tag: str, names: list[str], label: str, body: str, chance: float = 0.8) -> str:
        if r.random() < chance:
            value = words(1, 1) if r.random() < meaningless else r.choice(names)
            if r.random() < 0.3:
                value = r.choice(["site-", "main-", "page-", "block-", "js-", ""]) + value
            attribute = f' {r.choice(["class", "class", "id"])}="{value}"'
        else:
            attribute = ""
        return f'<{tag}{attribute} data-label="{label}">{body}</{tag}>'

    def block(tags: list[str], names: list[str], body: str, generic: float = 0.5) -> str:
        """A boilerplate part: a telling tag, or a div or section with a telling name."""
        if tags and r.random() > generic:
            return named(r.choice(tags), names, "boiler", body, 0.5)
        return named(r.choice(["div", "div", "section", "aside"]), names, "boiler", body, 1.0)

    def paragraphs(n: int) -> str:
        return "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "<p><b>{}</b></p>"] if r.random() < 0.2 else ["<p>{}</p>"]).format(prose(1, 12) if r.random() < 0.4 else prose()) for _ in range(n))

    def ad() -> str:
        return block([], ["ad", "ads", "werbung", "anzeige", "publicite", "publicidad", "advert", "advertisement", "ad-slot", "sponsor", "sponsored", "promo", "promotion", "banner", "adsbygoogle", "ad-banner"], r.choice([prose(3, 25), f"<p>{prose(2, 25)}</p>", link(words(1, 5))]))

    def notice() -> str:
        return block([], ["notice", "hinweis", "avis", "aviso", "cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "notification", "paywall", "popup", "modal", "overlay", "disclaimer", "warning", "message"], r.choice([prose(4, 30), f"<p>{prose(3, 30)}</p><button>{words(1, 2)}</button>"]))

    def form() -> str:
        body = f"<label>{words(1, 3)}</label><input type=text><button>{words(1, 2)}</button>"
        body = r.choice([body, f"<p>{prose(3, 20)}</p>" + body, f"<fieldset><legend>{words(1, 3)}</legend>{body}<select><option>{words(1, 2)}<option>{words(1, 2)}</select></fieldset>"])
        return block(["form"], ["newsletter", "subscribe", "subscription", "signup", "login", "search", "search-form", "contact-form", "form", "poll"], body, 0.25)

    def comments() -> str:
        one = lambda: r.choice([named("div", ["comment", "comment-body", "reply", "comment-item"], "boiler", f"<span>{words(1, 2)}</span><p>{prose(2, 60)}</p>"), named("article", ["comment", "comment-item", "reply"], "boiler", f"<h4>{words(1, 3)}</h4><p>{prose(2, 60)}</p>", 1.0), f"<li>{prose(2, 40)}</li>"])
        body = f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 6)))
        return block([], ["comments", "kommentare", "commentaires", "comentarios", "comment-list", "commentlist", "disqus", "disqus-thread", "respond", "replies", "discussion", "user-comments", "reader-comments", "responses"], body)

    def side() -> str:
        body = "".join(r.choice([menu(), f"<h3>{words(1, 4)}</h3><p>{prose(3, 40)}</p>", f"<p>{prose(2, 30)}</p>", ad()]) for _ in range(r.randint(1, 4)))
        return block(["aside"], ["sidebar", "seitenleiste", "barre-laterale", "barra-lateral", "side", "widget", "related", "rail", "right-column", "recommended", "popular", "trending", "more-stories", "secondary", "complementary"], body)

    def small() -> str:
        names = ["postmetadata", "metadata", "share", "social", "breadcrumb", "breadcrumbs", "pagination", "tags", "meta", "byline", "toolbar", "skip", "share-buttons", "author-box", "related-links"]
        return block(["nav"], names, r.choice([menu(), words(1, 6), link(words(1, 3))]), 0.7)

    def top() -> str:
        body = r.choice([link(words(1, 2)), f"<h1>{words(1, 4)}</h1>", f"<h1>{words(1, 3)}</h1><p>{prose(2, 9)}</p>", f"<h2>{words(1, 4)}</h2>", f"<p>{prose(1, 8)}</p>", menu(), f"<div>{words(1, 4)}</div>", words(1, 4)])
        return block(["header"], ["header", "kopf", "entete", "cabecera", "masthead", "topbar", "branding", "logo", "site-header", "banner"], body, 0.3)

    def nav() -> str:
        return block(["nav"], ["nav", "navbar", "menu", "navigation", "main-menu", "topnav"], r.choice([menu(), "".join(link(words(1, 2)) for _ in range(5))]))

    def foot() -> str:
        return block(["footer"], ["footer", "fuss", "pied", "pie", "foot", "colophon", "copyright", "site-footer", "bottom", "legal"], r.choice([f"&copy; {words(1, 3)} &middot; {prose(2, 25)}", f"<p>{prose(2, 20)}</p>", menu(), f"<p>&copy; {words(1, 4)}</p>"]))

    def body_parts() -> str:
        parts = [paragraphs(1)]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 8])):
            parts.append(r.choice([lambda: paragraphs(r.randint(1, 3))] * 5 + [lambda: f"<h2>{words(1, 7)}</h2>", lambda: f"<ul>{''.join(f'<li>{prose(1, 15)}</li>' for _ in range(r.randint(1, 5)))}</ul>", lambda: f"<blockquote>{prose(3, 30)}</blockquote>", lambda: f"<blockquote><p>{prose(3, 30)}</p></blockquote>", lambda: f"<table><tr><th>{words(1, 2)}<td>{words(1, 3)}</table>", lambda: "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{prose(1, 9)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>", lambda: f"<pre>{words(2, 20)}</pre>", lambda: f"<figure><img src=x><figcaption>{prose(2, 12)}</figcaption></figure>", lambda: f"<dl><dt>{words(1, 3)}<dd>{prose(2, 15)}</dl>", lambda: f"<section>{paragraphs(2)}</section>", lambda: f"<p>{prose(2, 20)} {link(words(1, 4))} {prose(1, 20)}</p>", lambda: f"<ol><li>{prose(1, 15)}<li>{link(words(1, 6))}</ol>", lambda: f"<ul>{''.join(f'<li>{link(words(1, 5))}</li>' for _ in range(r.randint(1, 4)))}</ul>", lambda: f"<ul>{''.join(f'<li>{words(1, 3)}</li>' for _ in range(r.randint(2, 6)))}</ul>"])())
        return "".join(parts)

    def in_body(parts: str) -> str:
        """The parts of an article without anything around them: each is content by itself."""
        out, at = [], 0
        for m in re.finditer(r"<(/?)(\w+)([^>]*)>", parts):
            if m.start() < at:
                continue
            at = m.end()
            if not m[1] and m[2] not in VOID:
                depth = 1
                for x in re.finditer(rf"<(/?){m[2]}(?=[ >])", parts[at:]):
                    depth += -1 if x[1] else 1
                    if not depth:
                        break
                end = at + x.end() + 1
                label = "" if "data-label" in m[3] else ' data-label="content"'
                out.append(f"<{m[2]}{m[3]}{label}>{parts[at:end]}")
                at = end
        return "".join(out)

    def tabled(main: str) -> str:
        """The article in a cell of a layout table, between rows and cells of other parts."""
        cell = lambda part: f'<td data-label="boiler">{part()}</td>'
        rows = [f'<td data-label="content">{main}</td>']
        rows += [cell(r.choice([side, ad, menu]))] * (r.random() < 0.5)
        rows = [cell(r.choice([menu, nav, side]))] * (r.random() < 0.6) + rows
        line = lambda cells: f'<tr data-label="mixed">{cells}</tr>'
        out = line("".join(rows))
        if r.random() < 0.5:
            out = f'<tr data-label="boiler"><td>{top()}</td></tr>' + out
        if r.random() < 0.5:
            out += f'<tr data-label="boiler"><td>{foot()}</td></tr>'
        return f'<table data-label="mixed">{out}</table>'

    for _ in range(n):
        meaningless = 0.5 if r.random() < 0.35 else 0.05
        inside = [body_parts()]
        if r.random() < 0.8:
            inside.insert(0, f"<h1>{words(2, 12)}</h1>")
        for part, chance in ((ad, 0.25), (notice, 0.12), (form, 0.12), (side, 0.12), (small, 0.3), (comments, 0.2), (foot, 0.08), (nav, 0.05)):
            if r.random() < chance:
                inside.insert(r.randint(0 if part is small else 1, len(inside)), part())
        kind = r.uniform(0, 1.25)
        names = ["article", "artikel", "inhalt", "contenu", "contenido", "articulo", "beitrag", "post", "content", "entry", "entry-content", "article-body", "story", "main-content", "post-body", "text", "body-text", "main"]
        if kind < 0.45:
            main = named("article", names, "content", "".join(inside), 0.3)
        elif kind < 0.6:
            main = named("main", names, "content", "".join(inside), 0.5)
        elif kind < 0.85:
            main = named(r.choice(["div", "section"]), names, "content", "".join(inside), 1.0)
        elif kind < 1.0:
            main = tabled("".join(inside))
        else:
            main = in_body("".join(inside))
        if r.random() < 0.35 and kind < 1.0:
            main = named(r.choice(["main", "div", "section"]), ["wrapper", "container", "page", "site", "layout", "row", "columns", "grid"], "mixed", main + "".join(part() for part in (side, comments, ad, form, small) if r.random() < 0.3), 0.8)
        before = [part() for part, chance in ((notice, 0.2), (top, 0.5), (nav, 0.85), (small, 0.2), (ad, 0.5), (form, 0.15)) if r.random() < chance]
        after = [part() for part, chance in ((comments, 0.25), (side, 0.35), (ad, 0.2), (form, 0.2), (notice, 0.1), (foot, 0.85)) if r.random() < chance]
        yield f'<!DOCTYPE html><html data-label="mixed"><head data-label="boiler"><title>{words(1, 5)}</title><style>p{{}}</style></head><body data-label="mixed">{"".join(before)}{main}{"".join(after)}</body></html>'


def train(pages: int = TRAIN_PAGES, seed: int = 7) -> DomModel:
    return DomModel([parse_html(p) for p in labelled_pages(pages, seed)])


def extract_text(pages: DataFrame, model: DomModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars."""
    model = model or train()

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.extract(b.tolist()), dtype=object)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(html_col).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
