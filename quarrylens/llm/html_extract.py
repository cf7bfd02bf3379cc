"""Main text of web pages by a tree-structured graphical model over the blocks of the DOM.

Every block element is a variable, content or not. A node's own potential is log-linear in features of its tag,
attributes, text and links; potentials between parent and child, by the child's kind, carry agreement. Sum-product
messages upward and downward give exact marginals. Weights are learnt by gradient ascent on the likelihood of
labelled pages, which are generated here in many layouts; pages of a batch are worked level by level together.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Possessive throughout, so a tag that is never closed costs its length once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^<>]*+>?", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their own end tag.
RAW = frozenset("script style textarea title iframe".split())
#: Parts of forms: their text is never content, also outside a form.
CONTROLS = frozenset("select datalist optgroup option button".split())
#: Elements that end with their parent, whose own end tag ends all that is open inside, and that keep p and li outside open.
SCOPES = frozenset("select datalist button object math svg noscript template".split())
BLOCKS = frozenset("html body div section article main nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption details summary address center dialog menu head hr".split())
#: Elements that are variables of their own.
NODES = BLOCKS | {"noscript", "template"}
CLOSES_P = BLOCKS - {"head", "html", "body"}
SIBLING_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select", "datalist"})}
TAGS = ("html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "fieldset", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "details", "dialog", "address", "head")
NAMES = (
    r"(?:^|[-_ ])(?:article|post|entry|story|content|text|prose|body|main|page|blog)(?:$|[-_ ])|(?:article|post|entry|story|main)[-_]?(?:body|content|text)|content",
    r"nav|menu|breadcrumb|pagination|pager|toc",
    r"(?:^|[-_ ])ads?(?:$|[-_ ])|advert|sponsor|promo|banner|adsbygoogle|outbrain|taboola",
    r"side-?bar|related|widget|recommend|trending|popular|(?:^|[-_ ])more(?:$|[-_ ])|teaser",
    r"foot|copyright|legal|imprint",
    r"header|masthead|topbar|logo|brand|hero-nav",
    r"comment|repl(?:y|ies)|disqus|respond|discussion|reactions",
    r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|paywall|disclaimer|toast|warning",
    r"newsletter|subscribe|signup|login|search|form",
    r"share|social|follow|tags?(?:$|[-_ ])|meta|byline|author-bio",
)
_NAMES = tuple(re.compile(p, re.I) for p in NAMES)
_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "main", "article", "alert", "dialog", "form")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary".split())
_MARKED = frozenset("nav header footer aside form fieldset dialog".split())


class Page:
    """Block nodes in order (parents first) with features, and runs of inline text by node."""

    def __init__(self, source: str | None):
        self.parent, self.tag, self.attrs, self.depth = [-1], ["html"], [""], [0]
        self.own, self.linked, self.marks = [0], [0], [0]
        self.runs: list[tuple[int, str]] = []
        self._parse(source or "")

    def _parse(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # every open element and the block it belongs to
        places: dict[str, list[int]] = defaultdict(list, html=[0])  # where in the stack elements of a name are
        bounds, nodes = [0], [0]  # where in the stack nodes and scopes are, and nodes alone
        run: list[str] = []
        links, controls, at = 0, 0, 0

        def flush() -> None:
            text = " ".join("".join(run).split())
            if text:
                node = stack[-1][1]
                self.runs.append((node, text))
                self.own[node] += len(text)
                self.marks[node] += sum(text.count(c) for c in ".,;:!?")
            run.clear()

        def push(name: str, node: int) -> None:
            places[name].append(len(stack))
            if name in NODES or name in SCOPES:
                bounds.append(len(stack))
            if name in NODES:
                nodes.append(len(stack))
            stack.append((name, node))

        def renamed(k: int) -> None:
            at = places[stack[k][0]]
            if at[-1] == k:
                at.pop()
            else:
                at.remove(k)
            stack[k] = ("", stack[k][1])

        def last(names: Iterable[str]) -> int:
            return max((places[n][-1] for n in names if places[n]), default=-1)

        def pop_to(k: int) -> None:
            nonlocal links, controls
            if nodes[-1] >= k:
                flush()
            for t, _ in stack[k:]:
                links -= t == "a"
                controls -= t in CONTROLS
                if t:
                    places[t].pop()
            for held in (bounds, nodes):
                while held[-1] >= k:
                    held.pop()
            del stack[k:]

        def last_node(k: int) -> bool:
            """Whether a node is open inside the k-th element."""
            return bool(nodes) and nodes[-1] > k

        def text(raw: str) -> None:
            if raw and not controls:
                plain = html.unescape(raw) if "&" in raw else raw
                run.append(plain)
                if links:
                    self.linked[stack[-1][1]] += len(plain.strip())

        for m in iter(lambda: _TOKEN.search(s, at), None):
            text(s[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                k = last((name,))
                if k > 0:
                    if name not in NODES and name not in SCOPES and last_node(k):
                        if name == "a":
                            renamed(k)
                            links -= 1
                        continue
                    pop_to(k)
                continue
            if name in RAW:
                if not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(s, at)
                    # an end tag may have attributes, which are ignored
                    at = s.find(">", end.end()) + 1 or len(s) if end else len(s)
                run.append(" ")
                continue
            foreign = bool(places["svg"] or places["math"])
            if name in SCOPES or name in CONTROLS or foreign:
                if name != "math" and not foreign:
                    run.append(" ")
                if m[3].rstrip().endswith("/"):
                    continue
            if name == "br" or name == "wbr":
                run.append(" " if name == "br" else "")
                continue
            if controls and name in BLOCKS and name not in ("div", "hr"):
                # a control holds no text blocks: its end tag is missing, what is open inside it stays
                for k in [k for t in CONTROLS for k in list(places[t])]:
                    renamed(k)
                    bounds[:] = [b for b in bounds if b != k]
                controls = 0
            if name in CLOSES_P:
                if bounds[-1] and stack[bounds[-1]][0] == "p":
                    pop_to(bounds[-1])
            if name in SIBLING_ENDS:
                ends, keeps = SIBLING_ENDS[name]
                k = last(ends)
                if k > max(0, last(keeps), last(SCOPES)):
                    pop_to(k)
            if name == "html" or name == "hr":
                flush()
                continue
            if name in NODES:
                flush()
                self.parent.append(stack[-1][1])
                self.depth.append(self.depth[stack[-1][1]] + 1)
                self.tag.append(name)
                self.attrs.append(m[3])
                for column in (self.own, self.linked, self.marks):
                    column.append(0)
                push(name, len(self.tag) - 1)
            elif name not in VOID:
                links += name == "a"
                controls += name in CONTROLS
                push(name, stack[-1][1])
        text(s[at:])
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, linked, marks = (np.array(c, float) for c in (self.own, self.linked, self.marks))
        below, below_links, kids = own.copy(), linked.copy(), np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            below[p] += below[i]
            below_links[p] += below_links[i]
            kids[p] += 1
        total = max(1.0, below[0])
        x = np.zeros((n, WIDTH))
        for i, (tag, attrs) in enumerate(zip(self.tag, self.attrs, strict=True)):
            if tag in TAG_AT:
                x[i, TAG_AT[tag]] = 1
            if attrs.strip():
                a = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
                name = f"{a.get('class', '')} {a.get('id', '')} {a.get('itemprop', '')}"
                x[i, _N : _N + len(_NAMES)] = [bool(p.search(name)) for p in _NAMES]
                role = a.get("role", "").lower()
                if role in _ROLES:
                    x[i, _R + _ROLES.index(role)] = 1
                x[i, _X] = "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "")))
        density = below_links / np.maximum(1, below)
        own_density = linked / np.maximum(1, own)
        x[:, _X + 1] = np.log1p(own) / 5
        x[:, _X + 2] = np.log1p(below) / 8
        x[:, _X + 3] = density
        x[:, _X + 4] = own_density * (own > 0)
        x[:, _X + 5] = np.minimum(1, 20 * marks / np.maximum(20, own))
        x[:, _X + 6] = below / total
        x[:, _X + 7] = (density > 0.5) & (below > 0)
        x[:, _X + 8] = own > 80
        x[:, _X + 9] = (own == 0) & (kids == 0)
        x[:, _X + 10] = 1
        return x

    def text(self, content: np.ndarray) -> str:
        return "\n\n".join(t for node, t in self.runs if content[node])


TAG_AT = {t: i for i, t in enumerate(TAGS)}
_N = len(TAGS)
_R = _N + len(_NAMES)
_X = _R + len(_ROLES)
WIDTH = _X + 11


class Forest:
    """The trees of many pages, level by level."""

    def __init__(self, pages: list[Page]):
        self.x = np.concatenate([p.features() for p in pages])
        starts = np.cumsum([0, *[len(p.tag) for p in pages]])
        self.starts = starts
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, starts, strict=False)])
        self.kind = np.concatenate([[0 if t in _LEAF else 1 if t in _MARKED else 2 for t in p.tag] for p in pages])
        depth = np.concatenate([p.depth for p in pages])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1)))[1:]

    def beliefs(self, w: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node; joint P(parent's, own) of every node but roots (0 for those)."""
        n = len(self.x)
        up = np.zeros((n, 2))
        up[:, 1] = np.clip(self.x @ w, -30, 30)
        to = np.zeros((n, 2))
        edge = e[self.kind]
        for level in reversed(self.levels):
            to[level] = np.logaddexp(up[level, None, 0] + edge[level, :, 0], up[level, None, 1] + edge[level, :, 1])
            np.add.at(up, self.parent[level], to[level])
        full = up.copy()
        joint = np.zeros((n, 2, 2))
        for level in self.levels:
            p = self.parent[level]
            rest = full[p] - to[level]
            both = rest[:, :, None] + edge[level] + up[level][:, None, :]
            full[level] = np.logaddexp(both[:, 0], both[:, 1])
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -60, 60))), joint


def labelled_page(rng: random.Random) -> tuple[str, str]:
    """A generated page, its content blocks marked by the attribute data-y, and its layout's name."""
    letters = rng.choice(["etaoinshrdlu", "eanirstöüßdl", "eaisnrtulçéè", "eaosrnñóídl", "aiueoknstrmh"])
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    odd = rng.random() < 0.2

    def sentence(a: int = 3, b: int = 18) -> str:
        s = words(a, b).capitalize() + rng.choice([".", ".", "!", "?"])
        return re.sub(r"(\w+) ", lambda m: m[1] + rng.choice(["*** ", "### ", "$$$ ", "&amp;&amp;&amp; "]), s) if odd and rng.random() < 0.7 else s

    def para(short: bool = False) -> str:
        return " ".join(sentence() for _ in range(1 if short else rng.choice([1, 1, 2, 3, 5, 9])))

    y = ' data-y="1"'
    link = lambda a=1, b=3: f'<a href="/{word()}">{words(a, b)}</a>'
    links = lambda n=8: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, n))) + "</ul>"
    name = lambda *c: f' {rng.choice(["class", "id"])}="{rng.choice(c)}"'

    def body_block() -> str:
        r = rng.random()
        if r < 0.6:
            return f"<p{y}>{para()}" + rng.choice(["</p>", "</p>", "", "<br>"])
        if r < 0.68:
            return f"<p{y}><b>{para(True)}<br>"
        if r < 0.76:
            h = rng.choice(["h2", "h3", "h4"])
            return f"<{h}{y}>{words(1, 7)}</{h}>"
        if r < 0.82:
            return f"<ul{y}>" + "".join(f"<li{y}>{para(True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.86:
            return f"<blockquote{y}><p{y}>{para()}</p></blockquote>"
        if r < 0.9:
            return f"<p{y}>{sentence()} {link()} {sentence()}</p>"
        if r < 0.93:
            return f"<table{y}><tr{y}><td{y}>{words(1, 4)}</td><td{y}>{words(1, 5)}</td></tr></table>"
        if r < 0.96:
            return f"<pre{y}>{words(3, 20)}</pre>"
        return f"<div{y}>{para()}</div>"

    def junk() -> str:
        text = rng.choice([para(), para(True), words(2, 6), link(), f"<p>{para()}</p>", f"<p>{para(True)}</p>{link()}", links(5)])
        return rng.choice([
            f"<div{name('ad', 'ads', 'advert', 'advertisement', 'ad-slot', 'sponsored', 'promo', 'banner-ad')}>{text}</div>",
            f"<aside{rng.choice(['', name('sidebar', 'related', 'promo')])}>{text}</aside>",
            f"<div{name('sidebar', 'related', 'related-posts', 'widget', 'trending', 'recommended')}>{text}</div>",
            f"<div{name('cookie-notice', 'cookie-banner', 'notice', 'consent', 'alert', 'gdpr', 'popup')}{rng.choice(['', ' role=\"alert\"', ' role=\"dialog\"'])}><p>{para(True)}</p></div>",
            f"<form{rng.choice(['', name('newsletter', 'search', 'subscribe')])}><label>{words(1, 4)}</label><input type=\"text\"><p>{sentence()}</p></form>",
            f"<div{name('share', 'social', 'tags', 'breadcrumbs', 'pagination')}>{link()} {link()} {link()}</div>",
            f"<div{name('newsletter', 'subscribe', 'signup')}><h3>{words(2, 5)}</h3><p>{para(True)}</p></div>",
        ])

    def comments() -> str:
        one = lambda: rng.choice(["<li{c}><p>{t}</p></li>", "<div{c}><p>{t}</p></div>", "<article{c}><p>{t}</p></article>", "<p>{t}</p>"]).format(c=name("comment", "comment-body", "reply"), t=para())
        inner = f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5)))
        return rng.choice(["<section{c}>{i}</section>", "<div{c}>{i}</div>", "<ol{c}>{i}</ol>"]).format(c=name("comments", "comment-list", "responses", "discussion", "disqus_thread", "reader-comments"), i=inner)

    inside = [rng.choice(["<h1{y}>{t}</h1>", "<h1{y}>{t}</h1>", "<header{y}><h1{y}>{t}</h1></header>", ""]).format(y=y, t=words(1, 10))]
    for _ in range(rng.choice([1, 2, 3, 6, 10, 16])):
        inside.append(body_block())
        if rng.random() < 0.08:
            inside.append(junk())
    if rng.random() < 0.1:
        inside.append(rng.choice([comments(), f"<footer>{words(2, 6)} {link()}</footer>"]))
    layout = rng.choice(["article", "article", "main", "both", "named", "named", "plain", "section"])
    text = "".join(inside)
    named = name("content", "post", "entry-content", "article-body", "story", "post-content", "main-content", "text", "article", "main")
    core = {
        "article": f"<article{y}>{text}</article>", "main": f"<main{y}>{text}</main>", "both": f"<main{y}>{rng.choice(['', junk()])}<article{y}>{text}</article></main>",
        "named": f"<div{named}{y}>{text}</div>", "plain": f"<div{y}>{text}</div>", "section": f"<section{named}{y}>{text}</section>",
    }[layout]
    if rng.random() < 0.3:
        core = rng.choice([f"<div{name('container', 'wrapper', 'page', 'layout', 'row')}{y}>{core}</div>", f"<div{y}>{core}</div>"])
    top, end = [], []
    if rng.random() < 0.8:
        top.append(rng.choice(["<nav>{l}</nav>", "<div{m}>{l}</div>", "<header><nav>{l}</nav></header>", "<ul{m}><li>{a}</li><li>{a}</li></ul>"]).format(l=links(), m=name("nav", "menu", "navbar", "top-menu"), a=link()))
    if rng.random() < 0.4:
        top.append(rng.choice(["<header><h2>{t}</h2><p>{s}</p></header>", "<div{h}>{t} <p>{s}</p></div>", "<header>{t}</header>"]).format(t=words(1, 4), s=sentence(), h=name("header", "site-header", "masthead", "topbar")))
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        (top if rng.random() < 0.5 else end).append(junk())
    if rng.random() < 0.4:
        end.append(comments())
    if rng.random() < 0.85:
        end.append(rng.choice(["<footer>{t}</footer>", "<footer><p>{t}</p>{l}</footer>", "<div{f}>{t}</div>", "<div{f}><p>{t}</p></div>"]).format(t=rng.choice(["&copy; ", "", ""]) + f"{word()} &middot; {para(True)}", l=links(4), f=name("footer", "site-footer", "page-footer", "copyright")))
    noise = lambda: rng.choice(["", "<script>var t=\"</p>\";</script>", "<!-- ad -->", "\n"])
    page = "<!DOCTYPE html><html><head><title>" + words(2, 6) + "</title><style>p{margin:0}</style></head><body>" + noise().join([*top, core, *end]) + rng.choice(["</body></html>", ""])
    return page, layout


def labels_of(page: Page) -> np.ndarray:
    return np.array(["data-y" in a for a in page.attrs], float)


@cache
def model(n_train: int = 500, steps: int = 300, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the nodes and of the edges, learnt from ``n_train`` labelled pages."""
    rng = random.Random(seed)
    pages = [Page(labelled_page(rng)[0]) for _ in range(n_train)]
    y = np.concatenate([labels_of(p) for p in pages])
    forest = Forest(pages)
    inner = forest.parent >= 0
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]].astype(int), y[inner].astype(int)), 1)
    w, e = np.zeros(WIDTH), np.zeros((3, 2, 2))
    mw, vw, me, ve = np.zeros_like(w), np.zeros_like(w), np.zeros_like(e), np.zeros_like(e)
    for t in range(1, steps + 1):
        p, joint = forest.beliefs(w, e)
        gw = forest.x.T @ (y - p) / len(y) - 2e-4 * w
        ge = -2e-4 * e
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, forest.kind[inner], joint[inner])
        ge = ge + (seen - expected) / len(y)
        for value, g, m, v in ((w, gw, mw, vw), (e, ge, me, ve)):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            value += 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w, e


def extract(sources: list[str | None], weights: tuple[np.ndarray, np.ndarray]) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    content = forest.beliefs(*weights)[0] > 0.5
    return [p.text(content[a:b]) for p, a, b in zip(pages, forest.starts, forest.starts[1:], strict=False)]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (empty if none), n_chars in code points.

    Null and empty pages give the empty text; pages are read whole, however long; repeated rows give repeated
    results; an empty table an empty one; only the three named columns are read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch.slice(i, 64)
                texts = extract(b.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extracted, f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
