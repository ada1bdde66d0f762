"""Main text of web pages: boosted trees score DOM nodes, and one consistent choice is decoded over the tree.

The trees see text, links and tags of a node's subtree, its attribute words and those above
it, its depth and its place among its siblings.  A node may be kept only if its parent is kept; the best such
choice by summed log odds is found from the leaves up.

Labels come from pages whose elements say what they are (article, nav, footer...), and from the same contents
laid out anew in other ways: other elements, attribute words, wrappers, sidebars, notices, comments.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.base import quoted
from opsframe.llm.dom import INLINE, Node, attributes, parse

#: Pages that are labelled and laid out anew for fitting; longer ones than MAX_TRAIN_CHARS are not taken for it.
MAX_TRAIN_PAGES = 160
MAX_TRAIN_CHARS = 40_000
LAYOUTS = 3
#: Nodes below an article that a page gives for fitting.
MAX_ARTICLE_NODES = 14
#: Log odds that dropping a node below a kept one costs.
SWITCH = 1.5
BUCKETS = 64
_MARK = "data-opsframe-label"
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
GROUPS = [
    ("article",), ("main",), ("section",), ("div",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "menu", "dl"),
    ("li", "dt", "dd"), ("a",), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "input", "button", "label"),
    ("table", "tbody", "tr", "td", "th", "thead"), ("blockquote", "pre", "code"), ("figure", "figcaption", "img"), ("body", "html", ""),
    ("dialog",), ("br", "hr"),
]
_GROUP = {tag: i for i, group in enumerate(GROUPS) for tag in group}


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


class Page:
    """The nodes of a page in page order with their features; parents come before children."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.up: list[int] = []
        self.depth: list[int] = []
        self.words: list[tuple[int, ...]] = []
        self.marks: list[str | None] = []
        stack = [(parse(source), -1, 0)]
        known: dict[str, tuple[tuple[int, ...], str | None]] = {"": ((), None)}
        while stack:
            node, up, depth = stack.pop()
            place = len(self.nodes)
            self.nodes.append(node)
            self.up.append(up)
            self.depth.append(depth)
            raw = node.attributes
            if raw not in known:
                found = attributes(raw)
                spoken = " ".join(found.get(a, "") for a in ("id", "class", "role", "itemprop", "aria-label", "name"))
                known[raw] = tuple({_bucket(w.lower()) for w in _SPLIT.split(spoken) if w}), found.get(_MARK)
            self.words.append(known[raw][0])
            self.marks.append(known[raw][1])
            for item in reversed(node.items):
                if isinstance(item, Node):
                    stack.append((item, place, depth + 1))

    def features(self) -> np.ndarray:
        n = len(self.nodes)
        own, marks = np.zeros(n), np.zeros(n)
        for i, node in enumerate(self.nodes):
            for item in node.items:
                if isinstance(item, str):
                    own[i] += len(item.strip())
                    marks[i] += item.count(",") + item.count(".")
        up = np.array(self.up)
        tag = np.array([_GROUP.get(x.tag, len(GROUPS) + (x.tag in INLINE)) for x in self.nodes])
        text, link, tags, paragraphs, longest, points, forms = own.copy(), np.where(tag == 8, own, 0), np.ones(n), (tag == 4) * 1.0, own.copy(), marks.copy(), (tag == 13) * 1.0
        for i in range(n - 1, 0, -1):
            p = up[i]
            text[p] += text[i]
            link[p] += text[i] if tag[i] == 8 else link[i]
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i]
            points[p] += points[i]
            forms[p] += forms[i]
            longest[p] = max(longest[p], longest[i])
        children = np.bincount(up[1:], minlength=n)
        seen, index = np.zeros(n, int), np.zeros(n)
        for i in range(1, n):
            index[i] = seen[up[i]]
            seen[up[i]] += 1
        before = np.cumsum(own) - own
        whole = max(1.0, text[0])
        siblings = children[np.maximum(up, 0)]
        above = np.zeros((n, BUCKETS), np.float32)
        self_words = np.zeros((n, BUCKETS), np.float32)
        kinds = np.zeros((n, len(GROUPS) + 2), np.float32)
        kinds[np.arange(n), tag] = 1
        kinds_above = np.zeros_like(kinds)
        for i in range(n):
            if self.words[i]:
                self_words[i, list(self.words[i])] = 1
            if i:
                p = up[i]
                np.maximum(above[p], self_words[p], out=above[i])
                np.maximum(kinds_above[p], kinds[p], out=kinds_above[i])
        plain = np.stack([
            np.array(self.depth), index, siblings, index / np.maximum(1, siblings - 1), children,
            np.log1p(text), np.log1p(own), link / np.maximum(1, text), np.log1p(tags), text / tags, np.log1p(paragraphs),
            np.log1p(longest), points / np.maximum(1, text), text / whole, before / whole, (before + text) / whole, forms,
            text[np.maximum(up, 0)] / whole, link[np.maximum(up, 0)] / np.maximum(1, text[np.maximum(up, 0)]),
        ], axis=1).astype(np.float32)
        return np.concatenate((plain, kinds, kinds_above, self_words, above), axis=1)

    def labels(self) -> np.ndarray:
        """1 kept, 0 dropped, -1 unknown: by marks or telling elements, and for what is above or below them."""
        n = len(self.nodes)
        out = np.full(n, -1)
        for i in range(n):
            mark = self.marks[i]
            tag = self.nodes[i].tag
            if mark is not None:
                out[i] = int(mark)
            elif i and out[self.up[i]] >= 0:
                out[i] = out[self.up[i]]
            elif tag == "article":
                out[i] = 1
            elif tag in ("nav", "footer", "aside", "header", "form", "dialog") or tag == "div" and "ad" in attributes(self.nodes[i].attributes).get("class", "").split():
                out[i] = 0
        for i in range(n - 1, 0, -1):
            if out[i] == 1 and out[self.up[i]] < 0:
                out[self.up[i]] = 1
        return out

    def kept(self, odds: np.ndarray) -> np.ndarray:
        """The best choice in which every kept node but the root has a kept parent."""
        n = len(self.nodes)
        keep = odds.copy()  # log odds of keeping against dropping, of the best choice below
        keep[0] = 0.0
        for i in range(n - 1, 0, -1):
            keep[self.up[i]] += max(keep[i], -SWITCH)
        out = np.zeros(n, bool)
        out[0] = True
        for i in range(1, n):
            out[i] = out[self.up[i]] and keep[i] > -SWITCH
        return out

    def text(self, kept: np.ndarray) -> str:
        """Texts of kept nodes: blocks apart by a space, white space within them as one space."""
        place = {id(node): i for i, node in enumerate(self.nodes)}
        parts: list[str] = []
        stack: list = [self.nodes[0]]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            elif kept[place[id(item)]]:
                inline = item.tag in INLINE
                if not inline:
                    parts.append(" ")
                    stack.append(" ")
                stack.extend(reversed(item.items))
            elif item.tag not in INLINE:
                parts.append(" ")
        return _SPACE.sub(" ", "".join(parts)).strip()


@dataclass
class Trees:
    """Boosted trees of one depth over binned features, held as arrays: feature and limit per inner node."""

    edges: list[np.ndarray]
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(rows), int)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (rows[every, feature[at]] > limit[at])
            out += leaf[at - len(feature)]
        return out

    @staticmethod
    def fit(rows: np.ndarray, label: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 2.0) -> Trees:
        """Gradient boosting of log loss by second-order gains over at most 32 bins a feature."""
        binary = ((rows == 0) | (rows == 1)).all(axis=0)
        edges = [np.array([0.5]) if b else np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for b, c in zip(binary, rows.T, strict=True)]
        varied = rows.max(axis=0) > rows.min(axis=0)
        yes, graded = np.flatnonzero(binary & varied), np.flatnonzero(~binary & varied)
        flags = np.ascontiguousarray(rows[:, yes])
        width = 33
        bins = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in graded], axis=1) + np.arange(len(graded)) * width
        share = float(np.clip(label.mean(), 0.01, 0.99))
        start = float(np.log(share / (1 - share)))
        odds = np.full(len(rows), start)
        inner, leaves = 2**depth - 1, 2**depth
        features, limits, values = [], [], []

        def low_sums(x: np.ndarray, here: np.ndarray) -> np.ndarray:
            """Sum of x below each possible limit: of the graded features, then of the flags."""
            graded_sums = np.bincount(bins[here].ravel(), np.repeat(x[here], len(graded)), len(graded) * width)
            low = graded_sums.reshape(-1, width).cumsum(axis=1)[:, :-1].ravel()
            return np.concatenate((low, x[here].sum() - x[here].astype(np.float32) @ flags[here]))

        split = [(f, b) for f in graded for b in range(width - 1)] + [(f, 0) for f in yes]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-odds))
            g, h = label - p, p * (1 - p)
            feature, limit = np.zeros(inner, int), np.full(inner, np.inf, np.float32)
            at = np.zeros(len(rows), int)
            for node in range(inner):
                here = np.flatnonzero(at == node)
                if len(here) >= 10:
                    gl, hl = low_sums(g, here), low_sums(h, here)
                    whole_g, whole_h = g[here].sum(), h[here].sum()
                    gain = gl**2 / (hl + ridge) + (whole_g - gl) ** 2 / (whole_h - hl + ridge)
                    gain[(hl < 1e-3) | (whole_h - hl < 1e-3)] = -np.inf
                    best = int(np.argmax(gain))
                    f, b = split[best]
                    if gain[best] > whole_g**2 / (whole_h + ridge) + 1e-6 and b < len(edges[f]):
                        feature[node], limit[node] = f, edges[f][b]
                at[here] = 2 * node + 1 + (rows[here, feature[node]] > limit[node])
            g_leaf, h_leaf = np.bincount(at - inner, g, leaves), np.bincount(at - inner, h, leaves)
            value = rate * g_leaf / (h_leaf + ridge)
            odds += value[at - inner]
            features.append(feature)
            limits.append(limit)
            values.append(value)
        return Trees(edges, np.array(features), np.array(limits), np.array(values), start)


# Words that pages use in ids and classes, by the part they name.
PART_WORDS = {
    "content": "article content post entry story main body text page blog news detail hentry prose".split(),
    "nav": "nav menu navbar navigation breadcrumb topbar links tabs pager pagination toc".split(),
    "header": "header masthead banner branding site logo top hero tagline".split(),
    "footer": "footer colophon copyright legal bottom credits imprint".split(),
    "sidebar": "sidebar aside rail widget related recommended popular trending side secondary".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adbox".split(),
    "notice": "cookie notice consent gdpr popup modal newsletter subscribe alert banner paywall overlay toast".split(),
    "comments": "comments comment reply replies discussion disqus respond thread feedback reviews".split(),
    "form": "form search login signup contact register".split(),
    "share": "share social sharing follow tags meta byline".split(),
}
_ELEMENTS = {
    "nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"],
    "ad": ["div", "aside", "section"], "notice": ["div", "section", "dialog", "aside"], "comments": ["section", "div", "ol"], "form": ["form", "div"],
    "share": ["div", "ul"],
}


def laid_out(article: str, phrases: list[str], rng: random.Random) -> str:
    """The article's markup in another page layout around it, with every part marked as kept or dropped."""
    def name(part: str) -> str:
        words = rng.sample(PART_WORDS[part], 2)
        style = rng.choice(['class="{0}"', 'id="{0}"', 'class="{0}-{1}"', 'class="{0} {1}"', 'id="{0}-{1}"', 'class="site-{0}"', 'class="{0}-wrapper {0}"', 'class="c-{0}__inner"', 'class="widget {0}"' if part != "content" else 'class="{0}-content"'])
        return style.format(*words)

    def phrase(most: int = 12) -> str:
        return " ".join(rng.choice(phrases).split()[: rng.randint(1, most)])

    def inside(part: str) -> str:
        if part in ("nav", "share"):
            links = [f'<a href="/{i}">{phrase(2)}</a>' for i in range(rng.randint(2, 9))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if rng.random() < 0.6 else " ".join(links)
        if part == "header":
            return f"<h1>{phrase(4)}</h1>" * rng.randint(0, 1) + f"<p>{phrase()}</p>" * rng.randint(0, 1) + f'<a href="/">{phrase(2)}</a>'
        if part == "footer":
            return rng.choice(["&copy; {0}", "<p>&copy; {0} {1}</p>", "<p>{0}</p><p>{1}</p>", "{0} &middot; {1}"]).format(phrase(), phrase())
        if part == "sidebar":
            return "".join(f"<h3>{phrase(3)}</h3>" + rng.choice([f"<p>{phrase(30)}</p>", f"<ul><li><a href='#'>{phrase(6)}</a></li><li><a href='#'>{phrase(6)}</a></li></ul>"]) for _ in range(rng.randint(1, 3)))
        if part == "notice":
            return f"<p>{phrase(30)}</p>" + rng.choice(["<button>OK</button>", f"<a href='#'>{phrase(2)}</a>", ""])
        if part == "comments":
            each = [rng.choice([
                f"<div class='comment'><b>{phrase(2)}</b><p>{phrase(40)}</p></div>", f"<li>{phrase(40)}</li>", f"<article class='comment-body'><p>{phrase(50)}</p><p>{phrase(30)}</p></article>",
                f"<div><span>{phrase(2)}</span> <p>{phrase(60)}</p></div>",
            ]) for _ in range(rng.randint(1, 5))]
            return f"<h3>{phrase(2)}</h3>" * rng.randint(0, 1) + "".join(each)
        if part == "form":
            return f"<label>{phrase(2)}</label><input name='q'><button>{phrase(2)}</button>" + f"<p>{phrase(8)}</p>" * rng.randint(0, 1)
        return rng.choice(["{0}", "<p>{0}</p>", "<a href='#'>{0}</a>", "<p>{0}</p><p>{1}</p>"]).format(phrase(25), phrase(25))

    def block(part: str) -> str:
        tag = rng.choice(_ELEMENTS[part])
        telling = tag in ("nav", "header", "footer", "aside", "form", "dialog")
        named = name(part) if not telling or rng.random() < 0.6 else ""
        return f'<{tag} {named} {_MARK}="0">{inside(part)}</{tag}>'

    def some(parts: list[str], chance: float) -> str:
        return "".join(block(p) for p in parts if rng.random() < chance)

    tag = rng.choice(["article", "article", "div", "div", "main", "section"])
    named = name("content") if tag in ("div", "section") or rng.random() < 0.5 else ""
    pieces = re.split(r"(?=<p>)", article)
    for part in ("ad", "share", "sidebar", "notice"):
        if rng.random() < 0.15:
            pieces.insert(rng.randint(1, len(pieces)), block(part))
    core = f'<{tag} {named} {_MARK}="1">{"".join(pieces)}</{tag}>'
    core = some(["share", "ad"], 0.2) + core + some(["share", "comments", "ad", "form", "sidebar"], 0.4)
    for _ in range(rng.randint(0, 3)):
        wrap = rng.choice(["<div>{}</div>", "<div class='wrapper'>{}</div>", "<div id='page'>{}</div>", "<main>{}</main>", "<div class='row container'>{}</div>", "<section>{}</section>"])
        core = wrap.replace("{}", core)
        if rng.random() < 0.5:
            core = some(["sidebar", "nav"], 0.3) + core + some(["sidebar", "comments"], 0.3)
    body = some(["notice", "header", "nav", "ad", "form"], 0.5) + core + some(["sidebar", "comments", "form", "footer", "notice"], 0.5)
    return f"<!DOCTYPE html><html><head><title>{phrase()}</title></head><body>{body}</body></html>"


def training_nodes(pages: list[str], seed: int = 1, layouts: int = LAYOUTS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of labelled pages and of their new layouts."""
    rng = random.Random(seed)
    whole = [re.search(r"<article[^>]*>(.*?)(?:</article>|\Z)", p, re.S) for p in pages]
    phrases = [t for p in pages[:60] for t in re.findall(r">([^<>]{20,})<", p)] or ["some words of text stand here"]
    rows, labels = [], []
    for source, found in zip(pages, whole, strict=True):
        texts = [source]
        if found:
            short = "".join(re.split(r"(?=<p>)", found[1])[: rng.randint(1, 3)])
            texts += [source[: found.start(1)] + short + source[found.end(1) :], laid_out(short, phrases, rng)]
            texts += [laid_out(found[1], phrases, rng) for _ in range(layouts - 1)]
        for text in texts:
            page = Page(text)
            label = page.labels()
            inside = np.flatnonzero([label[i] == 1 and page.nodes[i].tag in ("p", "b", "br", "i", "span") for i in range(len(label))])
            label[rng.sample(list(inside), max(0, len(inside) - MAX_ARTICLE_NODES))] = -1
            rows.append(page.features()[label >= 0])
            labels.append(label[label >= 0])
    return np.concatenate(rows), np.concatenate(labels).astype(float)


def fit(pages: DataFrame, html: str = "html", most: int = MAX_TRAIN_PAGES) -> Trees | None:
    """Fit on at most ``most`` pages that name their article; None if there are none."""
    body = quoted(html)
    wanted = pages.select(body.alias("html")).filter(F.contains(body, F.lit("<article")) & (F.length(body) < MAX_TRAIN_CHARS))
    sample = [r["html"] for r in wanted.orderBy(F.xxhash64("html"), "html").limit(most).collect()]
    return Trees.fit(*training_nodes(sample)) if sample else None


def main_texts(sources: list[str], trees: Trees | None) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages or trees is None:
        return ["" for _ in pages]
    rows = [p.features() for p in pages]
    odds = trees.odds(np.concatenate(rows))
    parts = np.split(odds, np.cumsum([len(r) for r in rows])[:-1])
    return [p.text(p.kept(o)) for p, o in zip(pages, parts, strict=True)]


def extract(pages: DataFrame, trees: Trees | None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    A null or empty page, or one without an article, has an empty text.  Repeated rows each keep a row.  Other columns
    are not looked at.  Without a model (no page to learn from) all texts are empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # a fixed number of trees
    rows = pages.select(quoted(key).alias("page_id"), quoted(url).alias("url"), quoted(html).alias("html"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sources = batch["html"].fillna("")
            size = sources.str.len().cumsum()
            for _, part in batch.groupby((size // 200_000).to_numpy()):
                texts = main_texts(list(part["html"].fillna("")), shared.value)
                yield pd.DataFrame({
                    "page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts],
                })

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(work, f"page_id {kind}, url string, text string, n_chars long")
