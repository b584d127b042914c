"""Main text of web pages with gradient-boosted trees over DOM nodes.

Every block element of the parsed page is a node with features: its tag and
those of its ancestors, tokens of its class, id and role attributes and of its
ancestors' attributes, length and link share of its own and its subtree's text,
text per tag (subtree density), sentence ends, depth, and its place and kin
among its siblings. Trees give each node the probability to hold article text.

Decoding is hierarchical: a node that is dropped drops all below it, and a node
can only be kept if its parent is. Of all such choices the most probable is
taken, by one pass up the tree and one down; so no paragraph survives in a
dropped menu, and a container stands or falls with what it holds.

No labelled pages come with the data. The trees are trained here on pages that
``html_samples`` writes: a fixed number (``TRAIN_PAGES``) of random layouts
whose blocks are known.

Pages are worked on one by one, without a shuffle.

Defined cases: a null or empty page, or one without article text, gives an empty
text (a page of a single short element, too, if the trees don't take it for an article); unclosed, misnested and unknown tags are accepted; a page without tags is
one block; repeated rows get equal results; other columns are kept by
``extract_pages`` and ``text`` and ``n_chars`` replace input columns of those
names.
"""

from __future__ import annotations

import functools
import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import ready
from . import kernel as K
from .rows import unwrapped, wrapped

TRAIN_PAGES = 700

#: Element names of the HTML standard by how they are treated.
BLOCKS = frozenset("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
SILENT = frozenset("head svg math object select button datalist canvas audio video map".split())
#: What may stand in a head; anything else ends one, whether its end tag is written or not.
IN_HEAD = frozenset("html base basefont bgsound link meta title style script noscript template noframes".split())
#: Elements whose start ends an open one of certain names, unless one of others is nearer.
_LISTS = ("ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot")
ENDS = {"li": (("li",), _LISTS), "dd": (("dd", "dt"), _LISTS), "dt": (("dd", "dt"), _LISTS), "tr": (("tr",), _LISTS), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot dd dt li legend summary figcaption".split())
GROUPS = ("p", "h", "li", "div", "section", "cell", "article", "nav", "aside", "header", "footer", "form", "quote", "list")
GROUP_OF = {"p": 0, **{f"h{i}": 1 for i in range(1, 7)}, "li": 2, "dd": 2, "dt": 2, "div": 3, "center": 3, "section": 4, "td": 5, "th": 5, "article": 6, "main": 6, "nav": 7, "menu": 7, "aside": 8, "dialog": 8, "header": 9, "footer": 10, "address": 10, "form": 11, "fieldset": 11, "search": 11, "blockquote": 12, "pre": 12, "figure": 12, "figcaption": 12, "ul": 13, "ol": 13, "dl": 13, "table": 13}
#: Attribute tokens that features look at (each also in the plural).
TOKENS = "content main article post entry story body text page nav menu header footer side sidebar ad advert advertisement sponsor banner promo cookie notice consent popup modal overlay share social related recommend comment reply disqus discussion form login subscribe newsletter widget breadcrumb copyright legal tag meta author byline hidden toolbar search skip pagination pager masthead topbar bottom alert warning rail aside complementary contentinfo navigation".split()
_BIT = {t: i for i, t in enumerate(TOKENS)} | {t + "s": i for i, t in enumerate(TOKENS)} | {"ads": TOKENS.index("ad"), "stories": TOKENS.index("story"), "entries": TOKENS.index("entry"), "adv": TOKENS.index("advert"), "sponsored": TOKENS.index("sponsor"), "sharing": TOKENS.index("share"), "bodies": TOKENS.index("body"), "navbar": TOKENS.index("nav")}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_OPEN = re.compile(r"<[!?]")
_ATTRIBUTES = re.compile(r"(class|id|role|data-y|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")
_SPACE = re.compile(r"\s+")

_TAG, _PARENT, _DEPTH, _TAGS, _ATTR, _OWN, _LINK, _ENDS, _INDEX, _Y, _KIDS, _INSIDE = range(12)


def _last(opened: dict[str, list[int]], names: tuple[str, ...]) -> int:
    """The place of the innermost open element of one of these names; -1 without any."""
    return max((opened[t][-1] for t in names if opened.get(t)), default=-1)


def parse(page: str):
    """Block nodes (lists, see the names above) and the page's blocks (node, text) in order."""
    nodes: list[list] = [["html", -1, 0, 0, 0, 0, 0, 0, 0, None, 0, 0]]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and their block node
    parts: list[str] = []
    link_depth = link_chars = 0
    silent = 0
    opened: dict[str, list[int]] = {}  # places in the stack of open block elements, by name
    inner: list[dict[str, int]] = [{}]  # other open elements by name, of each open block

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                node = nodes[stack[-1][1]]
                node[_OWN] += len(text)
                node[_LINK] += min(link_chars, len(text))
                node[_ENDS] += len(_SENTENCE.findall(text))
                blocks.append((stack[-1][1], text))
            parts = []
        link_chars = 0

    def close(name: str) -> None:
        nonlocal link_depth, silent
        if not (opened if name in BLOCKS else inner[-1]).get(name):
            return
        k = len(stack) - 1
        while stack[k][0] != name:
            k -= 1
        if any(t in BLOCKS for t, _ in stack[k:]):
            flush()
        for t, _ in reversed(stack[k:]):
            link_depth -= t == "a"
            silent -= t in SILENT
            if t in BLOCKS:
                opened[t].pop()
                inner.pop()
            else:
                inner[-1][t] -= 1
        del stack[k:]

    def end_head() -> None:
        while stack[-1][0] == "head":
            close("head")

    at, n = 0, len(page)
    last = page.rfind(">") + 1  # past that there is no tag that ends
    while at < last and (m := _MARKUP.search(page, at, last)):
        if m.start() > at:
            t = page[at : m.start()]
            if t.strip():
                end_head()
            if not silent:
                parts.append(t)
                if link_depth:
                    link_chars += len(t.strip())
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):  # a comment without an end
            at = n
            break
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "p" and not opened.get("p"):
                flush()
            close(name)
            continue
        if name not in IN_HEAD:
            end_head()
        if name in ("html", "body"):  # both are the root, whether they are written or not
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            end = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            if end:
                stop = page.find(">", end.start())
                at = n if stop < 0 else stop + 1
            else:
                at = n
            continue
        nodes[stack[-1][1]][_INSIDE] += 1
        if name in BLOCKS:
            if name in CLOSES_P and opened.get("p"):
                close("p")
            elif name in ENDS:
                kin, limit = ENDS[name]
                kin_at = _last(opened, kin)
                if kin_at > _last(opened, limit):
                    close(stack[kin_at][0])
            flush()
            if name == "hr":
                continue
            up = stack[-1][1]
            parent = nodes[up]
            attr, y, text = 0, None, m[3]
            if text and ("=" in text or "hidden" in text):
                for key, value in _ATTRIBUTES.findall(text):
                    key = key.lower()
                    if key == "data-y":
                        y = value.strip("\"'")
                    elif key in ("hidden", "aria-hidden", "style"):
                        if key == "hidden" or (key == "style" and "none" in value) or (key == "aria-hidden" and "true" in value):
                            attr |= 1 << _BIT["hidden"]
                    else:
                        for t in _TOKEN.findall(value):
                            b = _BIT.get(t.lower())
                            if b is not None:
                                attr |= 1 << b
            g = GROUP_OF.get(name)
            nodes.append([name, up, parent[_DEPTH] + 1, parent[_TAGS] | (0 if g is None else 1 << g), parent[_ATTR] | attr, 0, 0, 0, parent[_KIDS], y if y is not None else parent[_Y], 0, 0])
            parent[_KIDS] += 1
            stack.append((name, len(nodes) - 1))
            opened.setdefault(name, []).append(len(stack) - 1)
            inner.append({})
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            stack.append((name, stack[-1][1]))
            inner[-1][name] = inner[-1].get(name, 0) + 1
            link_depth += name == "a"
            silent += name in SILENT
    rest = _OPEN.split(page[at:], maxsplit=1)[0]
    if rest.strip():
        end_head()
    if not silent:
        parts.append(rest)
    flush()
    return nodes, blocks


def node_features(nodes: list[list]) -> np.ndarray:
    """A row per node, see the module's text."""
    n = len(nodes)
    parent = np.array([x[_PARENT] for x in nodes])
    depth = np.array([x[_DEPTH] for x in nodes], float)
    tags = np.array([x[_TAGS] for x in nodes], np.int64)
    attr = np.array([x[_ATTR] for x in nodes], np.uint64)
    own, link, ends, index, kids, inside = (np.array([x[k] for x in nodes], float) for k in (_OWN, _LINK, _ENDS, _INDEX, _KIDS, _INSIDE))
    group = np.array([GROUP_OF.get(x[_TAG], 14) for x in nodes])
    sub = np.stack((own, link, ends, inside, np.ones(n)))
    for k in range(n - 1, 0, -1):  # children come after their parents
        sub[:, parent[k]] += sub[:, k]
    length, links, stops, markup, count = sub
    up = np.maximum(parent, 0)
    same = np.zeros(n)
    key = up * 16 + group
    _, inverse, size = np.unique(key, return_inverse=True, return_counts=True)
    same = size[inverse]
    whole = max(length[0], 1)
    cols = [
        depth, index, kids[up], same, np.log1p(own), link / np.maximum(own, 1), ends, ends / np.maximum(own, 1) * 100,
        np.log1p(length), links / np.maximum(length, 1), stops, length / (markup + count), length / whole, length / np.maximum(length[up], 1),
        links[up] / np.maximum(length[up], 1), np.log1p(count), index / np.maximum(kids[up], 1), np.log1p(own[up]),
    ]
    bits = [(tags >> k) & 1 for k in range(len(GROUPS))] + [group == k for k in range(15)] + [(attr >> np.uint64(k)) & np.uint64(1) for k in range(len(TOKENS))]
    return np.stack([*cols, *(b.astype(float) for b in bits)], 1).astype(np.float32)


class Trees:
    """Gradient-boosted trees of a fixed depth for the logistic loss, on binned features."""

    def __init__(self, *, count: int = 50, depth: int = 5, rate: float = 0.2, bins: int = 24):
        self.count, self.depth, self.rate, self.bins = count, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, self.bins + 1)[1:-1])) for c in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, c], "left") for c, e in enumerate(self.edges)], 1)
        flat = binned + np.arange(k) * self.bins
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(n, self.base)
        self.trees = []
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p) + 1e-6
            where = np.zeros(n, np.int64)
            column, edge = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                width = 1 << level
                size = k * self.bins
                index = (where[:, None] * size + flat).ravel()
                sg = np.bincount(index, np.repeat(g, k), width * size).reshape(width, k, self.bins)
                sh = np.bincount(index, np.repeat(h, k), width * size).reshape(width, k, self.bins)
                lg, lh = sg.cumsum(2), sh.cumsum(2)
                tg, th = lg[:, :, -1:], lh[:, :, -1:]
                gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
                gain[(lh < 2) | (th - lh < 2)] = 0
                best = gain.reshape(width, -1).argmax(1)
                c, b = best // self.bins, best % self.bins
                ok = gain.reshape(width, -1).max(1) > 1e-6
                for node in range(width):
                    column[width - 1 + node] = c[node]
                    edge[width - 1 + node] = self.edges[c[node]][b[node]] if ok[node] and b[node] < len(self.edges[c[node]]) else np.inf
                right = ok[where] & (binned[np.arange(n), c[where]] > b[where])
                where = 2 * where + right
            leaf = self.rate * np.bincount(where, g, 1 << self.depth) / (np.bincount(where, h, 1 << self.depth) + 1)
            f += leaf[where]
            self.trees.append((column, edge.astype(np.float32), leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for column, edge, leaf in self.trees:
            where = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + where
                where = 2 * where + (x[rows, column[at]] > edge[at])
            f += leaf[where]
        return 1 / (1 + np.exp(-f))


def decode(parent: list[int], p: np.ndarray) -> list[bool]:
    """The most probable choice in which a node is kept only if its parent is."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
    n = len(keep)
    for k in range(n - 1, 0, -1):
        up = parent[k]
        keep[up] += max(keep[k], drop[k])
        drop[up] += drop[k]
    out = [keep[0] > drop[0]] + [False] * (n - 1)
    for k in range(1, n):
        out[k] = out[parent[k]] and keep[k] > drop[k]
    return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 7) -> Trees:
    """Trees trained on ``pages`` sample pages; a container's label is whether anything in it is article text."""
    from .html_samples import sample_page

    xs, ys = [], []
    for k in range(pages):
        nodes, _ = parse(sample_page(np.random.default_rng([seed, k])))
        y = np.array([x[_Y] == "1" and x[_OWN] > 0 for x in nodes])
        for i in range(len(nodes) - 1, 0, -1):
            y[nodes[i][_PARENT]] |= y[i]
        text = np.array([x[_OWN] for x in nodes])
        for i in range(len(nodes) - 1, 0, -1):
            text[nodes[i][_PARENT]] += text[i]
        x = node_features(nodes)
        some = text > 0
        xs.append(x[some])
        ys.append(y[some])
    return Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def extracted(model: Trees, pages: list[str | None]) -> list[str]:
    """The article text of each page."""
    parsed = [parse(page) if page else ([], []) for page in pages]
    features = [node_features(nodes) for nodes, _ in parsed if nodes]
    p = model.predict(np.concatenate(features)) if features else np.zeros(0)
    out, at = [], 0
    for nodes, blocks in parsed:
        if not nodes:
            out.append("")
            continue
        keep = decode([x[_PARENT] for x in nodes], p[at : at + len(nodes)]) if len(nodes) > 1 else [True]
        at += len(nodes)
        out.append("\n\n".join(text for node, text in blocks if keep[node]))
    return out


def extract_pages(pages: DataFrame, *, html_col: str = "html", model: Trees | None = None) -> DataFrame:
    """Adds ``text``, the article's blocks joined by two line feeds, and ``n_chars``, its code points."""
    ready(pages.sparkSession)
    model = model or trained()

    def run(column: pa.Array) -> pa.Array:
        out: list[str] = []
        for at in range(0, len(column), 256):
            out += extracted(model, column.slice(at, 256).to_pylist())
        return pa.array(out, pa.string())

    text = F.arrow_udf(K.lean_column(run), "string")
    work = wrapped(pages, html=F.col(html_col).cast("string")).withColumn("text", text("html"))
    return unwrapped(work, pages.columns, {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")})
