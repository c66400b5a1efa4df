"""Main text of web pages, by a tree-structured graphical model over their elements.

A page is read as a tree: block elements, and below them the blocks of text
that stand between the beginnings and ends of block elements. Inline elements
are not nodes. Each node has one of three states: other (no main text in it),
main (main text) and mixed (holds elements of both). Two kinds of potentials tie
them: between a node and its parent (how often a child of that tag has a state
below a parent's state), and on a node itself (how often nodes of a state have
its tag, the words of its class, id and role, its amount of text and its share
of link text; for a block of text also whether it ends as a sentence does).
Messages are summed and multiplied from the leaves to the root and back, for all
nodes of a depth in many pages at once; that gives the marginal of each block of
text, which is main text from one half on.

The potentials are fitted together on at most ``MAX_LABELLED`` labelled pages
(``fit``), so that the labels are likeliest; words that few of these pages have
are left out. Labelled pages mark elements by ``data-main``; by default they are
those of ``labelled_pages``, since the table of pages carries no labels.

Scripts, styles, comments, controls of forms and the page's head are no text.
Character references are decoded, runs of white space (as Python has it, so
no-break spaces too) become one space, blocks are trimmed and empty ones
dropped; the others are joined by a line's end in page order. A line break
inside a block is white space. Unclosed and misnested elements end where HTML
lets them end, text after the last unclosed tag or comment is markup.

Null and empty html, and pages without text, give the empty text. Repeated rows
are extracted alike, null ids and urls are kept. Other columns are not read. An
empty table gives an empty result. A page is in one task, as a row is; pages are
worked on in groups of ``GROUP_CHARS`` characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslode.llm.common import bounded_batches
from corpuslode.llm.labelled_pages import labelled_pages

OTHER, MAIN, MIXED = range(3)
GROUP_CHARS = 2_000_000
#: Words of classes and ids in fewer labelled pages say nothing.
LEAST_PAGES = 4
CACHE_TAGS = 50_000
#: Before a tag: the word of elements of that tag that have no known one.
NAMELESS = "no name: "
#: Pages that the model is fitted on at most, rounds of fitting, and the step of the first one.
MAX_LABELLED, ROUNDS, RATE = 5000, 100, 0.8

# Elements of HTML by what they do to the text in them.
BLOCKS = frozenset(
    "html body div section article main aside nav header footer form fieldset legend ul ol menu dl li dt dd p h1 h2 h3 h4 h5 h6 hgroup blockquote pre table thead tbody tfoot tr td th "
    "caption figure figcaption address details summary dialog center search ins".split()
)
UNREAD = frozenset("script style title textarea noscript template select button iframe svg math object audio video canvas head datalist noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a beginning element ends, and how far up the tree that reaches.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
CELLS = frozenset(("td", "th", "caption"))
TABLES = frozenset(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"))

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {name: re.compile(rf"</{name}[^>]*>", re.I) for name in UNREAD}
_SENTENCE = (".", "!", "?", "…", "。", "！", "？", ":", ";", '"', "”", "»", ")")
_NAMES = frozenset(("class", "id", "role", "itemprop", "aria-label"))

CHAR_STEPS = (1, 15, 60, 200, 600, 3000)
LINK_STEPS = (0.001, 0.2, 0.5, 0.8)


class Nodes:
    """Nodes of many pages: parents stand before their children."""

    def __init__(self):
        self.page: list[int] = []
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.attributes: list[str] = []
        self.chars: list[int] = []
        self.links: list[int] = []
        self.text: list[str] = []
        #: What ``data-main`` says of a node, or of the nearest one above that has it.
        self.marked: list[int] = []

    def add(self, page: int, parent: int, tag: str, attributes: str = "", chars: int = 0, links: int = 0, text: str = "") -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.chars.append(chars)
        self.links.append(links)
        self.text.append(text)
        above = self.marked[parent] if parent >= 0 else 0
        if "data-main" in attributes and (m := re.search(r"data-main=\"?([01])", attributes)):
            above = int(m[1])
        self.marked.append(above)
        return len(self.page) - 1


def read_page(nodes: Nodes, page: int, html: str) -> None:
    """Add a page's tree to ``nodes``."""
    stack = [("#root", nodes.add(page, -1, "#root"))]
    parts: list[str] = []
    in_link = links = at = 0

    def flush() -> None:
        nonlocal links
        if parts:
            if text := " ".join("".join(parts).split()):
                nodes.add(page, stack[-1][1], "#text", "", len(text), min(links, len(text)), text)
            parts.clear()
            links = 0

    def end(names, reach) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in reach:
                return

    n = len(html)
    while True:
        m = _MARKUP.search(html, at)
        chunk = html[at : m.start() if m else n]
        if chunk:
            chunk = unescape(chunk) if "&" in chunk else chunk
            parts.append(chunk)
            if in_link:
                links += len(chunk)
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing = name.lower(), m[1] or m[4]
        if name in UNREAD:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                found = _CLOSE[name].search(html, at)
                if name == "head" and (body := re.compile(r"<body|<article|<div|<p[\s>]", re.I).search(html, at)) and (found is None or body.start() < found.start()):
                    at = body.start()
                else:
                    at = found.end() if found else (at if name == "head" else n)
                parts.append(" ")
        elif name in VOID:
            if name in ("br", "hr"):
                flush() if name == "hr" else parts.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name in BLOCKS or "-" in name:
            flush()
            in_link = 0
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] in CELLS and name not in TABLES:
                        break
            else:
                if name in ("html", "body") and any(x[0] == name for x in stack[:3]):
                    continue
                end(("p",), CELLS)
                if name in ENDS:
                    end(*ENDS[name])
                attributes = m[3] if m[2] else m[6]
                stack.append((name, nodes.add(page, stack[-1][1], name, attributes)))
    flush()


@dataclass
class Structure:
    """Arrays of ``Nodes``: parent, depth order, and text and link characters below each."""

    parent: np.ndarray
    levels: list[np.ndarray]
    chars: np.ndarray
    links: np.ndarray


def structure(nodes: Nodes) -> Structure:
    parent = np.array(nodes.parent, np.int64)
    depth = np.zeros(len(parent), np.int64)
    for i, p in enumerate(nodes.parent):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
    chars, links = np.array(nodes.chars, np.float64), np.array(nodes.links, np.float64)
    for level in levels[:0:-1]:
        np.add.at(chars, parent[level], chars[level])
        np.add.at(links, parent[level], links[level])
    return Structure(parent, levels, chars, links)


def named_words(attributes: str) -> tuple[str, ...]:
    """The words of a node's class, id, role and label."""
    if not attributes:
        return ()
    values = [v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in _NAMES]
    return tuple(sorted({w.lower() for v in values for w in _WORDS.findall(v)}))


def steps(nodes: Nodes, s: Structure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the step of its text, of its share of link text, and whether it ends as a sentence."""
    chars = np.searchsorted(CHAR_STEPS, s.chars, side="right")
    links = np.where(s.chars > 0, np.searchsorted(LINK_STEPS, s.links / np.maximum(s.chars, 1), side="right"), len(LINK_STEPS) + 1)
    ends = np.array([2 if not t else int(t.endswith(_SENTENCE)) for t in nodes.text], np.int64)
    return chars, links, ends


def states(nodes: Nodes, s: Structure) -> np.ndarray:
    """Labels of labelled pages: main as marked; other nodes are mixed if main text is below them."""
    main = np.array(nodes.marked, np.int64)
    below = main.copy()
    for level in s.levels[:0:-1]:
        np.maximum.at(below, s.parent[level], below[level])
    return np.where(main == 1, MAIN, np.where(below == 1, MIXED, OTHER))


def kind_of(tag: str) -> str:
    return tag if tag in BLOCKS or tag[0] == "#" else "#own"


@dataclass
class Model:
    """Weights: of a child's state by its tag and the state above it (3: a root), and of features by state."""

    tags: dict[str, int]
    words: dict[str, int]
    child: np.ndarray
    chars: np.ndarray
    links: np.ndarray
    ends: np.ndarray
    word: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.child, self.chars, self.links, self.ends, self.word]


def _untrained(words: list[str]) -> Model:
    tags = {t: i for i, t in enumerate(sorted(BLOCKS | {"#root", "#text", "#own"}))}
    shapes = (len(tags), 4, 3), (2, len(CHAR_STEPS) + 1, 3), (2, len(LINK_STEPS) + 2, 3), (2, 3, 3), (len(words), 3)
    return Model(tags, {w: i for i, w in enumerate(words)}, *map(np.zeros, shapes))


def fit(spark: SparkSession, labelled: DataFrame | None = None, rounds: int = ROUNDS) -> Model:
    """The model of at most ``MAX_LABELLED`` labelled pages (column html); by default those of ``labelled_pages``.

    The weights make the labels likeliest: each round takes the counts of the
    labels less those that the present weights expect, by the messages, with a
    step for each weight of its own.
    """
    if labelled is None:
        html = labelled_pages()
    else:
        # bounded, whichever pages come first in the order of their hash
        html = [r[0] for r in labelled.where("html IS NOT NULL").select("html").orderBy(F.xxhash64("html"), "html").limit(MAX_LABELLED).collect()]
    return train(html, rounds)


def train(html: list[str], rounds: int = ROUNDS) -> Model:
    nodes = Nodes()
    for i, h in enumerate(html):
        read_page(nodes, i, h)
    known = {a: named_words(a) for a in set(nodes.attributes)}
    pages = Counter(w for w, _ in {(w, p) for p, a in zip(nodes.page, nodes.attributes, strict=True) for w in known[a]})
    model = _untrained([*(NAMELESS + t for t in sorted(BLOCKS | {"#own"})), *sorted(w for w, n in pages.items() if n >= LEAST_PAGES)])
    if not html:
        return model
    s = structure(nodes)
    state, f = states(nodes, s), features(model, nodes, s)
    # a root's state above is the fourth
    above = np.where(s.parent >= 0, state[s.parent], 3)
    one = np.zeros((len(state), 3))
    one[np.arange(len(state)), state] = 1
    pair = np.zeros((len(state), 4, 3))
    pair[np.arange(len(state)), above, state] = 1
    wanted = _sums(model, f, one, pair)
    first, second = ([np.zeros_like(w) for w in model.weights()] for _ in range(2))
    for i in range(1, rounds + 1):
        found = _sums(model, f, *_inferred(model, f, s))
        for w, a, b, m, v in zip(model.weights(), wanted, found, first, second, strict=True):
            g = (a - b - 0.5 * w) / len(html)
            m += 0.2 * (g - m)
            v += 0.05 * (g * g - v)
            w += RATE * (1 - i / (rounds + 1)) * (m / (1 - 0.8**i)) / (np.sqrt(v / (1 - 0.95**i)) + 1e-6)
    return model


@dataclass
class Features:
    tag: np.ndarray
    leaf: np.ndarray
    chars: np.ndarray
    links: np.ndarray
    ends: np.ndarray
    #: Nodes and the words they have.
    at: np.ndarray
    word: np.ndarray


def features(model: Model, nodes: Nodes, s: Structure, cache: dict[str, tuple[int, ...]] | None = None) -> Features:
    cache = {} if cache is None else cache
    tag = np.array([model.tags[kind_of(t)] for t in nodes.tag], np.int64)
    at, which = [], []
    for i, (a, t) in enumerate(zip(nodes.attributes, nodes.tag, strict=True)):
        if t[0] != "#":
            if (w := cache.get(a)) is None:
                if len(cache) > CACHE_TAGS:
                    cache.clear()
                w = cache[a] = tuple(model.words[x] for x in named_words(a) if x in model.words)
            w = w or (model.words[NAMELESS + kind_of(t)],)
            at += [i] * len(w)
            which += w
    return Features(tag, (tag == model.tags["#text"]).astype(np.int64), *steps(nodes, s), np.array(at, np.int64), np.array(which, np.int64))


def _sums(model: Model, f: Features, state: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
    """Sums over nodes, in the shape of the weights, of states and of pairs of a state above and a state."""

    def by(index: np.ndarray, values: np.ndarray, like: np.ndarray) -> np.ndarray:
        flat = values.reshape(len(values), -1)
        n = like.size // flat.shape[1]
        return np.stack([np.bincount(index, flat[:, j], n) for j in range(flat.shape[1])], axis=1).reshape(like.shape)

    sums = [by(f.tag, pair, model.child)]
    for step, like in ((f.chars, model.chars), (f.links, model.links), (f.ends, model.ends)):
        sums.append(by(f.leaf * like.shape[1] + step, state, like))
    return [*sums, by(f.word, state[f.at], model.word)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _inferred(model: Model, f: Features, s: Structure) -> tuple[np.ndarray, np.ndarray]:
    """By sum-product: of each node the probability of its states, and of its states with those above it."""
    own = model.chars[f.leaf, f.chars] + model.links[f.leaf, f.links] + model.ends[f.leaf, f.ends]
    np.add.at(own, f.at, model.word[f.word])
    # upward: what a node and all below it say of its own state, and of the state above
    up, sent = own, np.zeros_like(own)
    for level in s.levels[:0:-1]:
        sent[level] = _log_sum(model.child[f.tag[level], :3] + up[level][:, None, :], 2)
        np.add.at(up, s.parent[level], sent[level])
    # downward: what all the others say
    down, pair = np.zeros_like(own), np.zeros((len(own), 4, 3))
    roots = s.levels[0]
    down[roots] = model.child[f.tag[roots], 3]
    for level in s.levels[1:]:
        p = s.parent[level]
        joint = (up[p] + down[p] - sent[level])[:, :, None] + model.child[f.tag[level], :3]
        down[level] = _log_sum(joint, 1)
        joint = joint + up[level][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pair[level, :3] = joint / joint.sum(axis=(1, 2), keepdims=True)
    belief = up + down
    found = np.exp(belief - _log_sum(belief, 1)[:, None])
    pair[roots, 3] = found[roots]
    return found, pair


def marginals(model: Model, nodes: Nodes, s: Structure, cache: dict[str, tuple[int, ...]] | None = None) -> np.ndarray:
    """The probability of each node's states."""
    return _inferred(model, features(model, nodes, s, cache), s)[0] if s.levels else np.zeros((0, 3))


def extract(model: Model, pages: list[str | None], cache: dict[str, tuple[int, ...]] | None = None) -> list[str]:
    """The main texts of pages."""
    nodes = Nodes()
    for i, h in enumerate(pages):
        if h:
            read_page(nodes, i, h)
    found = marginals(model, nodes, structure(nodes), cache)
    texts: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(found[:, MAIN] >= 0.5).tolist():
        if nodes.text[i]:
            texts[nodes.page[i]].append(nodes.text[i])
    return ["\n".join(t) for t in texts]


def main_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of each page."""
    bounded_batches(pages.sparkSession)
    # bounded by the features of the labelled pages
    shared = pages.sparkSession.sparkContext.broadcast(model)
    d = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"CAST(`{html_col}` AS string) AS html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in batches:
            html, texts, group, held = b.column("html").to_pylist(), [], [], 0
            for h in html:
                if group and held + len(h or "") > GROUP_CHARS:
                    texts += extract(shared.value, group, cache)
                    group, held = [], 0
                group.append(h)
                held += len(h or "")
            texts += extract(shared.value, group, cache)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = dict(d.dtypes)
    return d.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
