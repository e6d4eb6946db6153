"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with a hidden state, content or not. A node has a potential from its
features (tag, words of class and id, text length, share of link text, place in the page), an edge from
parent to child has one for each pair of states, of its own for children that begin a section. The graph
is a tree, so one pass of messages from the leaves to the root and one back give the exact marginal of
every node. Weights are learned by maximum likelihood from labelled pages (:mod:`html_pages`), with the
same two passes for the gradient. The text of the nodes whose marginal says content is the result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleanset.llm.rows import parts

#: A comment, a declaration, or a tag. A value may be quoted, and a quote that does not begin a value is a
#: character like any other. Nothing is tried twice: each part takes all it can and keeps it.
OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
TOKEN = re.compile(OTHER + r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)>", re.S)
#: The same without quoted values, for what follows a tag that would have no end with them.
PLAIN = re.compile(OTHER + r"([^>]*+)>", re.S)
STARTS = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")

#: Elements of HTML by how they are treated.
UNSEEN = frozenset("script style noscript template svg head title iframe select option canvas annotation annotation-xml audio video datalist".split())
RAW = frozenset("script style title textarea noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav "
    "header footer aside form fieldset legend label button textarea blockquote pre figure figcaption address details "
    "summary dialog menu center search hgroup".split()
)
#: A start tag of the first closes an open element of the second, up to a boundary.
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
    "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "tr", "td", "th"]),
}
SCOPE = frozenset("ul ol dl table article section div aside nav header footer main body form td th blockquote".split())

TAGS = (
    "body main article section div p h1 head2 list li nav header footer aside form control table cell quote other".split()
)
TAG_GROUP = {t: t for t in TAGS if t not in ("head2", "list", "control", "cell", "quote", "other")} | {
    **dict.fromkeys("h2 h3 h4 h5 h6 hgroup".split(), "head2"),
    **dict.fromkeys("ul ol dl menu".split(), "list"),
    **dict.fromkeys("dt dd".split(), "li"),
    **dict.fromkeys("label button textarea fieldset legend search".split(), "control"),
    **dict.fromkeys("tr td th thead tbody tfoot caption".split(), "cell"),
    **dict.fromkeys("blockquote pre figure figcaption".split(), "quote"),
}
#: Words of class, id and role by what they say about an element.
NAMES = {
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner teaser outbrain taboola",
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc tabs pagination pager skip",
    "foot": "footer foot copyright legal colophon contentinfo imprint",
    "head": "header masthead topbar logo brand siteheader",
    "side": "sidebar side aside rail widget widgets related recommended trending popular complementary tags meta more",
    "notice": "cookie cookies consent notice notices gdpr privacy alert popup modal overlay newsletter subscribe subscription paywall login signup dialog",
    "comment": "comment comments commentlist reply replies disqus discussion respond reader readers",
    "share": "share sharing social follow buttons",
    "content": "content article post entry main story text body prose hentry richtext maincontent",
}
NAME_GROUP = {w: g for g, words in NAMES.items() for w in words.split()}
GROUPS = list(NAMES)


@dataclass
class Node:
    tag: str
    parent: int
    groups: frozenset
    texts: list = field(default_factory=list)  # (order, text)
    links: int = 0
    mixed: bool = False  # its names hold other words as well


def tree(page: str) -> list[Node]:
    """Block elements in document order, each with its parent's index and its own runs of text.

    Character references are decoded and white space inside a run is one space. Inline markup is part of
    the run, ``br`` is white space; a nested block ends a run. Missing end tags are implied as HTML has
    it; a stray end tag is ignored. Scripts, styles, comments, embedded media and parts with the attribute
    ``hidden`` have no text; formulas have theirs, and so does what an ``object`` holds in its place. A tag
    that the page breaks off is no text. The work grows with the page's length, whatever it holds.
    """
    nodes = [Node("html", -1, frozenset())]
    open_: list[tuple[str, int, bool]] = [("html", 0, False)]  # (tag, node or -1 for inline and hidden, unseen)
    owners = [0]  # the nodes among the open elements
    where: dict[str, list[int]] = {}  # the places of each tag among them, so that none is looked for
    blocks = [0]  # the places of blocks
    run: list[str] = []
    link = unseen = paragraphs = order = 0

    def flush() -> None:
        nonlocal order
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                nodes[owners[-1]].texts.append((order, text))
                order += 1

    def add(text: str) -> None:
        if unseen or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        run.append(text)
        if link:
            nodes[owners[-1]].links += len("".join(text.split()))

    def pop(down_to: int) -> None:
        nonlocal link, unseen, paragraphs
        while len(open_) > down_to:
            tag, node, dark = open_[-1]
            if node >= 0 or tag in BLOCK:
                flush()
            if node >= 0:
                owners.pop()
            link -= tag == "a"
            paragraphs -= tag == "p"
            unseen -= dark
            open_.pop()
            where[tag].pop()
            if blocks[-1] == len(open_):
                blocks.pop()

    def innermost(tags: frozenset) -> int:
        return max((places[-1] for t in tags if (places := where.get(t))), default=0)

    def nearest(tags: frozenset, beyond: frozenset) -> int:
        """The innermost open element of ``tags`` if none of ``beyond`` is inside it; 0 if there is none."""
        found = innermost(tags)
        return found if found and found > innermost(beyond) else 0

    at = begin = 0
    end = page.rfind(">") + 1  # no tag ends beyond
    token, unclosed = TOKEN, set()
    while (at := page.find("<", at)) >= 0:
        match = token.match(page, at)
        if match is None:
            if not STARTS.match(page, at):
                at += 1  # a character like any other
            elif at >= end:
                break  # a tag that the page breaks off
            else:
                token = PLAIN
            continue
        add(page[begin:at])
        at = begin = match.end()
        if match[2] is None:
            continue
        tag, attributes = match[2].lower(), match[3]
        if match[1]:
            depth = where[tag][-1] if where.get(tag) else 0
            if blocks[-1] > depth and tag not in BLOCK:
                depth = 0  # an inline end tag closes nothing beyond its block
            if depth:
                pop(depth)
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                add(" ")
            continue
        if tag in RAW:
            closing = None if tag in unclosed else RAW_END[tag].search(page, at, end)
            if closing is not None:
                at = begin = closing.end()
                continue
            if tag != "textarea":
                begin = len(page)  # the rest is inside it
                break
            unclosed.add(tag)
        if tag == "html" or (tag == "body" and where.get("body")):
            continue
        block = tag in BLOCK
        if block:
            if paragraphs and tag not in ("td", "th", "tr") and (depth := nearest(P, SCOPE)):
                pop(depth)
            flush()
        if tag in CLOSES:
            while depth := nearest(CLOSES[tag], SCOPE - CLOSES[tag]):
                pop(depth)
        groups, mixed, dark = NO_GROUPS, False, tag in UNSEEN
        if attributes:
            if not block and attributes.rstrip().endswith("/"):
                continue
            if "=" in attributes:
                words = NAME.findall(" ".join((a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(attributes)).lower())
                groups = frozenset(NAME_GROUP[w] for w in words if w in NAME_GROUP)
                mixed = bool(groups) and any(w not in NAME_GROUP for w in words)
            if "hidden" in attributes.lower() and HIDDEN.search(VALUE.sub(" ", attributes)):
                dark = True
        own = -1
        if not dark and (block or groups) and len(owners) < DEEPEST:
            flush()
            nodes.append(Node(tag, owners[-1], groups, mixed=mixed))
            own = len(nodes) - 1
            owners.append(own)
        where.setdefault(tag, []).append(len(open_))
        if own >= 0 or block:
            blocks.append(len(open_))
        open_.append((tag, own, dark))
        link += tag == "a"
        paragraphs += tag == "p"
        unseen += dark
    if at < 0:
        add(page[begin:])
    elif begin < at:
        add(page[begin:at])
    pop(1)
    flush()
    return nodes


P, NO_GROUPS = frozenset("p"), frozenset()
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+>", re.I) for tag in RAW}
#: Elements farther down stand for their ancestor at this depth, as browsers have it; their text is its.
DEEPEST = 512
VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)")
HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s/]|$)", re.I)
#: Blocks that hold text and no other blocks.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th".split())
STOP = re.compile(r"[.!?…](?: |$)")
BOUNDARY = frozenset("nav header footer aside form control section main article".split())
INSIDE = ("article", "main")
#: Features of a node besides its tag and its own and its ancestors' names.
FIGURES = 17
N_NODE = len(TAGS) + len(GROUPS) * 2 + FIGURES


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, parents, depths, and the kind of the edge to the parent (1: begins a section)."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    own = np.array([sum(len(t) for _, t in x.texts) for x in nodes], float)
    links = np.array([x.links for x in nodes], float)
    depth, edge = np.zeros(n, int), np.zeros(n, int)
    under, linked, paragraphs = own.copy(), links.copy(), np.array([x.tag == "p" for x in nodes], float)
    children = np.zeros(n)
    above: list[frozenset] = [frozenset()] * n
    inside = np.zeros((n, len(INSIDE)))
    for i in range(1, n):
        p = nodes[i].parent
        inside[i] = inside[p]
        if nodes[p].tag in INSIDE:
            inside[i, INSIDE.index(nodes[p].tag)] = 1
        depth[i] = depth[p] + 1
        children[p] += 1
        above[i] = above[p] | nodes[p].groups if nodes[p].groups else above[p]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        under[p] += under[i]
        linked[p] += linked[i]
        paragraphs[p] += paragraphs[i]
    total = max(1.0, under[0])
    x = np.zeros((n, N_NODE), np.float32)
    for i, node in enumerate(nodes):
        group = TAG_GROUP.get(node.tag, "other")
        x[i, TAGS.index(group)] = 1
        for g in node.groups:
            x[i, len(TAGS) + GROUPS.index(g)] = 1
        for g in above[i]:
            x[i, len(TAGS) + len(GROUPS) + GROUPS.index(g)] = 1
        edge[i] = group in BOUNDARY or bool(node.groups)
    text = ["".join(t for _, t in node.texts) for node in nodes]
    stops = np.array([len(STOP.findall(t)) for t in text], float)
    x[:, -FIGURES:] = np.stack(
        [
            np.ones(n),
            own == 0,
            np.minimum(np.log1p(own), 7) / 4,
            np.minimum(np.log1p(under), 9) / 4,
            links / np.maximum(own, 1),
            np.minimum(1, linked / np.maximum(under, 1)),
            np.minimum(stops, 5) / 3,
            [t.endswith((".", "!", "?", "…", ":", '"')) for t in text],
            np.minimum(np.log1p(paragraphs), 4) / 2,
            under / total,
            np.minimum(np.log1p(children), 4) / 2,
            ["©" in t for t in text],
            np.minimum(depth, 10) / 5,
            np.arange(n) / n,
            *inside.T,
            [node.mixed and node.tag in LEAVES for node in nodes],
        ],
        axis=1,
    )
    return x, parent, depth, edge


class Forest:
    """Trees of several pages side by side, so that messages of one depth are passed together."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        starts = np.cumsum([0, *[len(t[1]) for t in trees]])
        self.x = np.concatenate([t[0] for t in trees])
        self.parent = np.concatenate([np.where(t[1] < 0, -1, t[1] + s) for t, s in zip(trees, starts)])
        depth = np.concatenate([t[2] for t in trees])
        self.edge = np.concatenate([t[3] for t in trees])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        self.starts = starts

    def marginals(self, unary: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product, upward and downward: per node the log marginal of both states, and per node the
        joint probability of its parent's state and its own (0 for roots)."""
        up = np.stack([np.zeros_like(unary), unary], axis=1)  # belief from below, own potential included
        message = np.zeros_like(up)
        for level in self.levels[:0:-1]:
            reach = steps[self.edge[level]] + up[level][:, None, :]
            message[level] = _logsum(reach, 2)
            np.add.at(up, self.parent[level], message[level])
        down = up.copy()  # belief from everywhere
        joint = np.zeros((len(up), 2, 2))
        for level in self.levels[1:]:
            outside = down[self.parent[level]] - message[level]
            both = outside[:, :, None] + steps[self.edge[level]] + up[level][:, None, :]
            down[level] = _logsum(both, 1)
            joint[level] = np.exp(both - _logsum(_logsum(both, 2), 1)[:, None, None])
        return down - _logsum(down, 1)[:, None], joint


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class TreeModel:
    weights: np.ndarray
    steps: np.ndarray  # edge kind, parent state, child state

    def content(self, trees: list) -> list[np.ndarray]:
        """For each page's tree the marginal probability of content of every node."""
        forest = Forest(trees)
        belief, _ = forest.marginals((forest.x @ self.weights).astype(float), self.steps)
        return np.split(np.exp(belief[:, 1]), forest.starts[1:-1])


def fit(labelled: list[tuple[list[Node], np.ndarray]], rounds: int = 100) -> TreeModel:
    """Maximum likelihood of the nodes' labels, by Adam over all pages at once."""
    forest = Forest([features(nodes) for nodes, _ in labelled])
    y = np.concatenate([labels for _, labels in labelled]).astype(int)
    size = forest.x.shape[1]
    theta, m, v = np.zeros(size + 8), np.zeros(size + 8), np.zeros(size + 8)
    inner = forest.parent >= 0
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.edge[inner], y[forest.parent[inner]], y[inner]), 1)
    for k in range(1, rounds + 1):
        steps = theta[size:].reshape(2, 2, 2)
        belief, joint = forest.marginals((forest.x @ theta[:size].astype(np.float32)).astype(float), steps)
        expected = np.stack([joint[inner & (forest.edge == e)].sum(axis=0) for e in (0, 1)])
        grad = np.concatenate([forest.x.T @ (y - np.exp(belief[:, 1])), (seen - expected).ravel()]) - 0.5 * theta
        grad /= len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return TreeModel(theta[:size].astype(np.float32), theta[size:].reshape(2, 2, 2))


def text_of(nodes: list[Node], content: np.ndarray) -> str:
    """The runs of text of content nodes, in page order."""
    runs = [t for node, p in zip(nodes, content) if p >= 0.5 for t in node.texts]
    return "\n".join(t for _, t in sorted(runs))


def extract_main_text(
    pages: DataFrame, model: TreeModel, html_col: str = "html", text_col: str = "main_text"
) -> DataFrame:
    """``pages`` with the main text of each: blocks of content joined by line feeds, empty if none.

    A null or empty page has an empty text. Whole pages are read whatever their length. Rows are
    independent: repeated rows come back alike, an empty table stays empty, all columns are passed
    through, and one that is called like the text is replaced. No shuffle.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = pages.drop(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())])
    at = kept.columns.index(html_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or "" for t in batch.column(at).to_pylist()]
            texts = []
            for a, b in parts(raw):
                trees = [tree(page) for page in raw[a:b]]
                found = shared.value.content([features(t) for t in trees])
                texts += [text_of(t, p) for t, p in zip(trees, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return kept.mapInArrow(extract, schema)
