"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that no kept node lies in a dropped one."""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.html_training import training_pages

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; the first two hold no markup either.
RAW = frozenset("script style".split())
MUTE = frozenset("head noscript template iframe svg math canvas object audio video select textarea button title datalist".split())
#: A start tag of these ends an open element of these, up to one of these.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
GOOD_TOKENS = frozenset("article body content entry main post story text".split())
BAD_TOKENS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc tabs topbar toolbar sitemap".split(),
    "frame": "header footer masthead copyright legal bottom top credits colophon".split(),
    "side": "aside sidebar side widget rail related recommended popular trending more teaser".split(),
    "advert": "ad ads advert advertisement adsense banner promo sponsor sponsored sponsors".split(),
    "notice": "alert consent cookie cookies gdpr modal notice notification overlay popup warning privacy".split(),
    "form": "form login search signup subscribe newsletter register contact".split(),
    "comment": "comment comments disqus discussion reply replies respond responses feedback thread".split(),
    "share": "share sharing social follow tags meta byline author tools".split(),
}
_GROUP = {t: i for i, ts in enumerate(BAD_TOKENS.values()) for t in ts}
_TAGS = ("#text", "p", "h1", "h2", "h3", "li", "ul", "ol", "div", "section", "article", "main", "body", "html", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "dl")
_TAG = {t: i for i, t in enumerate(_TAGS)}
#: Ancestors a node knows of.
_ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form")
_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)>?)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_SPLIT = re.compile(r"[^a-z]+")
#: A block's end tag reaches no further than these.
_CELLS = ("table", "td", "th", "template")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    place: int  # among siblings
    good: int = 0
    bad: int = 0  # bits of BAD_TOKENS
    above: int = 0  # bits of _ABOVE, this node's own tag not counted
    above_bad: int = 0
    mute: bool = False
    text: list[str] = field(default_factory=list)
    kids: list[int] = field(default_factory=list)
    chars: int = 0
    links: int = 0
    marks: int = 0
    tags: int = 0
    leaves: int = 0


def _tokens(attrs: str) -> tuple[int, int, bool]:
    good = bad = 0
    hidden = False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            for t in _SPLIT.split(value.lower()):
                if t in _GROUP:
                    bad |= 1 << _GROUP[t]
                elif t in GOOD_TOKENS:
                    good = 1
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value.lower())):
            hidden = True
    return good, bad, hidden


def parse(page: str | None) -> list[Node]:
    """Block elements and the runs of text between them, in page order; a parent comes before its children. Inline elements
    only count in the run that they stand in. Tags may be missing or wrongly nested."""
    page = page or ""
    nodes = [Node("html", -1, 0, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; an inline one has its block's node
    places: dict[str, list[int]] = {}  # of open elements in the stack, by name, and of open blocks
    tops: list[int] = []
    run, link, at, end = -1, 0, 0, len(page)

    def add(tag: str, attrs: str = "") -> int:
        up = stack[-1][1]
        p = nodes[up]
        n = Node(tag, up, p.depth + 1, len(p.kids), above=p.above | (1 << _ABOVE.index(p.tag) if p.tag in _ABOVE else 0), above_bad=p.above_bad | p.bad, mute=p.mute)
        if attrs and not attrs.isspace():
            n.good, n.bad, hidden = _tokens(attrs)
            n.mute |= hidden
        p.kids.append(len(nodes))
        nodes.append(n)
        return len(nodes) - 1

    def words(s: str) -> None:
        nonlocal run
        if run < 0:
            if s.isspace():
                return
            run = add("#text")
        n = nodes[run]
        if "&" in s:
            s = html.unescape(s)
        n.text.append(s)
        if not s.isspace():
            size = len(s)
            n.chars += size
            n.links += size if link else 0
            n.marks += s.count(",") + s.count(".")

    def push(name: str, node: int) -> None:
        places.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            tops.append(len(stack))
        stack.append((name, node))

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(to: int) -> None:
        nonlocal run, link
        for name, _ in reversed(stack[to:]):
            places[name].pop()
            link -= name == "a"
            if name in BLOCKS:
                tops.pop()
            if name in BLOCKS or name in MUTE:
                run = -1
        del stack[to:]

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            words(page[at:stop])
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            i, barrier = last((name,)), last(_CELLS) if name in BLOCKS else tops[-1] if tops else 0
            if i and i >= barrier:
                close(i)
            continue
        nodes[stack[-1][1]].tags += 1
        if name in RAW:
            low = re.compile(f"</{name}", re.I).search(page, at)
            at = low.start() if low else end
            continue
        if name == "br":
            if run >= 0:
                nodes[run].text.append(" ")
            continue
        if name in BLOCKS:
            run = -1
            if name == "html":
                nodes[0].good, nodes[0].bad, _ = _tokens(m[3])
                continue
            rule = IMPLIED.get(name)
            if rule:
                barrier = last(rule[1])
                found = [at[k] for at in (places.get(n, ()) for n in (*rule[0], "p")) if (k := bisect(at, barrier)) < len(at)]
                if found:
                    close(min(found))
            elif tops and stack[tops[-1]][0] in (("p", "head") if name == "body" else ("p",)):
                close(tops[-1])
            if name in VOID:
                continue
            push(name, add(name, m[3]))
            nodes[stack[-1][1]].mute |= name in MUTE
        elif name not in VOID:
            if name in MUTE:
                if m[3].endswith("/"):
                    continue
                run = -1
                push(name, i := add(name, m[3]))
                nodes[i].mute = True
            else:
                push(name, stack[-1][1])
                link += name == "a"
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], nodes[nodes[i].parent]
        if n.mute:
            n.chars = n.links = n.marks = n.leaves = 0
            continue
        n.leaves += n.tag == "#text"
        p.chars += n.chars
        p.links += n.links
        p.marks += n.marks
        p.tags += n.tags
        p.leaves += n.leaves
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """A row a node: its tag, depth, attribute tokens, those above, density of its subtree, and how it stands among its siblings."""
    total = max(nodes[0].chars, 1)
    before = 0
    starts = []
    for n in nodes:
        starts.append(before)
        before += n.chars if n.tag == "#text" else 0
    rows = []
    groups = range(len(BAD_TOKENS))
    for i, n in enumerate(nodes):
        p = nodes[n.parent] if n.parent >= 0 else n
        chars = max(n.chars, 1)
        kin = len(p.kids) or 1
        prev = nodes[p.kids[n.place - 1]].chars if i and n.place else 0
        after = nodes[p.kids[n.place + 1]].chars if i and n.place + 1 < len(p.kids) else 0
        rows.append(
            (
                _TAG.get(n.tag, len(_TAGS)), _TAG.get(p.tag, len(_TAGS)), n.depth, n.good, p.good, n.bad.bit_count(), n.above_bad.bit_count(),
                *[n.bad >> g & 1 for g in groups], *[n.above_bad >> g & 1 for g in groups], *[n.above >> g & 1 for g in range(len(_ABOVE))],
                n.chars, n.links / chars, n.marks / chars, n.tags / chars, n.leaves, n.chars / max(n.leaves, 1), n.chars / total, n.chars / max(p.chars, 1),
                starts[i] / total, n.place, kin, n.place / kin, prev, after, p.chars / kin, p.links / max(p.chars, 1), p.marks / max(p.chars, 1),
            )
        )
    return np.array(rows, np.float32)


@dataclass
class Boosted:
    """Trees as arrays: column, threshold and left child of each node (right is left + 1; a leaf is its own child), and values."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for column, cut, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                go = left[at]
                at = np.where(go == at, at, go + (x[rows, column[at]] > cut[at]))
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 3.0) -> Boosted:
    """Gradient boosting with logistic loss: Newton gains over histograms of quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    z, made = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        column, cut, left, value = [0], [0.0], [0], [0.0]
        live = {0: np.arange(len(y))}
        for level in range(depth + 1):
            grown = {}
            for node, rows in live.items():
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = rate * gs / (hs + ridge)
                if level == depth or len(rows) < 2:
                    continue
                best = (1e-6, -1, -1)
                for j, c in enumerate(cuts):
                    if len(c):
                        gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(hl < least) | (hs - hl < least)] = 0
                        if gain[k := int(gain.argmax())] > best[0]:
                            best = (float(gain[k]), j, k)
                if best[1] >= 0:
                    _, j, k = best
                    column[node], cut[node], left[node] = j, float(cuts[j][k]), len(value)
                    right = binned[rows, j] > k
                    grown[len(value)], grown[len(value) + 1] = rows[~right], rows[right]
                    column += [0, 0]
                    cut += [0.0, 0.0]
                    left += [len(value), len(value) + 1]
                    value += [0.0, 0.0]
            live = grown
        tree = (np.array(column), np.array(cut, np.float32), np.array(left), np.array(value))
        made.append(tree)
        z = z + Boosted(0.0, [tree], depth).logits(x)
    return Boosted(base, made, depth)


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """The best set of kept nodes that holds, with each node, all above it: a node's gain is its log odds and the gains of the
    children that are worth keeping; from the root down, a node is kept if its gain is positive and its parent is kept."""
    gain = [-1e9 if n.mute or not n.chars else float(z) for n, z in zip(nodes, logits, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = [gain[0] > 0]
    for i in range(1, len(nodes)):
        kept.append(kept[nodes[i].parent] and gain[i] > 0)
    return kept


def main_text(nodes: list[Node], kept: list[bool]) -> str:
    """Text of the kept runs in page order: one space between blocks and for white space inside."""
    return " ".join(" ".join(["".join(n.text) for n, k in zip(nodes, kept, strict=True) if k and n.text]).split())


def train(pages: int = 500, seed: int = 5) -> Boosted:
    """Fitted on generated pages, in which the main text is marked by construction. A node is main if main text is below it."""
    xs, ys = [], []
    for page in training_pages(pages, seed):
        nodes = parse(page)
        y = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].text:
                marked = "".join(nodes[i].text)
                y[i] = "␂" in marked
                for k in range(len(nodes[i].text)):
                    nodes[i].text[k] = nodes[i].text[k].replace("␂", "")
            if i and y[i]:
                y[nodes[i].parent] = 1
        live = np.array([n.chars > 0 and not n.mute for n in nodes])
        xs.append(features(nodes)[live])
        ys.append(y[live])
    return boost(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", model: Boosted | None = None) -> DataFrame:
    """A row a page: page_id, url, text (empty if none), n_chars.

    Null or empty html: empty. No length or number of nodes is capped. Repeated rows: each its own. Null ids and urls: kept.
    Empty table: no rows. Other columns are ignored. No shuffle; nodes of 64 pages are scored at once.
    """
    model = model or train()
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                trees = [parse(p) for p in b.column(2).to_pylist()]
                logits = np.split(model.logits(np.concatenate([features(t) for t in trees])), np.cumsum([len(t) for t in trees])[:-1])
                texts = [main_text(t, decode(t, z)) for t, z in zip(trees, logits, strict=True)]
                cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    kinds = dict(own.dtypes)
    out = own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": page_id, "url": url})
