"""Main-text extraction from HTML by minimum-cut labelling.

A page is read into blocks, the runs of text between block-level tags.  A
linear classifier over a block's ancestors, links and wording gives the log-odds
of content; softplus costs of either label become the capacities of the block's
terminal edges.  What an element's tag or name says counts for all that it holds, but
not for wrappers of a page: where elements that look like boilerplate leave hardly any prose
outside them, the one with most of it is taken for a wrapper, and only what is named within it
counts.  Siblings of one shape that each hold a short line beside sentences (a name, a date, a link to
answer) are records, such as readers' comments.  Neighbours in page order and blocks of the same parent are tied
by smoothness edges, the weaker the farther apart they stand in the tree.  The
maximum flow between the terminals separates content from boilerplate.

Text of scripts, styles, comments and other unseen elements never is a block.
Character references are decoded, white space inside a block becomes one space,
and content blocks are joined in page order by one space.

A null or empty page has the empty text.  A page cut off inside a tag, a comment
or a script ends there.  Pages are handled one by one where they are read.
"""

from __future__ import annotations

import heapq
import html as _html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .common import ship, table

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Elements whose content isn't seen as text, up to their end tag.
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby",
    "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "link", "meta",
}
#: A new one of these closes an open one (the value), unless a container lies between.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "body", "div", "section", "article", "select"}

_BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head"}
_BOILER_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "adslot", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent",
    "cookie", "cookies", "copyright", "disclaimer", "disqus", "dropdown", "footer", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets", "alert", "contentinfo",
    "complementary", "search",
}
_CONTENT_NAMES = {"article", "content", "entry", "main", "post", "story", "body", "text"}

#: Elements that never are wrappers of a page.
_NEVER_WRAPS = {"nav", "footer", "aside", "menu", "dialog", "button", "select", "head"}
#: Words of a block of prose; words of prose that a page has outside what looks like boilerplate, at most and as a share.
PROSE_WORDS, OUTSIDE, OUTSIDE_SHARE = 8, 25, 0.2
#: Words of a short line, and siblings that make a series of records.
SHORT_WORDS, RECORDS = 5, 3

#: Log-odds of content: the classifier's weights.
WEIGHTS = {
    "bias": -0.6, "article": 3.0, "content_name": 1.2, "boiler": -9.0, "hidden": -9.0, "record": -6.0, "link_share": -4.0, "words": 0.9, "stops": 0.5, "paragraph": 0.8, "heading": 0.5, "list": -0.4,
}
#: Smoothness between neighbours a tree step apart, and between siblings.
ADJACENT, SIBLING = 1.2, 0.8
#: The log-odds that the likeliest block of a page has at least.
LIKELY = 1.5
_SCALE = 1000


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    article: bool = False
    content: bool = False
    hidden: bool = False
    #: What the element's own tag or names say; boiler and record hold for all within, once judged.
    named: bool = False
    shape: str = ""
    boiler: bool = False
    record: bool = False


@dataclass
class Block:
    parent: Node
    tag: str
    text: str
    link_chars: int
    log_odds: float = field(default=0.0)


def _node(tag: str, attributes: str, parent: Node | None) -> Node:
    n = Node(tag, parent, parent.depth + 1 if parent else 0)
    if parent:
        n.article, n.content, n.hidden = parent.article, parent.content, parent.hidden
    main = tag in ("article", "main")
    n.named, n.shape = tag in _BOILER_TAGS, tag
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role"):
                words = {w.lower() for w in _NAMES.findall(value)}
                if tag not in ("html", "body"):  # their names are about the page as a whole
                    n.named |= bool(words & _BOILER_NAMES)
                    n.content |= bool(words & _CONTENT_NAMES)
                main |= name == "role" and bool(words & {"article", "main"})
                if name == "class":
                    n.shape = f"{tag}.{value}"
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                n.hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                n.hidden = True
    n.article |= main
    n.named &= not main  # the names of the main element are about its style
    return n


def _words(b: Block) -> int:
    return b.text.count(" ") + 1


def _links(b: Block) -> float:
    return min(1.0, b.link_chars / max(1, len(b.text)))


def judge(blocks: list[Block]) -> None:
    """Say of every element that holds text whether it is boilerplate or one of a series of records."""
    nodes: dict[int, Node] = {}
    for b in blocks:
        n = b.parent
        while n is not None and id(n) not in nodes:
            nodes[id(n)] = n
            n = n.parent
    # inline elements stand as deep as their parents, so a parent's place is never behind its child's
    order = sorted(nodes.values(), key=lambda n: n.depth)
    plain = [b for b in blocks if not b.parent.hidden and _links(b) < 0.5]
    main = [b for b in plain if b.parent.article]  # a page that says where its article is has nothing else to save
    prose = main or [b for b in plain if _words(b) >= PROSE_WORDS] or plain
    own: dict[int, int] = {}
    short, said = set(), set()
    for b in blocks:
        k = id(b.parent)
        if _words(b) <= SHORT_WORDS and b.text[-1] not in ".!?:" and b.tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            short.add(k)
    for b in plain:
        if _words(b) > SHORT_WORDS and b.text[-1] in ".!?\"'":
            said.add(id(b.parent))
    for b in prose:
        own[id(b.parent)] = own.get(id(b.parent), 0) + _words(b)
    total = sum(own.values())
    series: dict[tuple[int, str], list[Node]] = {}
    for n in reversed(order):
        if n.parent is None:
            continue
        k, above = id(n), id(n.parent)
        own[above] = own.get(above, 0) + own.get(k, 0)
        if k in short and k in said and n.tag not in _INLINE:
            series.setdefault((above, n.shape), []).append(n)
        for kind in (short, said):
            if k in kind:
                kind.add(above)
    for held in series.values():
        if len(held) >= RECORDS:
            for n in held:
                n.record = True

    # wrappers: outermost named elements first
    within: dict[int, list[Node]] = {}
    above: dict[int, int] = {}
    for n in order:
        up = above.get(id(n.parent), 0) if n.parent is not None else 0
        above[id(n)] = up
        if n.named:
            within.setdefault(up, []).append(n)
            above[id(n)] = id(n)
    spared: set[int] = set()
    outer = [(-own.get(id(n), 0), k, n) for k, n in enumerate(within.get(0, []))]
    outside, need = total + sum(x for x, *_ in outer), 1 if main else min(OUTSIDE, OUTSIDE_SHARE * total)
    outer = [x for x in outer if x[2].tag not in _NEVER_WRAPS]
    heapq.heapify(outer)
    while outer and outside < need and outer[0][0] < 0:
        words, _, n = heapq.heappop(outer)
        spared.add(id(n))
        inner = within.get(id(n), [])
        outside += -words - sum(own.get(id(x), 0) for x in inner)
        for x in inner:
            if x.tag not in _NEVER_WRAPS:
                heapq.heappush(outer, (-own.get(id(x), 0), len(spared) * len(nodes) + len(outer), x))
    for n in order:
        n.boiler = n.named and id(n) not in spared
        if n.parent is not None:
            n.boiler |= n.parent.boiler
            n.record |= n.parent.record


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, without labels."""
    root = Node("", None, 0)
    stack, out = [root], []
    # where in the stack the elements of a tag, the limits of implied ends, and what isn't inline are: no search is longer than what it removes
    open_: dict[str, list[int]] = {}
    limits: list[int] = []
    solid = [0]
    pieces: list[str] = []
    links = link_chars = 0
    at, end = 0, len(page)

    def shut(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag = stack.pop().tag
            open_[tag].pop()
            if tag in _SCOPE or tag in _BOILER_TAGS:
                limits.pop()
            if tag not in _INLINE:
                solid.pop()
            links -= tag == "a"

    def close() -> None:
        nonlocal pieces, link_chars
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = _html.unescape(text)
            text = " ".join(text.split())
            if text:
                k = solid[-1]
                out.append(Block(stack[k], stack[k].tag, text, link_chars))
        pieces, link_chars = [], 0

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            pieces.append(page[at:stop])
            if links:
                link_chars += stop - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if not (m[2] or page[at - 1 : at] == ">"):
            break  # cut off inside a tag
        closing = m[1] or m[4]
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in _INLINE and tag not in _RAW:
            close()
        if closing:
            if open_.get(tag):
                shut(open_[tag][-1])
            continue
        attributes = m[3] or m[6] or ""
        if tag in _RAW and not attributes.endswith("/"):
            finish = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = finish.end() if finish else end
            continue
        if tag in _VOID:
            continue
        if tag == "p" or tag in _CLOSES:
            k = max((open_[x][-1] for x in _CLOSES.get(tag, {"p"}) if open_.get(x)), default=0)
            if k and k > (limits[-1] if limits else 0):
                shut(k)
        if tag in _INLINE and not attributes.strip():
            node = Node(tag, stack[-1], stack[-1].depth, *(getattr(stack[-1], x) for x in ("article", "content", "hidden")))
        else:
            node = _node(tag, attributes, stack[-1])
        open_.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE or tag in _BOILER_TAGS:
            limits.append(len(stack))
        if tag not in _INLINE:
            solid.append(len(stack))
        stack.append(node)
        links += tag == "a"
    close()
    judge(out)
    return out


def log_odds(b: Block) -> float:
    n, w, words = b.parent, WEIGHTS, _words(b)
    stops = b.text.count(". ") + b.text.count(", ") + (b.text[-1] in ".!?")
    return (
        w["bias"]
        + w["article"] * n.article
        + w["content_name"] * n.content
        + w["boiler"] * n.boiler
        + w["hidden"] * n.hidden
        + w["record"] * n.record
        + w["link_share"] * _links(b)
        + w["words"] * min(2.0, math.log2(1 + words) / 4)
        + w["stops"] * min(2.0, math.log2(1 + stops))
        + w["paragraph"] * (b.tag in ("p", "blockquote", "pre"))
        + w["heading"] * (b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
        + w["list"] * (b.tag in ("li", "td", "th", "dd", "dt", "option"))
    )


def _steps_apart(a: Node, b: Node) -> int:
    """Steps in the tree from a to b; no more are counted than give an edge any capacity."""
    n = 0
    while a is not b and n < 2 * _SCALE * ADJACENT:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        else:
            break
        n += 1
    return n


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; edges bind both ways.  Dinic's algorithm."""
    n = len(source)
    rest = [a - b for a, b in zip(source, sink, strict=True)]  # flow that goes straight through a node is spent
    if not any(x > 0 for x in rest) or not any(x < 0 for x in rest):
        return [x > 0 for x in rest] if not edges else [any(x > 0 for x in rest)] * n
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def add(a: int, b: int, c: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(c)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(rest):
        if x > 0:
            add(s, i, x, 0)
        elif x < 0:
            add(i, t, -x, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] == 0)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[v] < len(head[v]):
                e = head[v][at[v]]
                if room[e] > 0 and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                    break
                at[v] += 1
            else:
                if v == s:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]


def labels(blocks: list[Block]) -> list[bool]:
    """True for content."""
    source, sink, edges = [], [], []
    last: dict[int, int] = {}
    for b in blocks:
        b.log_odds = log_odds(b)
    # a page that has anything to read has content: its likeliest block, if none is likely
    free = [b for b in blocks if not (b.parent.boiler or b.parent.hidden or b.parent.record) and _links(b) < 0.5]
    lift = max(0.0, LIKELY - max((b.log_odds for b in free), default=LIKELY))
    for b in free:
        b.log_odds += lift
    for i, b in enumerate(blocks):
        x = b.log_odds
        source.append(round(_SCALE * math.log1p(math.exp(min(x, 50.0)))))  # the cost of calling it boilerplate
        sink.append(round(_SCALE * math.log1p(math.exp(min(-x, 50.0)))))
        if i:
            edges.append((i - 1, i, round(_SCALE * ADJACENT / (1 + _steps_apart(blocks[i - 1].parent, b.parent)))))
        above = id(b.parent.parent or b.parent)
        if above in last and last[above] != i - 1:
            edges.append((last[above], i, round(_SCALE * SIBLING)))
        last[above] = i
    return min_cut(source, sink, edges) if blocks else []


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    return " ".join(b.text for b, keep in zip(blocks, labels(blocks), strict=True) if keep)


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars (replaced if there, whatever case)."""
    ship(pages.sparkSession)
    rest = [c for c in pages.columns if c.lower() not in (column.lower(), "text", "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.steps(batches, column):
            text = [main_text(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*rest, "text", "n_chars"])

    return pages.select(*rest, F.col(column)).mapInArrow(run, schema)


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
