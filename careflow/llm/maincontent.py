"""Main text of web pages by minimum cut.

A page is read into blocks of text. A classifier gives each block a cost of being called content and one of being called
boilerplate; these are the capacities from the source and to the sink. Blocks that follow each other, or that are
siblings in the tree, are joined by smoothness edges, stronger the nearer they are in the tree. The minimum cut between
source and sink is the cheapest labelling, and a maximum flow finds it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments (``<!-->`` is a whole one), declarations, tags, text. A quote counts only behind the ``=`` of an attribute, and
#: only if it is closed, so an apostrophe in a tag hides nothing.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|\Z)|[^<]+|<",
    re.S,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
HIDDEN = frozenset(
    "script style noscript template svg canvas iframe object math select option datalist textarea button head title".split()
)
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul hr".split()
)
CLOSES = {  # an opening tag ends these, if they are open, up to the nearest of the bounds
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"body", "html", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}

CONTENT_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog".split())
CONTENT_NAMES = re.compile(r"article|content|entry|post(?!er)|story|main|body(?:$|-)|text", re.I)
BOILER_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|popup|modal|cookies?|consent|gdpr|notice|alert|nav\w*|menu\w*|"
    r"breadcrumbs?|pagination|pager|side-?bar|widgets?|related|recommend\w*|share|sharing|social|toolbar|footer|foot|"
    r"masthead|site-?header|top-?bar|comment\w*|disqus|repl(?:y|ies)|respond|discussion|newsletter|subscribe|signup|login|"
    r"search|form|tags?|copyright|legal|disclaimer|outbrain|taboola)(?:$|[-_\s\d])",
    re.I,
)
COMMENT_NAMES = re.compile(r"comment|disqus|repl(?:y|ies)|respond|discussion", re.I)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())


@dataclass
class Node:
    tag: str
    parent: Node | None
    boiler: bool = False  # whether it, or what it lies in, looks like boilerplate
    comments: bool = False  # and that is a section of comments
    content: int = 0  # how many of the elements from the root down to this one look like content
    hidden: bool = False


@dataclass
class Block:
    text: str
    node: Node
    link_chars: int = 0
    near: float = 0.0  # to the block before: 1 for children of one element, less with every level to the common ancestor


class Open:
    """The open elements, from the root down, with the places of each tag and of the block elements among them.

    ``before`` is the place that the last written block's element had; of the elements there are now, the first ``least``
    have been open since.
    """

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, [0]
        self.before, self.least = 0, 1

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tag: str) -> int:
        """Place of the innermost element of this tag, 0 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def cut(self, place: int) -> list[Node]:
        """Close everything from ``place`` on."""
        gone = self.nodes[place:]
        del self.nodes[place:]
        for node in reversed(gone):
            self.places[node.tag].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()
        self.least = min(self.least, place)
        return gone

    def take_out(self, place: int) -> None:
        """Close one element; what was inside goes on without it."""
        least = self.least
        for node in self.cut(place)[1:]:
            node.parent = self.nodes[-1]
            self.push(node)
        if least > place:  # it was above the last block, which is now one level higher
            self.least, self.before = least - 1, self.before - (self.before > place)


def _element(tag: str, attributes: str, parent: Node | None) -> Node:
    node = Node(tag, parent)
    if parent:
        node.boiler, node.comments = parent.boiler, parent.comments
        node.content, node.hidden = parent.content, parent.hidden
    hidden, boiler, content = tag in HIDDEN, tag in BOILER_TAGS, tag in CONTENT_TAGS
    if tag == "header" and not node.content:  # the header of an article is part of it
        boiler = True
    if attributes:
        for name, value in NAMES.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id") and tag not in ("body", "html"):
                if BOILER_NAMES.search(value):
                    boiler = True
                    node.comments |= bool(COMMENT_NAMES.search(value))
                elif CONTENT_NAMES.search(value):
                    content = True
            elif name == "role":
                boiler |= value.lower() in BOILER_ROLES
                content |= value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    node.hidden |= hidden
    if tag in CONTENT_TAGS and not boiler and not node.comments:
        node.boiler = False  # a page's main part can lie in an element with a misleading name
    if boiler:
        node.boiler = True
    elif content:
        node.content += 1
    return node


def blocks(page: str | None) -> list[Block]:
    """Blocks of visible text in page order, character references decoded and white space made single spaces.

    Unclosed and wrongly nested tags are read as browsers roughly do: a block tag ends an open paragraph, a closing tag
    without an opening one is ignored, and the end of the page closes everything.
    """
    out: list[Block] = []
    root = Node("#page", None)
    stack, pieces, links = Open(root), [], [0, 0]  # links: open anchors, characters in anchors

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                at = stack.blocks[-1]
                # what has been open since the last block is above both
                common = min(at, stack.before, stack.least - 1)
                near = 1 / (1 + max(0, max(at, stack.before) - common - 1)) if out else 0.0
                out.append(Block(text, stack.nodes[at], min(links[1], len(text)), near))
                stack.before, stack.least = at, len(stack.nodes)
            pieces.clear()
        links[1] = 0

    def close(place: int) -> None:
        flush()
        links[0] -= sum(n.tag == "a" for n in stack.cut(place))

    page, at = page or "", 0
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                if not stack.nodes[-1].hidden:
                    pieces.append(text)
                    if links[0] > 0:
                        links[1] += len(" ".join(text.split()))
            continue
        tag, closing = tag.lower(), m.group(1)
        if closing:
            place = stack.last(tag)
            if tag in BLOCK:
                if place:
                    close(place)
            elif tag not in VOID:
                if tag in HIDDEN:
                    flush()
                if place > stack.blocks[-1]:
                    if tag == "a":
                        links[0] -= 1
                    stack.take_out(place)
            continue
        if tag in BLOCK:
            flush()
            if stack.last("head"):
                close(stack.last("head"))
            if tag in ENDS_P and stack.last("p") and stack.last("p") == stack.blocks[-1]:
                close(stack.last("p"))
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                place = max(map(stack.last, ends))
                if place > max(map(stack.last, bounds)):
                    close(place)
        elif tag == "br":
            pieces.append(" ")
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCK:
            continue
        if tag in HIDDEN and not stack.nodes[-1].hidden:
            pieces.append(" ")
        stack.push(_element(tag, m.group(3), stack.nodes[-1]))
        if tag == "a":
            links[0] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def content_cost(block: Block, first_heading: bool) -> float:
    """Log-odds of content against boilerplate; positive speaks for content."""
    node, n = block.node, len(block.text)
    z = 0.4 + min(n, 400) / 200
    z -= 4.0 * block.link_chars / n
    z += -7.0 if node.boiler else 3.0 * min(node.content, 2)
    if re.search(r"[.!?…。]", block.text):
        z += 0.4
    if node.tag in ("h1", "h2", "h3"):
        z += 0.8 if first_heading or node.content else 0.3
    if re.search(r"©|\(c\) \d{4}|all rights reserved|cookies? policy|(?:accept|uses?) (?:all )?cookies", block.text, re.I):
        z -= 3.0
    return z


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: the labelling of least cost, by augmenting along shortest paths (Dinic).

    ``gain`` is the log-odds of content: positive as capacity from the source, negative as capacity to the sink.
    """
    n = len(gain)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, forward: float, backward: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forward)
        heads[b].append(len(to))
        to.append(a)
        room.append(backward)

    for k, z in enumerate(gain):
        if z > 0:
            arc(source, k, z, 0.0)
        elif z < 0:
            arc(k, sink, -z, 0.0)
    for a, b, c in edges:
        arc(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, [source]
        for a in queue:
            for e in heads[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(heads[a]):
                e = heads[a][turn[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_text(page: str | None, smoothness: float = 0.6) -> str:
    """The blocks that the cut leaves with the source, joined by spaces."""
    found = blocks(page)
    if not found:
        return ""
    gain, headed = [], False
    for b in found:
        first = b.node.tag == "h1" and not headed
        headed |= first
        gain.append(content_cost(b, first))
    if all(z > 0 for z in gain):
        return " ".join(b.text for b in found)
    edges, last = [], {}
    for k, b in enumerate(found):
        if k:
            edges.append((k - 1, k, smoothness * b.near))
        parent = id(b.node.parent)
        if parent in last and last[parent] != k - 1:  # the sibling before, past what lies between
            edges.append((last[parent], k, smoothness / math.sqrt(k - last[parent])))
        last[parent] = k
    kept = min_cut(gain, edges)
    return " ".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract_main_text(pages: DataFrame, smoothness: float = 0.6) -> DataFrame:
    """page_id, url, text, n_chars (code points); one row per page, from the whole html.

    A null or empty page, or one without visible text, has an empty text. Blocks that the cut keeps are whole. Null ids
    and urls stay null, repeated rows are extracted each, other columns are not looked at, an empty table gives an empty
    result. Reading a page takes time in proportion to its length, however deep its elements lie in each other.
    """

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([main_text(x, smoothness) for x in part], dtype="object")

    text = F.pandas_udf(extract, "string")
    found = pages.select("page_id", "url", text("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
