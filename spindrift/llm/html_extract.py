"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A classifier gives each block a cost of being content and a cost of being boilerplate,
which become the capacities of its edges to the two terminals. Edges between neighbours in the page, and between
blocks that stand next to each other in one DOM element, make it costly to label them differently. The minimum cut is the cheapest labelling; max-flow
finds it, and blocks that the source still reaches are content.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import rows_of

#: Elements whose text is never shown, void elements, elements that begin a block, those that a new one ends.
HIDDEN = {"script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "object", "select", "math", "canvas", "noembed", "noframes", "datalist"}
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What an element that ends by itself can't reach beyond.
FENCES = {"ul", "ol", "table", "div", "article", "section", "body", "main", "aside", "nav", "header", "footer", "form", "dl", "blockquote", "td", "th", "li"}
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
BAD_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "fieldset", "search"}
GOOD_TAGS = {"article", "main"}
#: Words in class, id and role that mark what isn't the article, and what is.
BAD_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "banner", "sponsor", "sponsored", "promo", "promoted", "promotion", "sidebar", "side", "aside", "rail", "widget", "nav", "navbar", "navigation",
    "menu", "submenu", "breadcrumb", "breadcrumbs", "crumbs", "footer", "foot", "header", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr",
    "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "search", "searchbox", "copyright",
    "contentinfo", "complementary", "form", "skip", "tags", "tagcloud", "legal", "disclaimer", "hidden",
}
#: Those of them that an article's own parts are called by, too.
OF_ARTICLES = {"header", "masthead", "tags", "side", "foot", "form", "text"}
GOOD_WORDS = {"article", "articlebody", "main", "content", "entry", "post", "story", "body", "text"}
#: Names that begin with these say what an element has, or how it is filed or laid out, not what it is.
QUALIFIERS = {"has", "no", "with", "without", "category", "cat", "tag", "type", "status", "format", "layout", "is"}
#: Of BAD_WORDS, those that articles and main elements are given for what stands beside them.
BESIDES = OF_ARTICLES | {"sidebar", "nav", "navbar", "navigation", "menu", "footer", "banner", "social", "share", "sharing", "search", "widget", "hidden", "legal", "notice"}
#: Where a tag, a comment or a declaration begins, and what ends it or begins a quoted value in it.
OPENS = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOPS = re.compile(r"[>\"']")
#: Tags whose quotes aren't closed before the page ends; after so many, quotes are passed over, as each costs a look at all the rest.
UNQUOTED = 8
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}
#: Capacities between neighbours, and between blocks of one parent.
NEXT, SIBLING = 0.5, 2.0


class _Node:
    __slots__ = ("bad", "good", "hidden", "hint", "inner", "link", "number", "outer", "tag")

    def __init__(self, tag: str, number: int, parent: _Node | None, attributes: str):
        self.tag, self.number = tag, number
        #: The numbers of the innermost block element, this one included, and of the one around that.
        self.inner, self.outer = (parent.inner, parent.outer) if parent and tag not in BLOCKS else (number, parent.inner if parent else -1)
        self.bad = self.good = self.hidden = self.hint = self.link = False
        if parent:
            self.bad, self.good, self.hidden, self.hint, self.link = parent.bad, parent.good, parent.hidden, parent.hint, parent.link
        self.hidden |= tag in HIDDEN
        self.link |= tag == "a"
        self.bad |= tag in BAD_TAGS or (tag == "header" and not self.good)
        words: set[str] = set()
        if "=" in attributes or "hidden" in attributes:
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                value, name = a or b or c, name.lower()
                if name == "style":
                    self.hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif name == "hidden":
                    self.hidden = True
                elif name == "aria-hidden":
                    self.hidden |= value.lower() == "true"
                else:
                    for token in value.split():
                        own = [w.lower() for w in WORD.findall(token)]
                        words.update(own if own and own[0] not in QUALIFIERS else ())
        bad = words & BAD_WORDS
        if tag in GOOD_TAGS:
            self.bad |= bool(bad - BESIDES)  # a reader's comment, a teaser or an advert may be an article, too
            self.good = not self.bad
        elif tag not in ("body", "html"):
            self.bad |= bool(bad) and not (self.good and bad <= OF_ARTICLES)
            self.hint |= bool(words & GOOD_WORDS) and not bad


class Block:
    """A block's raw text, its characters within links, the innermost block element and its number, and its ancestors' marks."""

    __slots__ = ("linked", "node", "parts")

    def __init__(self, node: _Node):
        self.node, self.parts, self.linked = node, [], 0


class _Stack:
    """The open elements. For each tag, for fences and for blocks it keeps where they stand, so that nothing is searched for."""

    def __init__(self, root: _Node):
        self.nodes, self.at = [root], {"html": [0], "#fence": [-1, 0], "#block": [0]}

    @staticmethod
    def _keys(tag: str) -> list[str]:
        return [tag] + ["#fence"] * (tag in FENCES) + ["#block"] * (tag in BLOCKS)

    def push(self, node: _Node) -> None:
        for key in self._keys(node.tag):
            self.at.setdefault(key, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            for key in self._keys(self.nodes.pop().tag):
                self.at[key].pop()

    def last(self, key: str) -> int:
        """Where the innermost one stands; 0, the root, if none."""
        return found[-1] if (found := self.at.get(key)) else 0

    def end(self, tags: set[str]) -> None:
        """Ends the innermost of these elements, unless a fence stands within it."""
        i = max(map(self.last, tags))
        if i > 0 and i >= self.last("#fence"):
            self.cut(i)


def _tag_end(page: str, at: int, quoted: bool) -> int:
    """Where the tag's > stands, outside of quoted values if these are heeded, or -1. A quote that isn't closed is a letter like others."""
    if not quoted:
        return page.find(">", at)
    while m := STOPS.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        at = close + 1 if close >= 0 else m.end()
    return -1


def blocks(page: str) -> list[tuple[str, float, _Node]]:
    """(text, share of it within links, element) of each block that is shown, in page order. Broken markup is read as browsers do, roughly.

    Time grows with the page, whatever is left open or unclosed in it.
    """
    root = _Node("html", 0, None, "")
    stack, out, now, count = _Stack(root), [], Block(root), 1
    n, at, end, failed, lost = len(page), 0, 0, 0, set()

    def close() -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block(stack.nodes[stack.last("#block")])

    def add(text: str) -> None:
        top = stack.nodes[-1]
        if text and not top.hidden:
            now.parts.append(text)
            if top.link:
                now.linked += len(text)

    while m := OPENS.search(page, at):
        at, tag = m.end(), (m[2] or "").lower()
        if tag:
            stop = _tag_end(page, at, failed < UNQUOTED)
            if stop < 0 and failed < UNQUOTED:
                failed += 1
                stop = _tag_end(page, at, False)
            if stop < 0:  # no tag ends any more: what follows is text
                break
        else:
            stop = page.find("-->" if m[0] == "<!--" else ">", at)
            stop = n if stop < 0 else stop + 2 * (m[0] == "<!--")
        add(page[end : m.start()])
        attributes, at = page[at:stop], min(n, stop + 1)
        end = at
        if not tag:
            continue
        if m[1]:
            if (i := stack.last(tag)) > 0:
                stack.cut(i)
            if tag in BLOCKS:
                close()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in CLOSES_P or tag in ENDS:
            stack.end(ENDS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set()))
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            if tag in BLOCKS:
                close()
            continue
        stack.push(_Node(tag, count, stack.nodes[-1], attributes))
        count += 1
        if tag in RAW:
            e = None if tag in lost else RAW_END[tag].search(page, at)
            if not e:
                lost.add(tag)
            at = end = e.start() if e else n
        elif tag in BLOCKS:
            close()
    add(page[end:])
    close()
    made = []
    for b in out:
        raw = "".join(b.parts)
        if text := " ".join(html.unescape(raw).split()):
            made.append((text, b.linked / len(raw), b.node))
    return made


def costs(text: str, linked: float, node: _Node) -> float:
    """What labelling the block boilerplate costs, less what labelling it content costs."""
    if node.bad:
        return -9.0
    words = text.count(" ") + 1
    out = 5.0 if node.good else 0.5 if node.hint else -1.0
    out += {"p": 1.0, "pre": 1.0, "blockquote": 1.0, "li": -0.5, "td": -0.3}.get(node.tag, 0.5 if node.tag[0] == "h" and node.tag[1:].isdigit() else 0.0)
    out += 1.5 if words >= 25 else 0.8 if words >= 10 else -0.5 if words < 4 else 0.0
    out += 0.4 if text[-1] in ".!?:;…\"'”»" else 0.0
    return out - 3.0 * linked * (linked > 0.5)


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the source still reaches: gains above zero are capacities from the source, below zero to the sink.

    Dinic: each phase finds the distances of all nodes from the source once, and then fills all shortest paths, trying no
    edge twice. Blocks' edges go to neighbours and to siblings, so phases are few.
    """
    n, tiny = len(gains), 1e-9
    if all(g > 0 for g in gains):
        return [True] * n
    if all(g <= 0 for g in gains):
        return [False] * n
    near: list[dict[int, float]] = [{} for _ in gains]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    left = list(gains)  # what is left of each terminal edge
    while True:
        level = {i: 0 for i, g in enumerate(left) if g > tiny}
        queue, last = deque(level), -1
        sources = list(level)
        while queue:
            i = queue.popleft()
            if last >= 0 and level[i] >= last:
                break
            for j, c in near[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    if left[j] < -tiny:
                        last = level[j]
                    queue.append(j)
        if last < 0:
            return [i in level for i in range(n)]
        untried = [list(x) for x in near]
        for s in sources:
            path = [s]
            while path and left[s] > tiny:
                i = path[-1]
                if left[i] < -tiny:
                    flow = min([left[s], -left[i], *(near[a][b] for a, b in zip(path, path[1:], strict=False))])
                    left[s] -= flow
                    left[i] += flow
                    cut = len(path)
                    for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                        near[a][b] -= flow
                        near[b][a] += flow
                        if near[a][b] <= tiny:
                            cut = min(cut, k + 1)
                    path = path[:cut]  # on from the first edge that is full
                    continue
                while untried[i]:
                    j = untried[i][-1]
                    if near[i][j] > tiny and level.get(j, -1) == level[i] + 1:
                        path.append(j)
                        break
                    untried[i].pop()
                else:
                    path.pop()
                    if path:
                        untried[path[-1]].pop()


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by two newlines. White space inside a block is one space; character references are decoded."""
    found = blocks(page or "")
    if not found:
        return ""
    edges = [(i, i + 1, NEXT) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, (_, _, node) in enumerate(found):
        for around in {node.inner, node.outer}:  # what stands in one element, and in elements side by side
            if (j := last.get(around)) is not None:
                edges.append((j, i, SIBLING))
            last[around] = i
    keep = minimum_cut([costs(*b) for b in found], edges)
    return "\n\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each row of pages with its main text: id, url, text and n_chars (its code points).

    A null or empty page has an empty text, as has one that is all boilerplate. Whole pages are read, however long, and
    nothing is cut. Rows that repeat are extracted alike, ids and URLs may be null; other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """

    def run(batches):
        for b in rows_of(batches):
            texts = [main_text(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    src = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, `{url_col}` string, text string, n_chars long")
