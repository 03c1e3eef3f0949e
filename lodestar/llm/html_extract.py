"""Main text of web pages by composite text density of their DOM nodes.

For every node: C characters and T tags in its subtree, LC and LT of these in
links. Its composite density is ``C / T``, scaled by the logarithm of
``C / LC * T / LT`` to a base that grows with the share of link text (Sun, Song
and Liao, 2011). A node's density sum adds the densities of its children. The
subtree with the largest sum is the article; the lowest density on its path
from the body is the threshold that every further subtree must reach.

Tags only mark what is never article text: scripts, menus, asides, footers,
hidden elements. Other signs are evidence. An element that a class or id calls
an advert or a list of reader comments is left out, wherever it stands; one
that is called a notice, a sidebar and the like, a form and a page header are
left out while the article is sought. Such an element comes back if it wraps
the page (most of its plain text, or a marked article), or if it lies in the
article and is prose as dense as the threshold; reader comments only if
nothing else is left. Headings are never cut for their names. A kept subtree
inside a marked article or main element is widened to it, headings right
before a kept subtree are kept with it, and blocks that are mostly links are
dropped outside marked articles.

Parsing is linear in the page: names and attributes are scanned once, and an
end tag looks no further than the elements that it closes.

Defined cases: null, empty and unparsable pages give an empty text; unclosed
elements end with their parent; a tag that the page's end cuts off is dropped;
a repeated row gives the same text again; null ids and urls are carried
through; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and their roles here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head script style noscript template nav aside footer button select textarea input iframe object embed svg canvas audio video dialog map noembed noframes xmp title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog status menu menubar toolbar form".split())
# Words of classes and ids that name what is not article text, and words that say nothing beside them.
COMMENT_NAMES = frozenset("comment comments commentlist commentform commentator respond replies disqus discussion reactions".split())
ADVERT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored".split())
OTHER_NAMES = frozenset(
    "promo promotion banner sidebar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social "
    "related recommended breadcrumb breadcrumbs menu nav navbar navigation foot footer colophon copyright pagination pager widget widgets toolbar skip login masthead".split()
)
NEUTRAL = frozenset("area bar block box buttons container icons inner list links section slot wrap wrapper".split())
SOFT, FIRM = 1, 2
OTHER, ADVERT, COMMENT = 1, 2, 3
#: What a start tag ends, by the place of its kind in a node's scope, and the elements that hide a kind from what is inside them.
SCOPES = (("p",), ("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",))
HIDES = (BLOCK | {"button"}, {"ul", "ol", "menu"}, {"dl"}, {"tr", "table"}, {"table"}, {"select", "datalist"})
_ENDS = {tag: i for i, tags in enumerate(SCOPES) for tag in tags if i}
_SHIFTS = {tag: ([i for i, hidden in enumerate(HIDES) if tag in hidden], next((i for i, tags in enumerate(SCOPES) if tag in tags), None)) for tag in BLOCK | {"button", "select", "datalist"}}

_TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:([\"'])|([^\s>]*+)))?)?")
_WORD = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A named element with more than this share of the page's plain text wraps the article.
WRAPS = 0.8
#: Characters a tag from which a named element inside the article can be prose.
PROSE = 25
#: Share of link text from which a block outside a marked article is a list of links.
LINKS = 0.5


class _Node:
    __slots__ = ("tag", "parent", "children", "cut", "name", "inside", "marks", "block", "inlines", "scope", "chars", "tags", "link_chars", "link_tags", "density", "total", "out")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.cut = self.name = 0
        self.marks = self.out = False
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        # the nearest block, the inline elements open in it, and the nearest open element of each kind in SCOPES
        self.scope = parent.scope if parent is not None else (None,) * len(SCOPES)
        if parent is None or tag in BLOCK:
            self.block, self.inlines = self, {}
        else:
            self.block, self.inlines = parent.block, None
        if (shift := _SHIFTS.get(tag)) is not None:
            scope = list(self.scope)
            for i in shift[0]:
                scope[i] = None
            if shift[1] is not None:
                scope[shift[1]] = self
            self.scope = tuple(scope)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _name_of(value: str, inside: bool) -> int:
    """What the tokens of a class or an id say; a token counts only as a whole: has-sidebar is no sidebar."""
    found = 0
    for token in value.lower().split():
        words = set(_WORD.findall(token)) - NEUTRAL
        if not words:
            continue
        if words <= COMMENT_NAMES:
            return COMMENT
        if words <= ADVERT_NAMES:
            found = ADVERT
        elif not found and (words <= OTHER_NAMES | ADVERT_NAMES | COMMENT_NAMES or not inside and words == {"header"}):
            found = OTHER
    return found


def _judge(node: _Node, attributes: dict[str, str]) -> None:
    """Set ``cut`` and ``name`` of a new node by its tag and attributes."""
    tag = node.tag
    if tag in NEVER:
        node.cut = FIRM
        return
    if tag in ("form", "menu") or tag == "header" and not node.inside:
        node.cut = SOFT
    if not attributes or tag in ("html", "body"):
        return
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        node.cut = FIRM
        return
    if attributes.get("role", "").lower() in CUT_ROLES and tag not in ("article", "main"):
        node.cut = SOFT
    if tag not in HEADINGS:
        name = max(_name_of(attributes.get(key, ""), node.inside) for key in ("class", "id"))
        if name and (name == COMMENT or tag not in ("article", "main")):
            node.cut, node.name = SOFT, name


def _attributes(page: str, at: int) -> tuple[dict[str, str] | None, int]:
    """Attributes from ``at`` to the end of the tag, and where it ends; None if the page ends first."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if m[1] is None:
            return (found, at + 1) if at < len(page) else (None, at)  # only > stops an attribute without a name
        value = m[3] or ""
        if m[2]:
            upto = page.find(m[2], at)
            if upto < 0:
                return None, len(page)
            value, at = page[at:upto], upto + 1
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)


def parse(page: str) -> _Node:
    """The tree; children are nodes and text strings in page order."""
    root = here = _Node("#root", None)
    open_: dict[str, int] = {}  # blocks that are open
    at, end, lower = 0, len(page), None

    def text(piece: str) -> None:
        if piece:
            here.children.append(html.unescape(piece) if "&" in piece else piece)

    def leave(node: _Node) -> None:
        """Close open elements up to and with ``node``."""
        nonlocal here
        while True:
            closed, here = here, here.parent
            counts = open_ if closed.tag in BLOCK else closed.block.inlines
            counts[closed.tag] -= 1
            if closed is node:
                return

    start = 0  # of the text before the next tag
    while True:
        at = page.find("<", at)
        if at < 0:
            text(page[start:])
            return root
        kind = page[at + 1 : at + 2]
        if kind in ("!", "?"):
            text(page[start:at])
            if page.startswith("<!--", at):
                upto, size = page.find("-->", at + 4), 3
            elif page.startswith("<![CDATA[", at):
                upto, size = page.find("]]>", at), 3
                if upto >= 0:
                    here.children.append(page[at + 9 : upto])
            else:
                upto, size = page.find(">", at), 1
            at = start = end if upto < 0 else upto + size
            continue
        ends = kind == "/"
        m = _TAG_NAME.match(page, at + 1 + ends)
        if m is None:
            if not ends:  # a mere less-than sign
                at += 1
                continue
            text(page[start:at])
            upto = page.find(">", at)
            at = start = end if upto < 0 else upto + 1
            continue
        text(page[start:at])
        attributes, at = ({}, m.end() + 1) if page.startswith(">", m.end()) else _attributes(page, m.end())
        start = at
        if attributes is None:
            return root
        tag = m[0].lower()
        if ends:
            if tag in BLOCK:
                if open_.get(tag):
                    node = here.block
                    while node.tag != tag:
                        node = node.parent.block
                    leave(node)
                elif tag == "p":
                    here.children.append(_Node("p", here))
            elif here.block.inlines.get(tag):  # an inline element never ends blocks inside it
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node)
            elif tag == "br":
                here.children.append(_Node("br", here))
            continue
        if tag in BLOCK and here.scope[0] is not None:  # a block ends an open paragraph
            leave(here.scope[0])
        if tag in _ENDS:
            for kind in (3, 4) if tag == "tr" else (_ENDS[tag],):
                if here.scope[kind] is not None:
                    leave(here.scope[kind])
        elif tag == "a" and here.block.inlines.get("a"):  # links don't nest
            node = here
            while node.tag != "a":
                node = node.parent
            leave(node)
        node = _Node(tag, here)
        _judge(node, attributes)
        if tag in ("article", "main") and not node.name:
            up = here
            while up is not None and not up.marks and up.name != COMMENT:
                up.marks = True
                up = up.parent
        here.children.append(node)
        if tag in RAW:
            lower = lower if lower is not None else page.lower() if page.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            upto = lower.find(f"</{tag}", at)
            close = page.find(">", upto) if upto >= 0 else -1
            at = start = end if close < 0 else close + 1
        elif tag not in VOID:
            here = node
            counts = open_ if tag in BLOCK else node.block.inlines
            counts[tag] = counts.get(tag, 0) + 1


def _kept_children(node: _Node) -> list[_Node]:
    return [c for c in node.children if isinstance(c, _Node) and not c.out]


def _in_order(root: _Node) -> list[_Node]:
    """Nodes that are not out, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(_kept_children(node))
    return out


def _count(nodes: list[_Node]) -> None:
    for node in reversed(nodes):  # children first
        below = _kept_children(node)
        node.chars = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str)) + sum(c.chars for c in below)
        node.tags = sum(c.tags + 1 for c in below)
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in below)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in below)


def _weigh(nodes: list[_Node], body: _Node) -> None:
    """Densities and density sums of counted nodes."""
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        node.density = node.total = 0.0
        if not node.chars:
            continue
        tags, plain = max(node.tags, 1), max(node.chars - node.link_chars, 1)
        base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
        inner = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
        node.density = node.chars / tags * (math.log(max(inner, 1.0)) / math.log(base) if base > 1 else math.log(max(inner, 1.0)))
    for node in nodes:
        node.total = sum(c.density for c in _kept_children(node)) + (node.density if any(isinstance(c, str) and c.strip() for c in node.children) else 0.0)


def _body(nodes: list[_Node], root: _Node) -> _Node:
    return next((n for n in nodes if n.tag == "body"), root)


def _settle(root: _Node) -> list[tuple[_Node, float]]:
    """Decide what is out, and return what may come back as prose of the article, with its density."""
    nodes, stack = [], [root]
    while stack:  # all but what is never text
        node = stack.pop()
        nodes.append(node)
        for c in node.children:
            if isinstance(c, _Node):
                c.out = c.cut == FIRM
        stack += _kept_children(node)
    suspects = [n for n in nodes if n.cut == SOFT]
    if not suspects:
        return []
    nodes = _in_order(root)
    _count(nodes)
    body = _body(nodes, root)
    _weigh(nodes, body)
    most = WRAPS * (body.chars - body.link_chars)
    back, out = [], []
    for node in suspects:
        wraps = node.name != COMMENT and (node.marks or node.chars - node.link_chars > most)
        if not wraps:
            out.append(node)
            if node.name == OTHER and node.chars >= PROSE * max(node.tags, 1):
                back.append((node, node.density))
    for node in out:
        node.out = True
    left = _in_order(root)
    if not any(isinstance(c, str) and c.strip() for n in left for c in n.children):  # what the names spare is empty: they are wrong
        for node in out:
            node.out = False
        return []
    return back


def _blocks(tops: list[_Node]) -> list[str]:
    out: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(piece).split()):
            out.append(line)
        piece.clear()

    for top in tops:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                piece.append(x)
            elif x is None:
                flush()
            elif x is top or not x.out:
                if x.tag in BLOCK or x is top:
                    flush()
                    stack.append(None)
                elif x.tag == "br":
                    piece.append(" ")
                stack += reversed(x.children)
        flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    returning = _settle(root)
    nodes = _in_order(root)
    body = _body(nodes, root)
    _count(nodes)
    if not body.chars:
        return ""
    _weigh(nodes, body)
    inner = nodes if body is root else _in_order(body)
    marked: dict[int, _Node] = {}  # of each node in a marked element, the outermost one
    for n in inner:
        if (up := marked.get(id(n.parent))) or n.tag in ("article", "main") and n.chars:
            marked[id(n)] = up or n
    best = max(inner, key=lambda n: (n.total, id(n) in marked))
    threshold, node, path = best.density, best, set()
    while node is not None and node is not body.parent:
        threshold, node = min(threshold, node.density), node.parent
        path.add(id(node))
    # every subtree whose density reaches the threshold of the path is article text, in page order
    chosen: dict[int, _Node] = {}
    stack = [body]
    while stack:
        node = stack.pop()
        reached = node.density >= threshold or marked.get(id(node)) is node and node.total >= threshold  # a smaller part of an article
        if node is best or (node is not body and id(node) not in path and reached and node.chars):
            top = marked.get(id(node), node)
            chosen.setdefault(id(top), top)
        elif node.chars:  # a subtree of the threshold's density may lie in one that is less dense
            stack += reversed(_kept_children(node))
    tops: list[_Node] = []
    places: dict[int, dict[int, int]] = {}  # of a parent, its children's places
    for top in chosen.values():
        titles: list[_Node] = []
        before = top.parent.children if top.parent is not None else []
        at = places.setdefault(id(before), {id(c): i for i, c in enumerate(before)} if id(before) not in places else {}).get(id(top), 0)
        while at and (isinstance(before[at - 1], str) and not before[at - 1].strip() or isinstance(before[at - 1], _Node) and before[at - 1].tag in HEADINGS):
            at -= 1
            if isinstance(before[at], _Node) and not before[at].out and id(before[at]) not in chosen:
                titles.append(before[at])
        tops += [*reversed(titles), top]
    for node, density in returning:
        if density >= threshold:
            up = node.parent
            while up is not None and id(up) not in chosen:
                up = up.parent
            if up is not None:
                node.out = False
    for top in tops:  # lists of links are dropped but in marked articles, and where a heading or a colon leads to them
        stack = [] if top.tag in ("article", "main") else [top]
        while stack:
            leads = False
            for child in stack.pop().children:
                if isinstance(child, str):
                    leads = child.rstrip().endswith(":") if child.strip() else leads
                elif child.out or not child.chars or child.tag in ("article", "main"):
                    leads = leads and not child.chars
                elif child.tag in BLOCK and child.tag != "p" and child.tag not in HEADINGS and child.link_chars > LINKS * child.chars:
                    child.out = not leads
                else:
                    leads = child.tag in HEADINGS or child.tag == "p" and "".join(_blocks([child])[-1:]).endswith(":")
                    stack.append(child)
    return "\n".join(_blocks(tops))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            got = [main_text(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string())], names=[id_col, url_col, "text"])

    kinds = [docs_type(pages, c) for c in (id_col, url_col)]
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("h")).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string")


def docs_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
