"""Main text of HTML pages by composite text density.

For every DOM node the link-adjusted density is characters per tag, lowered by
the share of link characters and link tags (the composite text density
measure); a node's density sum adds the densities of its children.  The node
with the largest sum is the densest subtree, and the smallest density on its
path up to the body is the threshold: below a node that reaches it, the
subtree with the largest sum is content.  Where the densest subtree lies in a
node that the page names as its article (``article``, ``main``, ``role=main``,
``itemprop=articleBody``), all nodes so named stand for the page body: of each
the subtrees go that are below the threshold and mostly links.

Elements and roles of menus, headers, footers, sidebars, notices, forms,
scripts and styles are taken out first, and so are nodes with such a word as a
whole class or id, unless they hold a named article or nearly all text.  A
class or id that only has such a word in it (``has-sidebar``) takes its node out
where the text is mostly links, or below the threshold and without a heading,
and holds no named article.

One page is one row: nothing is shuffled, and a task holds one Arrow batch.

Defined cases: null and empty pages give the empty text; broken, unclosed or
nested markup is repaired as browsers do for block tags; text outside any tag
counts as body text; equal pages give equal texts; an empty table gives an
empty result; input columns stay as they are (an added column that clashes
gets underscores in front).
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vetta.llm.common import free_name

ADDED = "main_text"
SLICE_ROWS = 512

# Element names of the HTML standard.
RAW = frozenset("script style noscript template textarea title iframe object svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
                  "nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
         "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
BOILER = frozenset("head nav menu header footer aside form button select dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu "
                         "menubar form".split())
BOILER_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion
    nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget comment comments
    disqus respond reply replies notice notification alert cookie cookies consent gdpr banner popup modal overlay
    newsletter subscribe subscription signup login share sharing social related recommended pagination pager
    toolbar skip""".split())

HEADING = re.compile("h[1-6]")
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Node:
    __slots__ = ("tag", "up", "items", "boiler", "word", "article", "chars", "tags", "link_chars", "link_tags",
                 "density", "total")

    def __init__(self, tag: str, up: "Node | None"):
        self.tag, self.up, self.items = tag, up, []
        self.boiler = self.article = False
        self.word = 0               # a class or id that has (1) or is (2) a boilerplate word
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def describe(node: Node, attributes: str) -> None:
    """Mark boilerplate and named articles from the tag and its attributes."""
    node.boiler = node.tag in BOILER
    node.article = node.tag in ("article", "main")
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            node.boiler |= value in BOILER_ROLES
            node.article |= value in ("main", "article")
        elif name == "itemprop":
            node.article |= value == "articlebody"
            node.boiler |= value == "comment"
        elif name == "hidden" or name == "aria-hidden":
            node.boiler |= name == "hidden" and value in ("", "hidden") or value == "true"
        elif node.tag not in ("html", "body", "article", "main"):
            for own in value.split():
                parts = [x for x in re.split(r"[^a-z]+", own) if x]
                if not BOILER_WORDS.isdisjoint(parts):
                    node.word = max(node.word, 2 if BOILER_WORDS.issuperset(parts) else 1)
    if node.boiler:
        node.article = False


def parse(page: str) -> Node:
    """DOM of a page; unclosed tags end where a browser would end them."""
    root = here = Node("body", None)
    pos, size = 0, len(page)
    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            here.items.append(page[pos:])
            break
        if at > pos:
            here.items.append(page[pos:at])
        found = TAG.match(page, at) or LOOSE_TAG.match(page, at)
        if found is None:
            here.items.append("<")
            pos = at + 1
            continue
        pos = found.end()
        if found.lastindex is None:             # comment or declaration
            continue
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if closing:
            node = here
            while node is not root and node.tag != tag:
                if node.tag in BLOCK and tag not in BLOCK:
                    break                       # an inline end tag ends no block
                node = node.up
            if node is not root and node.tag == tag:
                here = node.up
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end and not attributes.endswith("/") else pos if attributes.endswith("/") else size
            continue
        if tag in ("html", "body"):
            if tag == "body":
                while here is not root:
                    here = here.up
            continue
        if tag in BLOCK:
            node = here
            while node is not root and node.tag != "p" and node.tag not in BLOCK:
                node = node.up
            if node.tag == "p":                 # a block ends an open paragraph
                here = node.up
        if tag in CLOSES:
            node, stop = here, HOLDS.get(tag, ())
            while node is not root and node.tag not in CLOSES[tag] and node.tag not in stop:
                node = node.up
            if node is not root and node.tag in CLOSES[tag]:
                here = node.up
        node = Node(tag, here)
        describe(node, attributes)
        here.items.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            here = node
    return root


def ordered(root: Node) -> list[Node]:
    """Nodes that are not boilerplate, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.boiler:
            out.append(node)
            todo.extend(x for x in reversed(node.items) if not isinstance(x, str))
    return out


def measure(nodes: list[Node]) -> None:
    """Characters, tags and link parts of every node, then densities."""
    for node in reversed(nodes):                # children first
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(x) if not x.isspace() else 0
            elif not x.boiler:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.link_chars = node.chars
            node.link_tags += 1
    body = nodes[0]
    body_links = body.link_chars / max(1, body.chars)
    for node in nodes:
        tags, links, link_tags = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        plain = max(1, node.chars - node.link_chars)
        base = math.log(node.chars / plain * node.link_chars + body_links * node.chars + math.e)
        adjusted = math.log(max(node.chars * tags / (links * link_tags), 1.0)) / base if node.chars else 0.0
        node.density = node.chars / tags * adjusted
    for node in nodes:
        node.total = sum(x.density for x in node.items if not isinstance(x, str) and not x.boiler)
        if not node.total:
            node.total = node.density


def densest(node: Node) -> Node:
    return max(ordered(node), key=lambda n: n.total)    # the first of equals: the outer one


def mostly_links(node: Node) -> bool:
    return 2 * node.link_chars > node.chars


def best_of(nodes: list[Node]) -> tuple[Node, float]:
    """The densest subtree, and the smallest density on its path to the body."""
    best = node = max(nodes, key=lambda n: n.total)
    threshold = best.density
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.up
    return best, threshold


def drop_by_words(root: Node) -> list[Node]:
    """Take out the nodes whose class or id speaks of boilerplate and whose
    text bears it out; the measured nodes that stay."""
    nodes = ordered(root)
    measure(nodes)
    if not any(n.word for n in nodes):
        return nodes
    holds, heads = set(), set()                 # nodes with a named article, a heading in them
    for node in nodes:
        for found, kind in ((holds, node.article and not node.word), (heads, HEADING.fullmatch(node.tag))):
            up = node if kind else None
            while up is not None and id(up) not in found:
                found.add(id(up))
                up = up.up
    page = root.chars
    for node in nodes:
        node.boiler = node.word == 2 and id(node) not in holds and (mostly_links(node) or 5 * node.chars < 4 * page)
    nodes = ordered(root)
    measure(nodes)
    _, threshold = best_of(nodes)
    for node in nodes:
        node.boiler = bool(node.word and id(node) not in holds
                           and (mostly_links(node) or node.density < threshold and id(node) not in heads))
    nodes = ordered(root)
    measure(nodes)
    return nodes


def content_nodes(root: Node) -> list[Node]:
    """Subtrees that hold the main text."""
    nodes = drop_by_words(root)
    best, threshold = best_of(nodes)
    node = best
    while node is not None and not node.article:
        node = node.up
    if node is not None:                        # the named nodes are the body
        named = [n for n in nodes if n.article and n.chars]
        for body in named:
            for n in ordered(body)[1:]:
                n.boiler |= n.tag in BLOCK and n.density < threshold and mostly_links(n)
        return named
    marked, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.boiler or node.density < threshold or not node.chars:
            continue
        target = densest(node)
        marked.append(target)
        if target is not node:
            todo.extend(x for x in node.items if not isinstance(x, str))
    return marked


def blocks(root: Node, wanted: set[int]) -> list[str]:
    """Text of the wanted subtrees block by block, in page order."""
    out, line = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    todo = [(root, id(root) in wanted, False)]
    while todo:
        item, inside, leaving = todo.pop()
        if isinstance(item, str):
            if inside:
                line.append(item)
            continue
        if leaving:
            flush()
            continue
        if item.boiler:
            if item.tag in BLOCK:
                flush()
            continue
        inside = inside or id(item) in wanted
        if item.tag in BLOCK:
            flush()
            todo.append((item, inside, True))
        elif item.tag == "br":
            line.append(" ")
        todo.extend((x, inside, False) for x in reversed(item.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    """Main text of one page, its blocks joined by line breaks."""
    if not page:
        return ""
    root = parse(page)
    return "\n".join(blocks(root, {id(n) for n in content_nodes(root)}))


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` plus ``main_text``, the main text of each page."""
    name = free_name(df, ADDED)
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(begin, SLICE_ROWS)
                texts = [main_text(page) for page in rows.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())],
                                                 names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
