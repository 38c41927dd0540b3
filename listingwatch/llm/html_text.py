"""Operator 11: main text of web pages by composite text density.

Each page becomes a tree. A node's density is its characters per tag, set back the more of them are links (composite
text density of Sun, Song and Liao, 2011); its density sum adds up its children's. The node with the largest sum holds the
article. The smallest density on its path up to the body is the page's threshold: going down from the body, every node that
reaches it gives its own subtree of largest sum, so an article in several parts is found whole. What is no text for readers (scripts, forms) or is named
as a page's frame (navigation, adverts, comments) is taken off the tree first and has no part in any density.

Pages are read one by one where they lie; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of an article.
HIDDEN = frozenset("head title script style noscript template iframe object embed svg canvas audio video map form button select textarea input fieldset dialog nav aside footer menu".split())
#: Elements that end the line of text they stand in.
BLOCK = frozenset("html body article section main div header p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th hr address details summary center".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third lies between.
CLOSES = (
    (BLOCK - {"td", "th", "tr", "li", "dt", "dd", "thead", "tbody", "tfoot"} | {"form", "nav", "aside", "footer", "menu", "fieldset"}, frozenset(["p"]), frozenset("td th table button object caption".split())),
    (frozenset(["li"]), frozenset(["li", "p"]), frozenset("ul ol menu table".split())),
    (frozenset(["dt", "dd"]), frozenset(["dt", "dd", "p"]), frozenset(["dl", "table"])),
    (frozenset(["td", "th"]), frozenset(["td", "th", "p"]), frozenset(["table", "tr"])),
    (frozenset(["tr"]), frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    (frozenset(["thead", "tbody", "tfoot"]), frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p"]), frozenset(["table"])),
    (frozenset(["option", "optgroup"]), frozenset(["option"]), frozenset(["select"])),
)
#: Words of class, id or role that name a part of a page's frame.
FRAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies "
    "consent disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice outbrain pager pagination popup promo promoted "
    "promotion related search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar tags widget".split()
)
_NAME = re.compile(r"[a-z0-9]+")
WHOLE = ("article", "main")


class Node:
    """An element: its children are Nodes and strings."""

    __slots__ = ("tag", "attrs", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "top")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class Tree(HTMLParser):
    """Builds Nodes; end tags that fit nothing are passed over, missing ones are supplied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")
        self.open = Counter()

    def leave(self, to):
        while self.at is not to:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        for starts, ends, walls in CLOSES:
            if tag in starts and any(self.open[t] for t in ends):
                self.close(ends, walls)
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do: the slash says nothing unless the element is void

    def close(self, tags, walls):
        """Close the outermost open element of `tags` that no element of `walls` encloses from within."""
        node, found = self.at, None
        while node.parent is not None and node.tag not in walls:
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None:
            self.leave(found.parent)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            if tag not in BLOCK and tag not in HIDDEN and node.tag in BLOCK:
                return  # an inline end tag doesn't reach beyond its block
            node = node.parent
        if node.parent is not None:
            self.leave(node.parent)

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    HTMLParser.close(tree)  # what stands after the last tag
    return tree.root


def in_order(root: Node) -> list[Node]:
    """All nodes, parents first; deep pages don't recurse."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return found


def take_off(root: Node) -> None:
    """Remove hidden elements and those that are named as a page's frame. A name takes off no element that encloses an
    article, and a header inside an article is its title and stays."""
    nodes = in_order(root)
    whole, inside = set(), set()
    for node in reversed(nodes):
        if node.tag in WHOLE or id(node) in whole:
            whole.add(id(node))
            whole.add(id(node.parent))
    for node in nodes:
        if node.tag in WHOLE or id(node.parent) in inside:
            inside.add(id(node))
    for node in nodes:
        gone = node.tag in HIDDEN
        if not gone and node.tag not in ("html", "body") and id(node) not in whole:
            gone = node.tag == "header" and id(node) not in inside
            for key, value in node.attrs if not gone else ():
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value or ""):
                    gone = True
                elif key in ("class", "id", "role") and value:
                    names = set(_NAME.findall(value.lower()))
                    if id(node) in inside:
                        names -= {"header"}
                    gone = gone or bool(names & FRAME)
        if gone and node.parent is not None:
            node.parent.children = [x for x in node.parent.children if x is not node]


def counts(node: Node) -> bool:
    """Whether a node is a tag of the density: emphasis and the like within a line of text is none, links are."""
    return node.tag in BLOCK or node.tag == "a"


def measure(root: Node) -> list[Node]:
    """Densities and their sums, children first. Characters are code points without white space around and doubled within.
    What counts() leaves out hands its children's densities on. best is the largest sum of a subtree, top where it is."""
    nodes = in_order(root)
    for node in reversed(nodes):
        below = [x for x in node.children if isinstance(x, Node)]
        node.chars = sum(len(" ".join(x.split())) for x in node.children if isinstance(x, str)) + sum(x.chars for x in below)
        node.tags = sum(counts(x) + x.tags for x in below)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(x.link_chars for x in below)
        node.link_tags = node.tags if link else sum(x.link_tags + (x.tag == "a") for x in below)
    body_links = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        below = [x for x in node.children if isinstance(x, Node)]
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, body_links)
        node.total = sum(x.density if counts(x) else x.total for x in below)
        node.best, node.top = node.total if counts(node) or node is root else 0.0, node
        for x in below:
            if x.best > node.best:
                node.best, node.top = x.best, x.top
    return nodes


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    """Characters per tag, times a logarithm that falls as more of the characters and tags are links; 0 for nothing but links."""
    if chars <= link_chars:
        return 0.0
    tags, plain = max(tags, 1), max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + body_links * chars + math.e)
    share = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * math.log(max(share, 1.0)) / math.log(base + 1.0)


def main_parts(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    nodes = [n for n in measure(root) if counts(n) or n is root]
    best = max(nodes, key=lambda n: n.total)
    if best.total <= 0:  # no element below another has text of its own: the page itself, if it has some
        return [root] if root.chars > root.link_chars else []
    threshold, node = best.density, best
    while node is not None and node.tag != "html":
        threshold, node = min(threshold, node.density), node.parent
    marked, stack = set(), [root]
    while stack:
        node = stack.pop()
        if id(node) in marked or (node is not root and counts(node) and node.density < threshold):
            continue
        if node.best > 0:
            marked.add(id(node.top))
        elif node.chars > node.link_chars and counts(node):
            marked.add(id(node))  # a block that holds nothing but its text
        if id(node) not in marked:
            stack.extend(x for x in node.children if isinstance(x, Node))
    parts, stack = [], [root]
    while stack:
        node = stack.pop()
        if id(node) in marked:
            parts.append(node)
        else:
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return parts


def blocks(node: Node) -> list[str]:
    """Text of a subtree by blocks: white space is one space, empty blocks go."""
    lines, line, stack = [], [], [node]
    while stack:
        x = stack.pop()
        if x is None:
            lines.append("".join(line))
            line = []
        elif isinstance(x, str):
            line.append(x)
        else:
            around = x.tag in BLOCK
            if around:
                lines.append("".join(line))
                line = []
                stack.append(None)
            if x.tag == "br":
                line.append(" ")
            stack.extend(reversed(x.children))
    lines.append("".join(line))
    return [t for t in (" ".join(x.split()) for x in lines) if t]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by empty lines."""
    if not html:
        return ""
    root = parse(html)
    take_off(root)
    return "\n\n".join(b for part in main_parts(root) for b in blocks(part))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages.

    A null or empty html, and a page of nothing but frame and links, has the empty text. One row for each row, whatever its
    page_id or url; other columns are not read.
    """
    texts = map_rows(
        pages.select("page_id", "url", "html"),
        lambda b: {"page_id": b["page_id"], "url": b["url"], "text": [main_text(h) for h in b["html"]]},
        "page_id long, url string, text string",
    )
    return texts.withColumn("n_chars", F.length("text").cast("long"))
