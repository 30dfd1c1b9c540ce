"""The main text of a page by composite text density.

A page becomes a tree of its block elements. Scripts, forms, menus and other parts that say by tag, role
or class that they are not the article are cut off first. Every node left has a density: its characters
per tag, lowered where characters and tags belong to links. The node whose children's densities have the
largest sum holds the article (of equals the outermost and first); the least density on the way from the
body to it is the threshold. Inside the article a container below it is left out only if it also has three
links or more that make up over 60 % of its characters: short paragraphs have low densities too, and all of
an article's text must stay. Time and memory grow with the length of a page, however deeply it nests.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import mapped, spare, text_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)",
    re.DOTALL,
)
# Elements by what they do in a page.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption head "
    "hr template noscript iframe object svg canvas button select".split()
)
CUT = set(
    "head script style textarea title xmp noembed noframes nav footer aside form fieldset noscript template iframe object svg "
    "canvas button select menu dialog".split()
)
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
CUT_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs footer comment comments disqus reply replies cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations widget widgets toolbar pagination pager login masthead copyright disclaimer skip respond responses "
    "discussion alert alerts notification notifications announcement toast".split()
)
#: A word before a name above that turns it into a remark on the layout; words that make a header part of the article.
LAYOUT = {"no", "has", "with", "without", "hide", "is"}
CONTENT = {"article", "post", "entry", "content", "story"}
HEAD_PARTS = {"meta", "title", "style", "script", "link", "base", "noscript", "template", "head", "html"}
WHOLE = {"article", "main"}
NO_CUT = {"html", "body", "article", "main"}
#: An open p ends before any of these; an open element of the key ends before those in its set.
ENDS_P = BLOCK - {"tbody", "tfoot", "thead", "tr", "caption", "head", "html", "body", "button", "select", "svg", "canvas", "object", "iframe", "noscript", "template"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"tbody", "tfoot", "thead", "tr"}}
LISTS = {"ul", "ol", "menu"}
#: Elements whose inside is not part of the sibling list around them.
FENCES = {"li": LISTS, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "tbody": {"table"}}
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block element: its text runs and child nodes in page order, and its counts."""

    __slots__ = ("tag", "cut", "parts", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, cut: bool, parent: Node | None):
        self.tag, self.cut, self.parent, self.parts = tag, cut, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, rest: str, inside: bool) -> bool:
    """Whether an element says that it is not part of an article. ``inside``: of an article or main element."""
    if tag in CUT or tag == "header" and not inside:
        return True
    if not rest or tag in NO_CUT:
        return False
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in CUT_ROLES:
            return True
        if name in ("class", "id"):
            words = [w.lower() for w in NAME.findall(value)]
            if any(w in CUT_NAMES and before not in LAYOUT for before, w in zip(["", *words], words)):
                return True
            if "header" in words and not inside and not CONTENT.intersection(words):
                return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of block elements. Inline elements leave their text and their counts to the block around."""
    root = Node("html", False, None)
    node, inside, links = root, 0, 0
    open_nodes: list[Node] = []  # from the outermost; the root is not among them
    places: dict[str, list[int]] = defaultdict(list)  # of each tag, where it is in that list
    hidden: list[str] = []  # open inline elements that are cut, with those inside them
    hidden_tags: Counter[str] = Counter()
    at, n = 0, len(page)

    def close(at_place: int) -> Node:
        """Close the open node of that place and all inside it; the node around them."""
        nonlocal inside, links
        while len(open_nodes) > at_place:
            tag = open_nodes.pop().tag
            places[tag].pop()
            inside -= tag in WHOLE
        links = 0
        return open_nodes[-1] if open_nodes else root

    def opened(tag: str, fences: Iterable[str] = ()) -> int | None:
        """Place of the innermost open node of the tag, unless a fence is open inside it."""
        found = places[tag]
        return found[-1] if found and all(not places[f] or places[f][-1] < found[-1] for f in fences) else None

    def forget_hidden() -> None:
        hidden.clear()
        hidden_tags.clear()

    def say(text: str) -> None:
        if text and not hidden and not node.cut:
            node.parts.append(text)
            if links:
                node.link_chars += len("".join(text.split()))

    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        shut, tag, rest, end = found[1], found[2], found[3], found[4]
        if tag is None:
            shut, tag, rest, end = found[5], found[6], found[7], found[8]
            if tag is None:
                continue
        if not end:
            break  # the page ends inside a tag
        tag = tag.lower()
        if shut:
            if hidden:
                if hidden_tags[tag]:
                    last = None
                    while last != tag:
                        last = hidden.pop()
                        hidden_tags[last] -= 1
                    continue
                if tag not in BLOCK:
                    continue
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK and (place := opened(tag)) is not None:
                node = close(place)
                forget_hidden()
            elif tag in ("td", "th"):
                say(" ")
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else n
            continue
        if tag == "br":
            say(" ")
        if tag in VOID and tag != "hr":
            if not hidden and not node.cut:
                node.tags += 1
            continue
        if tag not in BLOCK:
            if tag in ("td", "th"):
                say(" ")
            if hidden or _unwanted(tag, rest, inside > 0):
                if not rest.endswith("/"):
                    hidden.append(tag)
                    hidden_tags[tag] += 1
            elif not node.cut:
                node.tags += 1
                if tag == "a":
                    links += 1
                    node.link_tags += 1
            continue
        if tag in ("html", "body"):
            if (place := opened("head")) is not None:
                node = close(place)
            if tag == "html" or opened("body") is not None:
                continue
        elif node.tag == "head" and tag not in HEAD_PARTS:
            node = close(len(open_nodes) - 1)
        if tag in ENDS_P and (place := opened("p", ("body", "td", "button"))) is not None:
            node = close(place)
        for other in SIBLINGS.get(tag, ()):
            if (place := opened(other, FENCES[tag])) is not None:
                node = close(place)
        if tag == "hr":
            if not node.cut:
                node.parts.append(Node("hr", True, node))
            continue
        child = Node(tag, node.cut or bool(hidden) or _unwanted(tag, rest, inside > 0), node)
        node.parts.append(child)
        if not rest.endswith("/") or tag not in ("svg", "iframe", "object"):
            places[tag].append(len(open_nodes))
            open_nodes.append(child)
            node, links = child, 0
            inside += tag in WHOLE
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, each before its children; without recursion, as pages may nest deeply."""
    found, rest = [], [root]
    while rest:
        one = rest.pop()
        found.append(one)
        rest.extend(p for p in one.parts if isinstance(p, Node))
    return found


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes that are not cut; nodes in an order of parents first."""
    nodes = [x for x in _order(root) if not x.cut]
    for x in reversed(nodes):
        for p in x.parts:
            if isinstance(p, str):
                x.chars += len("".join(p.split()))
            elif not p.cut:
                x.chars += p.chars
                x.tags += p.tags + 1
                x.link_chars += p.link_chars
                x.link_tags += p.link_tags
    shared = root.link_chars / max(1, root.chars)
    for x in nodes:
        if not x.chars:
            continue
        tags, links, link_tags = max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        base = math.log(x.chars / max(1, x.chars - x.link_chars) * x.link_chars + shared * x.chars + math.e)
        ratio = max(1.0, x.chars / links * (tags / link_tags))
        x.density = x.chars / tags * (math.log(ratio) / max(math.log(base), 1.0) if base > 1 and ratio > 1 else 1e-3)
    for x in nodes:
        x.total = sum(p.density for p in x.parts if isinstance(p, Node) and not p.cut) or x.density
    return nodes


def article(root: Node) -> tuple[Node, float]:
    """The node with the largest density sum, or the article or main element around it; and the threshold."""
    nodes = measure(root)
    best = max(nodes, key=lambda x: x.total)  # of equals the outermost
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    whole = [x for x in path if x.tag in WHOLE]
    return (whole[-1] if whole else best), threshold


def blocks(top: Node, threshold: float) -> list[str]:
    """The text of each block below ``top`` in page order, white space folded, empty ones left out."""
    found: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            found.append(text)

    rest: list = [iter(top.parts)]
    while rest:
        part = next(rest[-1], None)
        if part is None:
            flush()
            rest.pop()
        elif isinstance(part, str):
            run.append(part)
        elif part.cut:
            flush() if part.tag in BLOCK else None
        else:
            flush()
            linked = part.link_tags >= 3 and part.link_chars > 0.6 * part.chars
            if not (linked and part.density < threshold + 1e-9 and part.tag not in WHOLE):
                rest.append(iter(part.parts))
    return found


def main_text(page: str) -> str:
    root = parse(page)
    return "\n".join(blocks(*article(root)))


def extract(df: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """``df`` with the main text of ``page`` in ``into`` and its number of code points in ``n_chars``.

    A null or empty page, and one without an article's text, gives an empty text. Columns of the two names
    are replaced, all others stay. One pass without a shuffle; each row is read whole and by itself.
    """

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return mapped(pages, main_text, pa.string())

    held = spare(df, "page_text")
    found = df.withColumn(held, texts(text_of(page)))
    return found.withColumns({into: F.col(held), "n_chars": F.length(held).cast("long")}).drop(held)
