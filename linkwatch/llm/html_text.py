"""Main text of HTML pages by composite text density.

Every element gets a density: its characters per tag, adjusted for links (the
share of link text lowers it). The sum of the densities of an element's children
is greatest for the element that holds the article. The least density on the
path from it to the body is the threshold: beside that path, elements at or
above it belong to the article too, and so does one with the h1; within the chosen element everything stays,
short paragraphs and lists of links too.

The element chosen is lifted to the article element around it, if there is one.
Elements that never hold the article (navigation, footers, forms, scripts, and
those whose class, id or role says advert, sidebar, notice, comments and the
like) are left out before densities are taken, unless most of the page's text stands in one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwatch.llm.common import small_batches

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
SKIPPED = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video nav footer aside form button input select textarea dialog menu title noembed noframes".split()
)
BLOCKS = frozenset(
    "address article blockquote body dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption center".split()
)
#: Start tags that end an open paragraph, and those that end an open element of the same kind.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"} | {"form", "nav", "footer", "header", "aside", "menu"}
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role that mark what isn't the article, and those of a page's header.
_PARTS = (
    r"ads?|advert\w*|banner|sponsor(?:ed)?|promo(?:tion)?s?|sidebar\w*|side-bar|(?:top|sub|main)?nav(?:bar|igation)?|(?:top|sub|main)?menu|breadcrumbs?|footer\w*|masthead|"
    r"cookies?|cookie(?:bar|banner|notice)|consent|gdpr|notices?|notifications?|alert|popup|modal|overlay|newsletter|subscri(?:be|ption)|signup|share|sharing|social|related|recommend(?:ed|ations?)|"
    r"comments?|comment(?:list|section|form)|disqus|replies|reviews|responses|discussions?|pagination|pager|toolbar|widgets?|complementary|contentinfo|dialog|search|login|disclaimer|copyright|skip-link"
)
NOT_ARTICLE = re.compile(rf"(?:^|[\s_-])(?:{_PARTS})(?:$|[\s_-]|\d)", re.I)
PAGE_HEADER = re.compile(r"(?:^|\s)(?:(?:site|page|top|main|global|web)[_-])?header(?:$|\s)", re.I)
#: Parts that may stand beside those in one word; others (has-sidebar, social-issues) make it a word for something else.
BESIDE = "box|left|right|top|bottom|upper|lower|container|wrapper|wrap|block|section|list|area|bar|inner|outer|links?|posts?|articles|stories|items?|buttons?|icons?|main|page|site|global|primary|secondary|group|slot|unit|text|form|panel|strip|message|media|mobile|article|entry|blog|news|user|readers?|thread|c|u|w|google|content|card|privacy|policy|breaking|desktop|sticky|wp|js"
_WHOLE = re.compile(rf"(?:(?:{_PARTS}|{BESIDE}|\d+)(?:[_-]+|$|(?=\d)))+", re.I)
#: Names and words of parts that may be mistaken for the article's, as they hold most of a page's text; comments often do.
MAY_HOLD = frozenset("nav header footer aside form".split())
COMMENTS = re.compile(r"comment|disqus|replies|reviews", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: A quote opens a value right after the equals sign only; elsewhere it is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>])*+)(?:>|$)|<[a-zA-Z/][^<>]*$", re.S)
#: An attribute: its name, and its value as it may be quoted.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Node:
    """An element: its name, its texts and elements in order, and its counts."""

    __slots__ = ("chars", "density", "in_article", "kids", "left_out", "link_chars", "links", "name", "parent", "tags", "total")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.kids = name, parent, []
        self.left_out = ""
        self.in_article = name == "article" or parent is not None and parent.in_article
        self.chars = self.link_chars = self.tags = self.links = 0
        self.density = self.total = 0.0

    def within(self) -> list[Node]:
        """The element itself and those in it, parents before children."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            out.append(x)
            stack.extend(k for k in reversed(x.kids) if isinstance(k, Node))
        return out

    def up(self) -> Iterator[Node]:
        """The element itself and those around it."""
        node = self
        while node is not None:
            yield node
            node = node.parent


def _marked(value: str) -> bool:
    """Whether a word of a class, id or role marks what isn't the article."""
    return any(NOT_ARTICLE.search(w) and _WHOLE.fullmatch(w) for w in value.split())


def _left_out(name: str, attributes: str, in_article: bool) -> str:
    """"" for what stays, "maybe" for what goes unless most of the text stands in it, "yes" for what goes."""
    out = ""
    if name in SKIPPED or name == "header" and not in_article:
        out = "maybe" if name in MAY_HOLD else "yes"
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            value = _CAMEL.sub("-", value)
            if name not in ("html", "body", "main", "article") and (_marked(value) or not in_article and PAGE_HEADER.search(value)):
                out = "yes" if out == "yes" or COMMENTS.search(value) else "maybe"
        elif key == "itemprop" and COMMENTS.search(value) and name not in ("html", "body", "main", "article"):
            out = "yes"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "yes"
    return out


def parse(page: str) -> Node:
    """The element tree of a page, without what is left out."""
    root = at = Node("html", None)
    # How many elements of each name are open: an end tag without one, and a start tag that ends none, cost nothing.
    open_: Counter[str] = Counter()
    pos = 0

    def leave(upto: Node) -> Node:
        """The parent of ``upto``, all within it closed."""
        x = at
        while x is not upto.parent:
            open_[x.name] -= 1
            x = x.parent
        return x

    while pos < len(page):
        m = _TOKEN.search(page, pos)
        text = page[pos : m.start() if m else len(page)]
        if text:
            at.kids.append(text)
        if not m:
            break
        pos = m.end()
        name, closing, empty = (m[2] or "").lower(), bool(m[1]), m[0].endswith("/>")
        if not name:  # comments, declarations
            continue
        if not closing and name in RAW and not empty:
            pos = re.compile(rf"</{re.escape(name)}\s*>|$(?!\n)", re.I).search(page, pos).end()
        elif closing:
            if open_[name] > 0:
                at = leave(next(x for x in at.up() if x.name == name))
        elif name != "html":
            # Start tags end an open paragraph or list item before them.
            ends, stop = ENDS_OWN.get(name, frozenset()), ("ul", "ol", "dl", "table") if name in ENDS_OWN else BLOCKS - {"p"}
            closes = set(ends) | ({"p"} if name in ENDS_P else set())
            for x in at.up() if any(open_[c] > 0 for c in closes) else ():
                if x.parent and x.name in closes:
                    at = leave(x)
                elif x.name in stop:
                    break
            node = Node(name, at)
            node.left_out = _left_out(name, m[3], at.in_article)
            # The body ends a head that is left open.
            if name == "body" and at.name == "head":
                node.parent = at = leave(at)
            at.kids.append(node)
            if name not in VOID and not empty:
                at = node
                open_[name] += 1
    _leave_out(root)
    return root


def _leave_out(root: Node) -> None:
    """Takes the elements to be left out from the tree, but for those that hold most of its text beside links."""
    order = [x for x in root.within()]
    own: dict[Node, int] = {}
    for x in reversed(order):
        if x.left_out == "yes" or x.name == "a":
            own[x] = 0
        else:
            own[x] = sum(own[k] if isinstance(k, Node) else len(k) - k.count(" ") - k.count("\n") for k in x.kids)
    for x in order:
        x.kids = [k for k in x.kids if isinstance(k, str) or not k.left_out or k.left_out == "maybe" and 2 * own[k] > own[root]]


def measure(node: Node) -> None:
    """Fills the counts of an element and of all in it."""
    order = node.within()[::-1]
    for x in order:
        for k in x.kids:
            if isinstance(k, Node):
                x.tags += k.tags + 1
                x.chars, x.link_chars, x.links = x.chars + k.chars, x.link_chars + k.link_chars, x.links + k.links
            else:
                x.chars += len(k) - k.count(" ") - k.count("\n")
        if x.name == "a":
            x.links, x.link_chars = x.links + 1, x.chars
    share = node.link_chars / max(node.chars, 1)
    for x in order:
        c, lc = x.chars, max(x.link_chars, 1)
        base = math.log(c * lc / max(c - x.link_chars, 1) + share * c + math.e)
        spread = c / lc * max(x.tags, 1) / max(x.links, 1)
        x.density = c / max(x.tags, 1) * math.log(max(spread, 1.0)) / math.log(max(base, math.e)) if c and base > 0 else 0.0
    for x in order:
        x.total = sum(k.density for k in x.kids if isinstance(k, Node))


def _mostly_links(x: Node) -> bool:
    return 2 * x.link_chars > x.chars


def _titled(x: Node) -> bool:
    """Whether an element is or holds a first-rank heading."""
    return any(k.name == "h1" for k in x.within())


def article_text(page: str | None) -> str:
    """The article's blocks, one to a line, white space within a block as one space."""
    root = parse(page or "")
    measure(root)
    body = next((x for x in root.within() if x.name == "body"), root)
    # Of equal sums the first in the page.
    best = max((x for x in body.within() if x.name in BLOCKS), key=lambda x: x.total, default=body)
    best = next((x for x in best.up() if x.name == "article"), best)
    path = set(best.up())
    threshold = min((x.density for x in path if x is not root), default=0.0)
    blocks: list[list[str]] = [[]]

    def emit(x: Node, inside: bool) -> None:
        stack: list[tuple] = [(x, inside)]
        while stack:
            k, inside = stack.pop()
            if isinstance(k, str):
                blocks[-1].append(html.unescape(k))
                continue
            if k is None:
                blocks.append([])
                continue
            if k.name == "br":
                blocks[-1].append(" ")
                continue
            here = inside or k is best
            if not here and k not in path and (k.density < threshold and not _titled(k) or _mostly_links(k)):
                continue
            ends = [(None, False)] if k.name in BLOCKS else []
            stack.extend(ends + [(y, here) for y in reversed(k.kids)] + ends)

    emit(body, False)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with the columns ``text`` (of the whole ``html``) and ``n_chars``, its code points.

    Null and empty pages and pages without text have an empty text. Every row has
    its own result, also rows that repeat a page_id or lack one. Columns named
    ``text`` and ``n_chars`` are replaced, all others stay. An empty table gives
    an empty one.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([article_text(p) for p in batch], dtype=object)

    out = pages.drop("text", "n_chars").withColumn("text", texts(F.col("html").cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
