"""Main text of web pages by composite text density.

A page is read into a tree of elements.  Elements that never hold an article's text (menus,
scripts, forms and the like, by tag, role or a whole word of class or id) are left out; one
that is only named so stays if it holds an article, a main part or most of the text.  The
density of an element is its characters per tag, adjusted for its links: with C characters,
T tags, LC link characters and LT link tags, inside a body whose share of link characters is s,

    C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + s * C + e)

where an empty count stands for 1.  The element whose children's densities add up to
most leads to the article: to the article or main part around it, else to the container it
is in, as a paragraph or heading is never all of a text.  All that stands in there is text.  Without
an article or main part, the least density on the way from the container up to the body is the
threshold: subtrees outside that reach it belong to the text as well, and lists of links inside do not.

Each row is handled on its own, so the work is one pass over the pages without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from llm.words import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
OUTSIDE = frozenset("nav header footer aside form button select dialog menu object audio video canvas head svg".split())
FOREIGN = frozenset(("svg", "math"))  # in these a tag that ends in a slash is empty, whatever its name
HTML_IN_FOREIGN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
LEAVES_FOREIGN = frozenset(  # these cannot stand in an svg or math, which ends where they start
    "b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li menu nobr ol p pre ruby s small span strong strike sub sup "
    "table tt u ul var".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr "
                   "math annotation annotation-xml maction menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom "
                   "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
CLOSES = {  # an opening tag ends these open elements, up to the element after the colon
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
BOUNDARY = frozenset("body article section div main table td th ul ol dl li blockquote figure details fieldset".split())
NAMES = frozenset(  # whole words of a class, or an id
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner sidebar side-bar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead site-header page-header cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond replies reply widget "
    "pagination pager toolbar disclaimer copyright legal skip-link".split()
)
CONTAINERS = frozenset("body article main section div td".split())
SEMANTIC = ("article", "main")
ARTICLE_SHARE = 10  # an article or main part counts unless something else holds so many times its text
MENU_LINKS, MENU_PERCENT = 3, 90  # a list of at least so many links that hold so much of its text
SLUGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())  # their ids come from their own words
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|!--|[!?])")
_PLAIN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|!--|[!?])")
_ATTRIBUTE = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Element:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "own", "named")

    def __init__(self, tag: str, parent: Element | None, named: bool = False) -> None:
        self.tag, self.parent, self.named = tag, parent, named
        self.parts: list[Element | str] = []
        self.own = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _outside(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether it is named like those that hold no article."""
    if tag in OUTSIDE:
        return True, False
    if tag in ("html", "body", "article", "main") or not attributes:
        return False, False
    named = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
        if name == "class" or name == "id" and tag not in SLUGS:
            named = named or not NAMES.isdisjoint(value.lower().split())
        elif name == "role":
            named = named or value.lower() in ROLES
    return False, named


class _Open:
    """The open elements, each with whether it is left out, and where each tag was opened last."""

    def __init__(self, body: Element) -> None:
        self.items: list[tuple[Element, bool]] = [(body, False)]
        self.places: dict[str, list[int]] = {}

    def last(self, *tags: str) -> int:
        """Place of the innermost open element with one of the tags; 0 is the body's."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, element: Element, skipped: bool) -> None:
        for name in _names(element.tag):
            self.places.setdefault(name, []).append(len(self.items))
        self.items.append((element, skipped))

    def cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.items) > place:
            for name in _names(self.items.pop()[0].tag):
                self.places[name].pop()


@cache
def _names(tag: str) -> tuple[str, ...]:
    groups = (("#boundary", BOUNDARY), ("#foreign", FOREIGN), ("#html", HTML_IN_FOREIGN))
    return (tag, *(name for name, tags in groups if tag in tags))


def parse(page: str) -> Element:
    """The tree below the body, without the elements that are left out; those only named so are marked."""
    body = Element("body", None)
    open_ = _Open(body)
    at, tags = 0, _TAG
    while True:
        lt = page.find("<", at)
        here, skipped = open_.items[-1]
        if lt < 0:
            if not skipped:
                here.parts.append(page[at:])
            return body
        found = tags.match(page, lt)
        if found is None and tags is _TAG and lt + 1 < len(page) and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
            tags = _PLAIN  # a quote that is never closed: attributes end at the next bracket from here on
            found = tags.match(page, lt)
        if not skipped and lt > at:
            here.parts.append(page[at:lt])
        if found is None:
            if not skipped:
                here.parts.append("<")
            at = lt + 1
            continue
        at = found.end()
        if found[2] is None:  # a comment or declaration
            end = page.find("-->" if found[0] == "<!--" else ">", at)
            if end < 0:
                return body
            at = end + (3 if found[0] == "<!--" else 1)
            continue
        tag = found[2].lower()
        if found[1]:
            place = open_.last(tag)
            if place and not (tag in INLINE and open_.last("#boundary") > place):
                open_.cut(place)
            continue
        place = open_.last("#foreign")
        inside = place > open_.last("#html")  # in an svg or math
        if inside and tag in LEAVES_FOREIGN:
            open_.cut(place)
            inside = False
        if tag in RAW and not (inside and found[3].endswith("/")):
            end = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("html", "body"):
            continue
        if tag not in INLINE and not inside:  # a block ends an open paragraph with what stands in it
            place = open_.last("p")
            if place > open_.last("#boundary"):
                open_.cut(place)
        if tag in CLOSES:
            ended, scope = CLOSES[tag]
            place = open_.last(*ended)
            if place > open_.last(*scope):
                open_.cut(place)
        here, skipped = open_.items[-1]
        outside, named = (True, False) if skipped else _outside(tag, found[3])
        element = Element(tag, here, named)
        if not outside:
            here.parts.append(element)
        if tag not in VOID and not found[3].endswith("/"):
            open_.push(element, outside)


def _below(body: Element) -> list[Element]:
    found = [body]
    for element in found:
        found.extend(p for p in element.parts if isinstance(p, Element))
    return found


def _elements(body: Element) -> list[Element]:
    """All elements, each before what stands in it; those named like no article go if they hold little."""
    found = _below(body)
    for e in found:
        e.own = sum(len(" ".join(html.unescape(p).split())) for p in e.parts if isinstance(p, str))
    if not any(e.named for e in found):
        return found
    chars, holds = {id(e): e.own for e in found}, set()
    for e in reversed(found[1:]):
        chars[id(e.parent)] += chars[id(e)]
        if e.tag in ("article", "main") or id(e) in holds:
            holds.add(id(e.parent))
    article = id(body) in holds  # then nothing else needs to be the text, however much of it there is
    gone = {id(e) for e in found if e.named and id(e) not in holds and (article or 2 * chars[id(e)] <= chars[id(body)])}
    for e in found:
        e.parts = [p for p in e.parts if id(p) not in gone]
    return _below(body)


def measure(elements: list[Element]) -> None:
    """Fill in counts, densities and sums of child densities."""
    for e in reversed(elements):
        e.chars += e.own
        if e.tag == "a":
            e.link_chars, e.link_tags = e.chars, e.link_tags + 1
        if e.parent is not None:
            up = e.parent
            up.chars += e.chars
            up.tags += e.tags + 1
            up.link_chars += e.link_chars
            up.link_tags += e.link_tags
    body = elements[0]
    share = body.link_chars / max(1, body.chars)
    for e in elements:
        if e.chars:
            tags = e.tags or 1
            inner = e.chars / max(1, e.chars - e.link_chars) * e.link_chars + share * e.chars + math.e
            ratio = e.chars / (e.link_chars or 1) * tags / (e.link_tags or 1)
            e.density = e.chars / tags * math.log(max(ratio, 1.0)) / math.log(math.log(inner) + 1e-9 if math.log(inner) > 1.01 else math.e)
    for e in elements[1:]:
        e.parent.total += e.density


def _up(e: Element, tags) -> Element | None:
    while e is not None and e.tag not in tags:
        e = e.parent
    return e


def _article(elements: list[Element], best: Element) -> Element | None:
    """The article or main part around the densest element, else the one in it that holds most of its text."""
    for tag in SEMANTIC:
        around = _up(best, (tag,))
        if around is not None:
            return around
    for tag in SEMANTIC:
        inside = [e for e in elements if e.tag == tag]
        if inside:
            most = max(inside, key=lambda e: e.chars - e.link_chars)
            if ARTICLE_SHARE * (most.chars - most.link_chars) >= best.chars - best.link_chars:
                return most
    return None


def _chosen(elements: list[Element]) -> tuple[list[Element], bool]:
    """Roots of the subtrees that make up the text, in page order, and whether lists of links stand in them for menus."""
    body = elements[0]
    best = max(elements, key=lambda e: e.total)  # the outermost of equals
    if not best.total:
        best = max(elements, key=lambda e: e.density)
    found = _article(elements, best)
    if found is not None:
        return [found], False
    best = _up(best, CONTAINERS)
    if best is body:
        return [body], True
    on_path, threshold, e = set(), best.density, best
    while e is not None:
        on_path.add(id(e))
        threshold = min(threshold, e.density)
        e = e.parent
    roots, todo = [], [body]
    while todo:
        e = todo.pop()
        if e is best or id(e) not in on_path and e.density >= threshold:
            roots.append(e)
        else:
            todo.extend(p for p in reversed(e.parts) if isinstance(p, Element))
    return roots, True


def _is_menu(e: Element) -> bool:
    return e.tag in ("ul", "ol", "div", "section", "table", "dl") and e.link_tags >= MENU_LINKS and 100 * e.link_chars >= MENU_PERCENT * e.chars


def _blocks(root: Element, lines: list[str], without_menus: bool) -> None:
    current: list[str] = []

    def flush() -> None:
        line = " ".join(html.unescape("".join(current)).split())
        if line:
            lines.append(line)
        current.clear()

    todo: list[Element | str | None] = [root]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            current.append(part)
        elif part.tag in ("br", "wbr"):
            current.append(" ")
        elif without_menus and part is not root and _is_menu(part):
            flush()
        else:
            block = part.tag not in INLINE
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(part.parts))
    flush()


def main_text(page: str | None) -> str:
    """The article's text, one block per line; empty for a null or empty page."""
    if not page:
        return ""
    elements = _elements(parse(page))
    measure(elements)
    lines: list[str] = []
    roots, without_menus = _chosen(elements)
    for root in roots:
        _blocks(root, lines, without_menus)
    return "\n".join(lines)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "html"):
            texts = [main_text(page) for page in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars; every row gives one row, null html an empty text.

    Repeated rows give repeated rows, other columns are not read, and an empty table gives no row.  A very
    long page is held by its own task, in time proportional to its length.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
