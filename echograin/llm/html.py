"""Main-text extraction by tree scoring.

Every paragraph passes points, one plus its commas plus one for each hundred characters up to three, to its five nearest
ancestors: all to the parent, half to the grandparent, a third part and less beyond. A container's points are discounted
by its link density. The best container is kept with those siblings that score well themselves or read as paragraphs,
and with the headline before it; an article or main element around the best container stands in for it. Everything
inside is kept, block by block, except furniture: menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts and styles.

Furniture is known by its element, its role or a name among its classes and id. Names that tell a layout ("has-sidebar",
"modal-open") or an article's own parts ("entry-header") do not count, nor does any of it for an element that holds an
article or main element or more than half of the page's text (comments: nine tenths): that is a wrapper.

A page is parsed and scored by itself in Arrow batches, so there is no shuffle and memory is bounded by one page. Work is
proportional to the page's length: tags are scanned once, open elements are counted by name, points go up five steps,
and elements nest ``MAX_DEPTH`` deep at most (deeper ones become siblings, as in browsers).

Defined cases: null, empty or text-free html gives an empty text; text outside any tag counts as a block; unclosed and
stray tags are mended as browsers do; a page without a scored paragraph gives all its text but furniture; repeated rows
are extracted each for itself; an empty table gives an empty result; other columns of the caller's table are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, text_slices

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
NEVER = frozenset("script style noscript template iframe object embed svg canvas head title select option input textarea".split())
FURNITURE = frozenset("nav footer aside form button label menu dialog".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Names by which pages mark furniture, comments, layouts, an article's own parts and its text.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side"
    " cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription share sharing social related recommended menu nav"
    " navbar navigation breadcrumb breadcrumbs footer header masthead pagination pager widget toolbar login signup search".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
LAYOUT_NAMES = frozenset("has no not with without is show hide js layout open closed fixed sticky enabled disabled".split())
ARTICLE_NAMES = frozenset("entry post article story content section".split())
TEXT_NAMES = frozenset("content main article post entry story article-body post-content entry-content article-content story-body main-content maincontent".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "tfoot", "thead", "tr", "li", "dd", "dt", "summary", "figcaption"}
#: An opening tag of the key closes an open element of the value, unless one of the barriers is nearer.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}

#: Elements that an opening tag of the key closes for good; the search for them ends there.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}}
P_SCOPE = frozenset(("button", "td", "th", "table", "body"))

MIN_PARAGRAPH = 25
SIBLING_SHARE = 0.2
MAX_DEPTH = 512
LEVELS = 5
WRAPPER_SHARE, COMMENTS_SHARE = 0.5, 0.9
HEADLINE_CHARS, HEADLINE_LEVELS = 400, 3

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACES = re.compile(r"\s+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "score", "dropped", "depth", "p")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.attributes, self.score = tag, parent, attributes, 0.0
        self.children: list[Node | str] = []
        self.dropped = False
        self.depth = parent.depth + 1 if parent else 0
        #: The open p that a block inside this element would close.
        self.p: Node | None = self if tag == "p" else None if parent is None or tag in P_SCOPE else parent.p


def _within(node: Node | None, tags: tuple[str, ...]) -> Node | None:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def names_of(classes: str) -> Iterator[tuple[str, list[str]]]:
    for token in classes.split():
        token = _HUMP.sub("-", token).lower().replace("_", "-").strip("-")
        yield token, token.split("-")


def named(token: str, parts: list[str], names: frozenset[str]) -> bool:
    """Whether a class or id is one of ``names``, alone or as the first or last part of a compound that tells no layout
    and no part of an article."""
    if token in names:
        return True
    if not LAYOUT_NAMES.isdisjoint(parts) or (parts[0] in ARTICLE_NAMES and parts[-1] in ("header", "heading", "title", "banner")):
        return False
    return parts[0] in names or parts[-1] in names


def furniture_share(node: Node) -> float | None:
    """None if the element is no furniture, else the share of the page's text up to which it is."""
    tag = node.tag
    if tag in NEVER:
        return 2.0
    if tag == "form" or (tag == "header" and _within(node.parent, ("article", "main")) is None):
        return WRAPPER_SHARE
    if tag in FURNITURE:
        return 1.0
    if not node.attributes or tag in ("html", "body"):
        return None
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(node.attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return WRAPPER_SHARE
    names = [*names_of(found.get("class", "")), *names_of(found.get("id", ""))]
    if any(named(*x, COMMENT_NAMES) for x in names):
        return COMMENTS_SHARE
    if tag in ("article", "main") or any(token in TEXT_NAMES for token, _ in names):
        return None
    if found.get("role", "").lower() in FURNITURE_ROLES or any(named(*x, FURNITURE_NAMES) for x in names):
        return WRAPPER_SHARE
    return None


def parse(page: str) -> Node:
    top = here = Node("#document", None)
    open_: Counter[str] = Counter()
    at, missed, size = 0, 0, len(page)
    last_end = page.rfind(">")

    def close(node: Node) -> None:
        nonlocal here
        while here is not node:
            open_[here.tag] -= 1
            here = here.parent
        open_[node.tag] -= 1
        here = node.parent or top

    def add_text(text: str) -> None:
        if here.tag == "head" and text.strip():
            close(here)
        if text:
            here.children.append(entities.unescape(text))

    while at < size:
        start = page.find("<", at)
        # Behind the last > no tag ends: what is there is text.
        if start < 0 or start > last_end:
            break
        sign = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            add_text(page[at:start])
            if page.startswith((">", "->"), start + 4):
                at = page.index(">", start) + 1
            else:
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
            continue
        if sign in ("!", "?"):
            add_text(page[at:start])
            at = page.index(">", start) + 1
            continue
        m = None
        if sign.isalpha() or sign == "/":
            # Quotes that do not pair make this scan fail at the page's end; it is given up when it failed too often.
            if missed < 8 * size + 4096:
                m = _TAG.match(page, start)
                if m is None:
                    missed += size - start
            if m is None:
                m = _LOOSE.match(page, start)
        if m is None:
            if sign == "/":  # an end tag without a name is a comment
                add_text(page[at:start])
                at = page.index(">", start) + 1
            else:
                add_text(page[at : start + 1])
                at = start + 1
            continue
        add_text(page[at:start])
        at = m.end()
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if open_[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
            elif tag == "br":
                here.children.append(" ")
            continue
        if open_["head"] > 0 and tag not in IN_HEAD and tag != "head":
            node = here
            while node.tag != "head":
                node = node.parent
            close(node)
        if tag in CLOSES_P and here.p is not None:
            close(here.p)
        if tag in CLOSES and any(open_[x] > 0 for x in CLOSES[tag]):
            node, last = here, None
            while node is not top and node.tag not in BARRIERS[tag]:
                if node.tag in CLOSES[tag]:
                    last = node
                    if node.tag in ENDS[tag]:
                        break
                node = node.parent
            if last is not None:
                close(last)
        node = Node(tag, here, attributes)
        here.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.end() if end else size
            continue
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            if node.depth >= MAX_DEPTH:
                close(here)  # the deepest element ends, so that this one stands beside it
                here.children.append(node)
                node.parent.children.pop()
                node.parent, node.depth = here, here.depth + 1
                node.p = node if tag == "p" else None if tag in P_SCOPE else here.p
            here = node
            open_[tag] += 1
    add_text(page[at:])
    return top


def _order(top: Node) -> list[Node]:
    """Nodes that are not inside furniture, parents first, in page order; marks furniture."""
    every, stack = [], [top]
    while stack:
        node = stack.pop()
        every.append(node)
        stack.extend(child for child in reversed(node.children) if isinstance(child, Node))
    share: dict[int, float | None] = {id(n): furniture_share(n) for n in every}
    size: dict[int, int] = {}
    holds: dict[int, bool] = {}  # an article or main element that is none of furniture
    for node in reversed(every):
        n, found = 0, False
        for child in node.children:
            if isinstance(child, str):
                n += len(child) if not child.isspace() else 0
            elif child.tag not in NEVER:
                n += size[id(child)]
                found |= holds[id(child)] or (child.tag in ("article", "main") and share[id(child)] is None)
        size[id(node)], holds[id(node)] = n, found
    whole = max(1, size[id(top)])
    for node in every:
        limit = share[id(node)]
        node.dropped = limit is not None and (limit > 1 or (not holds[id(node)] and size[id(node)] <= limit * whole))
    found, stack = [], [top]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(child for child in reversed(node.children) if isinstance(child, Node) and not child.dropped)
    return found


def blocks(tops: list[Node]) -> list[str]:
    """Block texts below the given nodes, white space made single; explicit stack, so depth is no limit."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACES.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = list(reversed(tops))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.dropped:
            if x.tag in ("br", "td", "th"):
                run.append(" ")
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def best_nodes(top: Node) -> list[Node]:
    nodes = _order(top)
    text_size: dict[int, int] = {}
    link_size: dict[int, int] = {}
    commas: dict[int, int] = {}
    own: dict[int, int] = {}  # letters not inside a block child: makes a div or cell a paragraph
    for node in reversed(nodes):
        size = links = comma = direct = 0
        for child in node.children:
            if isinstance(child, str):
                n = len(child) if not child.isspace() else 0
                size, direct, comma = size + n, direct + n, comma + child.count(",") + child.count("，") + child.count("、")
            elif not child.dropped:
                size, links, comma = size + text_size[id(child)], links + link_size[id(child)], comma + commas[id(child)]
                direct += 0 if child.tag in BLOCK else own[id(child)]
        text_size[id(node)], commas[id(node)], own[id(node)] = size, comma, direct
        link_size[id(node)] = size if node.tag == "a" else links
    density = lambda n: link_size[id(n)] / text_size[id(n)] if text_size[id(n)] else 0.0
    containers: dict[int, Node] = {}
    for node in nodes:
        if (node.tag in BLOCK or node.tag in ("td", "th")) and own[id(node)] >= MIN_PARAGRAPH and node.parent is not None:
            points = 1 + commas[id(node)] * (own[id(node)] / text_size[id(node)]) + min(own[id(node)] / 100, 3)
            level, above = 0, node.parent
            while above is not None and level < LEVELS:
                above.score += points / (1, 2)[level] if level < 2 else points / (3 * level)
                containers[id(above)] = above
                level, above = level + 1, above.parent
    if not containers:
        return [top]
    value = lambda n: n.score * (1 - density(n))
    best = max(containers.values(), key=value)  # the first in page order among equals
    around = _within(best, ("article", "main"))
    if around is not None and density(around) < 0.5:
        best = around
    if best.parent is None:
        return [best]
    keep, least = [], max(10.0, SIBLING_SHARE * value(best))
    before = True
    for child in best.parent.children:
        if child is best:
            keep.append(child)
            before = False
        elif isinstance(child, Node) and not child.dropped:
            size, links = text_size[id(child)], density(child)
            reads = child.tag == "p" and ((size > 80 and links < 0.25) or (0 < size <= 80 and links == 0))
            if reads or value(child) >= least or (before and is_headline(child, size, links)):
                keep.append(child)
    # The headline may stand before a wrapper of the best container.
    if not any(has_h1(n) for n in keep):
        above = best.parent
        for _ in range(HEADLINE_LEVELS):
            if above.parent is None:
                break
            for child in above.parent.children:
                if child is above:
                    break
                if isinstance(child, Node) and not child.dropped and is_headline(child, text_size[id(child)], density(child)):
                    return [child, *keep]
            above = above.parent
    return keep


def has_h1(node: Node) -> bool:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag == "h1":
            return True
        stack.extend(c for c in n.children if isinstance(c, Node) and not c.dropped)
    return False


def is_headline(node: Node, size: int, links: float) -> bool:
    return 0 < size <= HEADLINE_CHARS and links < 0.5 and has_h1(node)


def extract(page: str | None) -> str:
    """The page's main text, blocks joined by an empty line."""
    return "\n\n".join(blocks(best_nodes(parse(page)))) if page else ""


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for batch in text_slices(batches, "html", 8 << 20):
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield rows_of(schema, [batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts])


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (never null), n_chars for each row of ``pages``."""
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    found = own.mapInArrow(_extract_batches, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
