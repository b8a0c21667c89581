"""Text of HTML pages as a reader sees it.

A tree builder makes elements out of the markup, with the end tags that HTML
implies (a new ``<li>`` ends the open one, a block ends an open paragraph, a
cell the cell before).  What stands in a table outside its cells and captions
goes before the table, as browsers do it.  Visibility rules take out what is not
shown; of a drawing (``svg``) the texts outside definitions stay.  The rest
is laid out: blocks on lines of their own, a blank line around paragraphs and
headings, list items with their mark and indent, preformatted text as it is,
and tables as rows of cells padded to common column widths.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, read, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never shown.
HIDDEN = frozenset("head script style template noscript title meta link iframe object embed audio video canvas "
                   "datalist param source track noembed noframes area base".split())
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split())
BLOCKS = SPACED | frozenset("html body div section article nav aside header footer main address form li dt dd "
                            "figcaption details summary center legend tr caption option optgroup menu dialog".split())
#: Not drawn where they stand in an svg.
UNDRAWN = HIDDEN | frozenset("defs symbol desc metadata clippath mask pattern marker lineargradient radialgradient filter".split())
#: Opening one of these ends open ones of those, up to the nearest of the last.
_CELLS, _ROWS, _GROUPS = ("td", "th"), ("tr",), ("thead", "tbody", "tfoot")
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (_CELLS, ("tr", "table")), "th": (_CELLS, ("tr", "table")), "tr": ((*_CELLS, *_ROWS), ("table",)),
    **{g: ((*_CELLS, *_ROWS, *_GROUPS, "caption", "colgroup"), ("table",)) for g in _GROUPS},
    **{g: ((*_CELLS, *_ROWS, *_GROUPS, "caption", "colgroup"), ("table",)) for g in ("caption", "colgroup")},
    # a table in a table, but not in a cell, ends the outer one
    "table": (("table",), (*_CELLS, "caption", "template")),
    "body": (("head",), ("html",)),
}
#: Elements between a table and its cells, and what may stand in them.
FRAME = frozenset(("table", *_GROUPS, *_ROWS, "colgroup"))
FRAMED = FRAME - {"table"} | {*_CELLS, "caption", "col", "script", "style", "template"}
ENDS_PARAGRAPH = (BLOCKS - {"html", "body", "tr", "option", "optgroup", "caption", "legend"}) | {"li", "dt", "dd"}
#: Tables in tables that keep their columns.
MAX_TABLES = 20
#: Elements that an end tag inside does not reach beyond.
SCOPES = frozenset(("table", "td", "th", "caption", "button", "template", "html"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?"
    # a start tag; values with "<" or ">" in them are left to tag_end
    r"|<([a-zA-Z][^\s/><]*+)(?:((?:[\s/]++|[^\s/><][^\s/><=]*+"
    r"(?:\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|(?![\"'])[^\s><]*+)|(?!\s*+=)))*+)>)?", re.DOTALL)
#: One attribute, up to the quote of its value if it has one.
_PART = re.compile(r"[\s/]*+(?:[^\s/><][^\s/><=]*+(?:\s*+=\s*+(?:([\"'])|[^\s><\"'][^\s><]*+)?+)?+)?+")
_REST = re.compile(r"[^<>]*+")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)")


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Element | str] = []

    def get(self, name: str) -> str | None:
        """Value of an attribute; empty if it has none, None if it is absent."""
        if name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None


def tag_end(markup: str, at: int, failed: set[int]) -> int:
    """Where the ">" stands that ends the start tag whose name ends at ``at``;
    -1 if there is none.  Quoted values of any length hide a ">"; without the
    closing quote the next ">" ends the tag.  ``failed``: quotes of this page
    that begin no value of a whole tag; none is followed twice."""
    begin, quotes = at, []
    while True:
        m = _PART.match(markup, at)
        if m[1]:
            quote = m.end() - 1
            if quote in failed:
                break
            quotes.append(quote)
            at = markup.find(m[1], quote + 1) + 1
            if not at:
                break
        elif m.end() > at:
            at = m.end()
        elif markup.startswith(">", at):
            return at
        else:
            break
    failed.update(quotes)
    at = _REST.match(markup, begin).end()
    return at if markup.startswith(">", at) else -1


def build(markup: str) -> Element:
    """The tree of a page."""
    root = Element("root")
    open_ = [root]
    opened: Counter = Counter()
    at, scan, size = 0, 0, len(markup)
    failed: set[int] = set()

    def put(node: Element | str) -> None:
        """Add to the open element; before the table what may not stand in its frame."""
        if open_[-1].tag in FRAME and opened["table"] and (
                node.strip(" \t\n\r\f") if isinstance(node, str) else node.tag not in FRAMED):
            k = len(open_) - 1
            while open_[k].tag != "table":
                k -= 1
            open_[k - 1].children.insert(-1, node)  # an open table is the last child
        else:
            open_[-1].children.append(node)

    def text(raw: str) -> None:
        if raw:
            put(html.unescape(raw) if "&" in raw else raw)

    def close(tags: tuple[str, ...] | frozenset, stop: tuple[str, ...] | frozenset) -> None:
        """End the outermost open element of ``tags`` above the nearest ``stop``."""
        if not any(opened[t] for t in tags):
            return
        cut = None
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in stop:
                break
            if open_[k].tag in tags:
                cut = k
        if cut is not None:
            drop(cut)

    def drop(cut: int) -> None:
        opened.subtract(x.tag for x in open_[cut:])
        del open_[cut:]

    while at < size:
        m = _TOKEN.search(markup, max(at, scan))
        if not m:
            text(markup[at:])
            break
        end_at = m.end()
        if m[2] and m[3] is None:
            end_at = tag_end(markup, m.end(2), failed) + 1
            if not end_at:  # no tag: text
                scan = m.end(2)
                continue
        text(markup[at:m.start()])
        at = end_at
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                put(Element("br"))
                continue
            stop = SCOPES - {tag} if tag not in ("table", "html", "body") else frozenset()
            for k in range(len(open_) - 1, 0 if opened[tag] else len(open_), -1):
                if open_[k].tag == tag:
                    drop(k)
                    break
                if open_[k].tag in stop and not (tag in ("tr", *_GROUPS) and open_[k].tag in _CELLS):
                    break
        elif m[2]:
            tag = m[2].lower()
            attributes = markup[m.end(2):at - 1]
            if tag in ENDS_PARAGRAPH:
                close(("p",), SCOPES)
            if tag[0] == "h" and tag[1:].isdigit() and open_[-1].tag[:1] == "h" and open_[-1].tag[1:].isdigit():
                drop(len(open_) - 1)
            if tag in CLOSES:
                close(*CLOSES[tag])
            if opened["table"] and (tag in FRAMED and tag not in HIDDEN):  # ends what was put before the table
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag in FRAME:
                        drop(k + 1)
                    if open_[k].tag in FRAME or open_[k].tag in _CELLS or open_[k].tag == "template":
                        break
            if tag == "form" and opened["table"] and open_[-1].tag in FRAME:
                continue  # holds no cells
            node = Element(tag, attributes)
            put(node)
            if tag in RAW:
                end = re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(markup, at)
                stop_at = end.start() if end else size
                body = markup[at:stop_at]
                node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
                at = markup.find(">", stop_at) + 1 if end and markup.find(">", stop_at) >= 0 else (stop_at if not end else size)
            elif tag not in VOID and not attributes.endswith("/") or tag in BLOCKS and tag not in VOID:
                open_.append(node)
                opened[tag] += 1
    return root


def visible(node: Element) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attributes:
        return True
    if node.get("hidden") is not None:
        return False
    if node.tag == "input" and (node.get("type") or "").lower() == "hidden":
        return False
    if node.tag == "dialog" and node.get("open") is None:
        return False
    style = node.get("style")
    return not (style and _GONE.search(style))


class Page:
    """Lines of a laid-out page; ``gap``: blank lines that the next text needs
    above it (None: the line is open)."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap: int | None = 0
        self.prefix = ""
        self.first = ""
        self.space = False

    def add(self, text: str) -> None:
        body = _SPACE.sub(" ", text)
        if not body:
            return
        if body == " ":
            self.space = bool(self.now)
            return
        if body[0] == " ":
            self.space = bool(self.now)
        if not self.now:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.now.append(self.head())
        elif self.space:
            self.now.append(" ")
        self.space = body[-1] == " "
        self.now.append(body.strip(" "))
        self.gap = None

    def head(self) -> str:
        """What begins a line: the indent, its end replaced by a list mark that waits."""
        first, self.first = self.first, ""
        return self.prefix[:len(self.prefix) - len(first)] + first

    def line(self) -> None:
        """End the open line."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
            self.gap = 0
        self.space = False

    def block(self, blank: int) -> None:
        self.line()
        if not self.first:  # the first block of a list item stands beside its mark
            self.gap = max(self.gap or 0, blank)

    def whole(self, lines: list[str]) -> None:
        """Lines that stand as they are."""
        self.line()
        if lines:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.lines.append((self.head() + lines[0]).rstrip(" "))
            self.lines += [(self.prefix + x).rstrip(" ") for x in lines[1:]]
            self.gap = 0

    def text(self) -> str:
        self.line()
        return "\n".join(self.lines)


def _drawn(svg: Element) -> list[Element]:
    """Texts and embedded markup of a drawing, without what is only defined in it."""
    shown = lambda x: (x.tag not in UNDRAWN and visible(x)
                       and (x.get("display") or "").strip().lower() != "none"
                       and (x.get("visibility") or "").strip().lower() not in ("hidden", "collapse"))
    out, stack = [], [(svg, None)]
    while stack:
        x, text = stack.pop()
        if isinstance(x, str):
            if text:
                text.children.append(x)
            continue
        if not shown(x):
            continue
        if x.tag == "foreignobject":
            out.append(Element("div"))
            out[-1].children = x.children
            continue
        if x.tag == "text" and not text:
            text = Element("div")
            out.append(text)
        stack += ((c, text) for c in reversed(x.children))
    return out


def _plain(node: Element) -> str:
    """Text of preformatted content."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif x is node or visible(x):
            stack += reversed(_drawn(x) if x.tag == "svg" else x.children)
    return "".join(out)


def _rows(table: Element) -> tuple[list[Element], list[list[Element]]]:
    captions, rows = [], []
    stack = list(reversed(table.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str) or not visible(x):
            continue
        if x.tag == "tr":
            rows.append([c for c in x.children if isinstance(c, Element) and c.tag in _CELLS and visible(c)])
        elif x.tag == "caption":
            captions.append(x)
        elif x.tag in _CELLS:
            rows.append([x])
        else:
            stack += reversed(x.children)
    return captions, [r for r in rows if r]


def _table(page: Page, table: Element, depth: int) -> None:
    captions, rows = _rows(table)
    for c in captions:
        page.block(0)
        layout(page, c, depth + 1)
        page.block(0)
    grid: list[list[tuple[int, str]]] = []  # (column, text) of the cells with text
    spans: list[tuple[int, int, int]] = []  # columns from, to, and last row, of cells that reach into this row
    for r, row in enumerate(rows):
        spans = sorted(s for s in spans if s[2] >= r)
        cells: list[tuple[int, str]] = []
        down: list[tuple[int, int, int]] = []
        at = k = 0
        for c in row:
            while k < len(spans) and spans[k][0] <= at:
                at = max(at, spans[k][1])
                k += 1
            inner = Page()
            layout(inner, c, depth + 1)
            value = " / ".join(x.strip() for x in inner.text().split("\n") if x.strip())
            span = [min(max(int(s), 1), 1000) if (s := (c.get(a) or "").strip()).isdecimal() and s.isascii() else 1
                    for a in ("colspan", "rowspan")]
            if span[1] > 1 and r + 1 < len(rows):
                down.append((at, at + span[0], r + span[1] - 1))
            if value:
                cells.append((at, value))
            at += span[0]
        spans += down
        if cells:
            grid.append(cells)
    # only columns that hold text take room; a very wide cell does not pad its column
    width = {k: 0 for row in grid for k, _ in row}
    for row in grid:
        for k, x in row:
            if len(x) <= 80:
                width[k] = max(width[k], len(x))
    if len(width) == 1:
        page.whole([row[0][1] for row in grid])
        return
    left, place = 0, {}
    for k in sorted(width):
        place[k] = left
        left += width[k] + 2
    lines = []
    for row in grid:
        line, size, wider = [], 0, 0
        for k, x in row:
            start = place[k] + wider
            line += [" " * (start - size), x]
            size = start + len(x)
            wider += max(0, len(x) - width[k])
        lines.append("".join(line))
    page.whole(lines)


def layout(page: Page, top: Element, depth: int = 0) -> None:
    """Lay out the children of an element, by a work list; only tables in
    tables recurse, and below ``MAX_TABLES`` their rows are plain blocks."""
    work: list = [*reversed(top.children)]
    lists: list[list] = []
    while work:
        x = work.pop()
        if isinstance(x, str):
            page.add(x)
            continue
        if isinstance(x, tuple):
            kind, blank, prefix = x
            page.block(blank)
            if kind == "list":
                lists.pop()
            if kind == "li":
                page.first = ""
            page.prefix = prefix
            continue
        if not visible(x):
            continue
        tag = x.tag
        if tag == "br":
            if page.now:
                page.line()
            else:
                page.gap = max(page.gap or 0, 1)
        elif tag == "hr":
            page.block(1)
        elif tag == "img":
            page.add(x.get("alt") or "")
        elif tag == "input":
            if (x.get("type") or "text").lower() in ("text", "submit", "button", "reset"):
                page.add(x.get("value") or "")
        elif tag == "svg":
            work += reversed(_drawn(x))
        elif tag in ("pre", "textarea"):
            page.block(1)
            raw = _plain(x)
            page.whole([y.rstrip() for y in raw.expandtabs(8).strip("\n").split("\n")] if raw.strip() else [])
            page.block(1)
        elif tag == "table" and depth < MAX_TABLES:
            page.block(1)
            _table(page, x, depth)
            page.block(1)
        elif tag in BLOCKS:
            nested = tag in ("ul", "ol", "menu") and lists
            blank = int(tag in SPACED and not nested)
            page.block(blank)
            old = page.prefix
            if tag in ("ul", "ol", "menu"):
                start = x.get("start") or ""
                lists.append([tag, int(start) if start.isdecimal() and start.isascii() and len(start) < 10 else 1])
                work.append(("list", blank, old))
            else:
                work.append((tag, blank, old))
            if tag == "li":
                if lists and lists[-1][0] == "ol":
                    page.first = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    page.first = "- "
                page.prefix = old + " " * len(page.first)
            elif tag in ("dd", "blockquote"):
                page.prefix = old + "  "
            work += reversed(x.children)
        else:
            if tag in _CELLS:
                page.add(" ")
            if tag == "q":
                work.append("”")
                page.add("“")
            work += reversed(x.children)


def visible_text(markup: str | None) -> str:
    """Visible text of a page; null and empty markup have none."""
    if not markup:
        return ""
    page = Page()
    layout(page, build(markup))
    return page.text()


def extract(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """Add the visible text of each page as ``out`` (a column of that name is
    replaced).  Null markup gives an empty text; repeated rows each give a
    row; an empty table gives none."""
    pages = pages.drop(out)
    keep = pages.columns
    schema = extended(pages, **{out: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            texts = [visible_text(x) for x in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string())],
                                             [*keep, out])

    return pages.mapInArrow(run, schema)


def op9_layout(spark, sf_dir: str) -> DataFrame:
    """Visible text of all ``pages``."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
