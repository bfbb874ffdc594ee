"""Visible text of HTML pages, laid out as a reader would see it."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import slices

BATCH_BYTES = 4 << 20
#: Cells before the last column are wrapped at blanks beyond this width, so that columns stay aligned (a longer word is left whole).
WRAP = 120
#: Lines are indented by this much at most; blanks that align cells, a character of the page at most (a table beyond that has its cells two blanks apart).
MAX_INDENT, PADDING = 40, 16
#: Tables deeper in the cells of others show cell under cell; columns from here on are not kept free by cells over several rows.
MAX_NESTED, MAX_COLUMNS = 8, 1000
#: Greatest spans of the HTML standard.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE_RAW = frozenset(("title", "textarea"))
UNSEEN = frozenset("head script style title meta link base template noscript iframe noembed noframes object audio video canvas datalist desc defs metadata annotation annotation-xml".split())
IN_HEAD = frozenset("base link meta title script style noscript template head html".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp caption textarea".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre blockquote figure hr fieldset xmp".split())
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "caption", "textarea"}
#: What a start tag closes, and what stops the search for it.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "a": (frozenset(["a"]), frozenset(["td", "th", "table", "li", "p"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    **{t: (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")},
}
WALLS = frozenset("td th caption table template object".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?=(\S))([^\s>\"'][^\s>]*)?)?|[\s/]+")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_DECLARATION = re.compile(r"""\s*([-\w]+)\s*:((?:[^;"'(]|"[^"]*"|'[^']*'|\([^)]*\))*)""")


def declarations(style: str) -> dict[str, str]:
    """Properties of a style attribute in lower case; the last one counts, an important one before others."""
    out, important = {}, set()
    style = _COMMENT.sub("", style)
    at = 0
    while at < len(style):
        found = _DECLARATION.match(style, at)
        end = found.end() if found else at
        if found:
            name, value = found.group(1).lower(), found.group(2).strip().lower()
            forced = value.endswith("important") and "!" in value
            if forced or name not in important:
                out[name] = value.split("!")[0].strip() if forced else value
                if forced:
                    important.add(name)
        at = style.find(";", end) + 1 or len(style)
    return out


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def look(self, shown: bool) -> tuple[bool, bool]:
        """(whether it is laid out, whether its own text is shown): visibility is inherited and may be set again, ``display: none`` takes all with it."""
        a = self.attrs
        if self.tag in UNSEEN or self.tag == "input" or (a and "hidden" in a) or (self.tag == "dialog" and "open" not in a):
            return False, False
        if not a or "style" not in a:
            return True, shown
        style = declarations(a["style"])
        if style.get("display") == "none":
            return False, False
        visibility = style.get("visibility")
        return True, shown if visibility in (None, "inherit") else visibility not in ("hidden", "collapse")


def tag_end(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on and the place behind the tag (the end of the page for one that never ends)."""
    attrs: dict[str, str] = {}
    n = len(html)
    while at < n and html[at] != ">":
        found = _ATTRIBUTE.match(html, at)
        if not found or found.end() == at:
            at += 1
            continue
        at = found.end()
        name, quote, bare = found.groups()
        if name is None:
            continue
        value = bare or ""
        if quote in ("'", '"') and bare is None:
            at = html.index(quote, at)
            end = html.find(quote, at + 1)
            if end < 0:
                return attrs, n
            value, at = html[at + 1 : end], end + 1
        attrs.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return attrs, at + 1


class TreeBuilder:
    """Builds the element tree, with the tags that authors may leave out.

    ``at`` keeps the places of the open elements by tag, so that a tag looks
    for what it closes without walking the stack, however deep it is.
    """

    def __init__(self) -> None:
        self.root = Node("#page", {})
        self.stack = [self.root]
        self.at: dict[str, list[int]] = {}

    def place(self, tag: str) -> int:
        """Place of the innermost open element of a tag; 0 if there is none."""
        at = self.at.get(tag)
        return at[-1] if at else 0

    def open_tag(self, tags: frozenset, walls: frozenset) -> int:
        k = max(map(self.place, tags))
        return k if k and k >= max(map(self.place, walls), default=0) else 0

    def cut(self, k: int) -> None:
        """End the elements from place ``k`` on."""
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()

    def close(self, tags: frozenset, walls: frozenset) -> None:
        k = self.open_tag(tags, walls)
        while k:
            self.cut(k)
            k = self.open_tag(tags, walls)

    def leave_head(self) -> None:
        at = self.at.get("head")
        if at:
            self.cut(at[0])

    def push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)
        return node

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html" or (tag == "head" and self.stack[-1] is not self.root) or (tag == "body" and self.place("body")):
            return
        if tag not in IN_HEAD:
            self.leave_head()
        if tag in ENDS_P:
            self.close(frozenset(["p"]), WALLS | {"button"})
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        here = self.stack[-1].tag
        if tag == "table" and here in TABLE_PARTS:  # not inside a cell: it ends the table before
            self.end("table")
        if tag in ("td", "th") and here in ("table", "thead", "tbody", "tfoot"):
            self.push("tr", {})
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", here):
            self.cut(len(self.stack) - 1)
        self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag in ("html", "body"):
            return
        else:
            k = self.open_tag(frozenset([tag]), WALLS - {tag} if tag not in TABLE_PARTS else frozenset(["table"]) - {tag})
            if k:
                self.cut(k)
            elif tag == "p":
                self.start("p", {})
                if self.stack[-1].tag == "p":
                    self.cut(len(self.stack) - 1)

    def text(self, data: str) -> None:
        if not data:
            return
        here = self.stack[-1]
        blank = data.isspace()
        if here.tag == "head" and not blank:
            self.leave_head()
            here = self.stack[-1]
        if here.tag in TABLE_PARTS:  # text between cells is shown before the table
            if blank:
                return
            k = self.place("table")
            if k:
                above = self.stack[k - 1].children
                above.insert(max(0, len(above) - 1), data)
                return
        here.children.append(data)

    def feed(self, html: str) -> Node:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.text(unescape(html[at:lt]) if "&" in html[at:lt] else html[at:lt])
            if lt >= n:
                break
            after = html[lt + 1 : lt + 2]
            if after.isascii() and after.isalpha():
                tag = _NAME.match(html, lt + 1).group()
                attrs, at = tag_end(html, lt + 1 + len(tag))
                if at > n:
                    break  # the page ends inside the tag
                tag = tag.lower()
                self.start(tag, attrs)
                if (tag in RAW or tag in ESCAPABLE_RAW) and self.stack[-1].tag == tag:
                    end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                    stop = end.start() if end else n
                    raw = html[at:stop]
                    self.stack[-1].children.append(unescape(raw) if tag in ESCAPABLE_RAW else raw)
                    at = stop
            elif after == "/":
                name = _NAME.match(html, lt + 2)
                close = html.find(">", lt)
                at = n if close < 0 else close + 1
                if name and close >= 0:
                    self.end(name.group().lower())
            elif after in ("!", "?"):
                if html.startswith("<!--", lt):
                    close = html.find("-->", lt + 2)
                    at = n if close < 0 else close + 3
                else:
                    close = html.find(">", lt)
                    at = n if close < 0 else close + 1
            else:
                self.text("<")
                at = lt + 1
        return self.root


class Page:
    """Lines of text with margins, indents and list marks."""

    def __init__(self, padding: list[int], depth: int = 0) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indent, self.mark, self.margin = "", "", 0
        self.padding, self.depth = padding, depth  # blanks left for all tables of the page; cells around this text
        self.gap = False  # a collapsed blank waits for text

    def text(self, data: str, kept: bool) -> None:
        if kept:
            for k, line in enumerate(data.replace("\r\n", "\n").split("\n")):
                if k:
                    self.line(True)
                if line:
                    self.parts.append(line)
            return
        data = _SPACE.sub(" ", data)
        if data[:1] == " " or self.gap:
            data = data.lstrip(" ")
            if self.parts and data:
                data = " " + data
        self.gap = False
        if data[-1:] == " ":
            data, self.gap = data[:-1], True
        elif not data:
            self.gap = True
        if data:
            self.parts.append(data)

    def line(self, forced: bool = False) -> None:
        """End the line; an empty one counts only if forced."""
        self.gap = False
        text = "".join(self.parts).rstrip(" ")
        self.parts = []
        if text or forced:
            self.write(text)

    def write(self, text: str) -> None:
        if self.lines and self.margin:
            self.lines += [""] * self.margin
        self.margin = 0
        self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark + text).rstrip(" ") if self.mark else (self.indent + text if text else ""))
        self.mark = ""

    def block(self, margin: int) -> None:
        self.line()
        self.margin = max(self.margin, margin)

    def finished(self) -> list[str]:
        self.line()
        return self.lines


def finish(work: Iterator) -> None:
    """Run a generator that yields the generators it waits for: recursion of any depth on a stack of its own."""
    stack = [work]
    while stack:
        for inner in stack[-1]:
            stack.append(inner)
            break
        else:
            stack.pop()


def show(node: Node, page: Page, kept: bool = False, shown: bool = True) -> Iterator:
    """Write the node's visible content; a generator for ``finish``."""
    laid, shown = node.look(shown)
    if not laid:
        return
    tag = node.tag
    if tag == "br":
        page.line(True)
        return
    if tag == "wbr":
        return
    if tag == "table":
        yield show_table(node, page, shown)
        return
    margin = 1 if tag in SPACED else 0
    block = tag in BLOCK
    if block:
        nested = tag in ("ul", "ol", "menu", "dir") and page.indent
        page.block(0 if nested else margin)
    kept = kept or tag in ("pre", "textarea", "xmp")
    if tag in ("ul", "ol", "menu", "dir"):
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li" and child.look(shown)[0]:
                outer = page.indent
                mark = f"{number}. " if tag == "ol" else "- "
                number += 1
                page.block(0)
                page.mark, page.indent = mark, (outer + " " * len(mark))[:MAX_INDENT]
                yield show(child, page, kept, shown)
                page.line()
                page.mark, page.indent = "", outer
            elif isinstance(child, Node):
                yield show(child, page, kept, shown)
            elif shown:
                page.text(child, kept)
    else:
        outer = page.indent
        if tag in ("dd", "blockquote"):
            page.indent = (outer + "  ")[:MAX_INDENT]
        closed = tag == "details" and "open" not in node.attrs
        for k, child in enumerate(node.children):
            if isinstance(child, Node):
                if not closed or child.tag == "summary":
                    yield show(child, page, kept, shown)
            elif not closed and shown:
                page.text(child[1:] if kept and not k and child[:1] == "\n" else child, kept)
        if block:
            page.line()
        page.indent = outer
    if block:
        page.block(0 if tag in ("ul", "ol", "menu", "dir") and page.indent else margin)


def span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip()
    return min(most, int(value)) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def wrapped(lines: list[str], width: int) -> list[str]:
    """Lines cut at blanks to the width; a longer word is left whole."""
    out = []
    for line in lines:
        while len(line) > width:
            at = line.rfind(" ", 1, width + 1)
            at = line.find(" ", width) if at < 1 else at
            if at < 0:
                break
            out.append(line[:at].rstrip(" "))
            line = line[at + 1 :].lstrip(" ")
        out.append(line)
    return out


def show_table(table: Node, page: Page, shown: bool) -> Iterator:
    """Rows with their cells in aligned columns, two blanks apart; a cell that is not shown keeps its place."""
    page.block(1)
    rows: list[list[tuple[int, int, list[str]]]] = []
    busy = [0] * MAX_COLUMNS  # up to which row a column is taken by cells from above
    flat = page.depth >= MAX_NESTED

    def gather(node: Node, shown: bool) -> Iterator:
        for child in node.children:
            if not isinstance(child, Node):
                if shown:
                    page.text(child, False)
                continue
            laid, seen = child.look(shown)
            if not laid:
                continue
            if child.tag == "tr":
                row, column = [], 0
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in ("td", "th"):
                        while column < MAX_COLUMNS and busy[column] > len(rows):
                            column += 1
                        if flat:
                            page.block(0)
                        inner = page if flat else Page(page.padding, page.depth + 1)
                        laid, text_shown = cell.look(seen)
                        for part in cell.children if laid else ():
                            if isinstance(part, Node):
                                yield show(part, inner, False, text_shown)
                            elif text_shown:
                                inner.text(part, False)
                        if flat:
                            page.block(0)
                            continue
                        over, down = max(1, span(cell, "colspan", MAX_COLSPAN)), span(cell, "rowspan", MAX_ROWSPAN)
                        row.append((column, over, inner.finished()))
                        if down != 1:  # 0: to the end of the group of rows
                            to = min(column + over, MAX_COLUMNS)
                            busy[column:to] = [max(t, len(rows) + (down or MAX_ROWSPAN)) for t in busy[column:to]]
                        column += over
                    elif isinstance(cell, Node):
                        yield show(cell, page, False, seen)
                    elif seen:
                        page.text(cell, False)
                rows.append(row)
            elif child.tag in ("thead", "tbody", "tfoot"):
                busy[:] = [0] * MAX_COLUMNS  # a cell does not reach into another group of rows
                yield gather(child, seen)
                busy[:] = [0] * MAX_COLUMNS
            else:
                yield show(child, page, False, shown)
                page.line()

    yield gather(table, shown)
    last = max((column + over for row in rows for column, over, _ in row), default=0) - 1
    rows = [[(column, over, lines if column + over > last else wrapped(lines, WRAP)) for column, over, lines in row] for row in rows]
    widths: dict[int, int] = {}
    for row in rows:
        for column, over, lines in row:
            if over == 1:  # cells over several columns set no width
                widths[column] = max(widths.get(column, 0), max(map(len, lines), default=0))
    columns, ends = sorted(widths), [0]
    for column in columns:
        ends.append(ends[-1] + (widths[column] + 2 if widths[column] else 0))
    starts = {column: ends[bisect_left(columns, column)] if columns and column <= columns[-1] else 0 for row in rows for column, _, _ in row}
    furthest = 0
    for row in rows:
        filled = [(len(lines), starts[column]) for column, _, lines in row if lines and starts[column]]
        furthest += sum(lines * start for lines, start in filled)
    if furthest > page.padding[0]:
        starts = {}
    else:
        page.padding[0] -= furthest
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            text = ""
            for column, _, lines in row:
                if k < len(lines) and lines[k]:
                    if text:
                        text += "  "
                    text = text.ljust(starts.get(column, 0)) + lines[k]
            page.line()
            page.write(text.rstrip())
    page.block(1)


def page_text(html: str) -> str:
    """The visible text of one page."""
    page = Page([PADDING * len(html)])
    for child in TreeBuilder().feed(html.replace("\0", "")).children:
        if isinstance(child, Node):
            finish(show(child, page))
        else:
            page.text(child, False)
    return "\n".join(page.finished()).strip("\n")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text of whole pages, in one narrow pass.

    Blocks start on lines of their own and paragraphs, headings, lists, tables
    and preformatted text are set off by an empty line; list items carry
    ``- `` or their number and nest by indent; table cells stand in aligned
    columns. Left out is what a browser does not show: head, scripts, styles,
    templates, comments, elements with ``hidden`` or with a style of
    ``display: none``, text under ``visibility: hidden`` (not that which is
    made visible again), and closed details. Cells over several rows or columns
    keep their columns, and so does one that is not shown. No page explodes:
    indents end at ``MAX_INDENT``, a table that would take more blanks than
    ``PADDING`` allows has its cells two blanks apart, one over ``MAX_NESTED``
    deep in cells of others shows its cells under each other, and columns from
    ``MAX_COLUMNS`` on are not kept free under cells over several rows. Text is
    never left out for it.

    Null pages give null, empty ones the empty text; broken markup is read as
    far as it goes, to any depth; null ids and repeated rows are kept. Other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", BATCH_BYTES):
            texts = [None if html is None else page_text(html) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"]).mapInArrow(run, "page_id long, text string")
