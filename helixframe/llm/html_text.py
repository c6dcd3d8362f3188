"""Visible text of HTML pages, laid out as a reader would see it.

A tree is built first: tags that close others by implication, void and raw-text
elements, mis-nested end tags. Visibility rules then leave out what a browser
does not show on a screen: elements without a display, invisible ones (but not
what is made visible inside them), closed dialogs and the body of closed details.
Rules come from style attributes and from style sheets, by importance,
specificity and order; selectors are tags, classes, ids and compounds of them
(selectors that look at other elements are left out), and media rules count
where they hold for a screen WIDTH pixels wide. All other text is rendered: blocks
on lines of their own with blank lines around paragraphs and headings, list
markers with indentation, preformatted text as it stands, table cells in columns
aligned by the width of their characters, with cells that span rows or columns.
All passes take time in proportion to the page, use explicit stacks and so handle
nesting of any depth.

Defined results: null and empty pages give ""; unclosed tags end with the page;
repeated rows and other columns make no difference.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe noembed noframes object audio video canvas datalist colgroup defs desc metadata symbol clippath mask annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt figcaption footer form header html legend li main menu nav "
    "optgroup option search section summary tr caption thead tbody tfoot".split()
)
#: A start tag closes an open element of the second set, up to one of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Start tags that end an open paragraph.
ENDS_P = (BLOCK | {"table"}) - {"body", "html", "option", "optgroup", "tr", "caption", "thead", "tbody", "tfoot"}
#: An open paragraph is not looked for outside these.
P_SCOPE = frozenset("table td th caption button object applet marquee html".split())

# A quote opens a value only behind an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"?|=\s*'[^']*'?|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
#: Pixels of the screen that media rules are held against.
WIDTH = 1280
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(self.attrs)} if self.attrs.strip(" /\n") else {}


def build(page: str) -> tuple[Node, list[str]]:
    """The tree, and the texts of its style sheets."""
    root = Node("#root")
    stack, styles, at = [root], [], 0
    opened: Counter = Counter()  # open elements by tag: no search where there is nothing to close

    def cut(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    def push(n: Node) -> None:
        stack[-1].children.append(n)
        stack.append(n)
        opened[n.tag] += 1

    def close(tags, bounds) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bounds:
                return
            if stack[k].tag in tags:
                # The outermost of them within the bound goes as well.
                while k > 1 and stack[k - 1].tag in tags:
                    k -= 1
                cut(k)
                return

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("br", "p") and not opened[tag]:
                stack[-1].children.append(Node(tag))
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    cut(k)
                    break
                if stack[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ENDS_P:
            close({"p"}, P_SCOPE)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr"))
        node = Node(tag, m[3])
        if tag not in RAW and tag not in VOID:
            push(node)
            if tag == "pre" and page[at : at + 1] == "\n":
                at += 1
            continue
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            body, at = (page[at : end.start()], end.end()) if end else (page[at:], len(page))
            if tag == "style":
                styles.append(body)
            else:
                node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
    text(page[at:])
    return root, styles


def _on_screen(query: str) -> bool:
    """Whether one of a list of media queries holds for the screen."""
    for q in query.lower().split(","):
        holds = not re.search(r"\b(?:print|speech)\b", q) and not re.search(r"prefers-color-scheme\s*:\s*dark", q)
        for edge, px in re.findall(r"\b(min|max)-width\s*:\s*(\d+)px", q):
            holds = holds and (int(px) <= WIDTH if edge == "min" else int(px) >= WIDTH)
        if holds != q.strip().startswith("not "):
            return True
    return False


class Rules:
    """Declarations of display and visibility by selector."""

    def __init__(self, styles: list[str]) -> None:
        self.by: dict[str, list[tuple]] = {}
        for sheet in styles:
            self._read(re.sub(r"/\*(?:[^*]|\*(?!/))*+(?:\*/)?", "", sheet))

    def _read(self, sheet: str) -> None:
        live, start, at = [True], 0, 0
        while m := re.compile(r"[{};]").search(sheet, at):
            prelude, start, at = sheet[start : m.start()].strip(), m.end(), m.end()
            if m[0] == "}":
                live = live[:-1] or [True]
            elif m[0] == "{" and prelude.startswith("@"):
                word = prelude[1:].split(None, 1)[0].split("(")[0].lower() if len(prelude) > 1 else ""
                inner = _on_screen(prelude[6:]) if word == "media" else word in ("supports", "layer", "container", "scope")
                live.append(live[-1] and inner)
            elif m[0] == "{":
                end = sheet.find("}", at)
                end = len(sheet) if end < 0 else end
                if live[-1]:
                    self._add(prelude, sheet[at:end])
                start = at = min(end + 1, len(sheet))

    def _add(self, selectors: str, body: str) -> None:
        declared = [(m[1].lower(), m[2].lower(), bool(m[3])) for m in DECLARED.finditer(body)]
        if not declared:
            return
        for s in map(str.strip, selectors.split(",")):
            m = SELECTOR.fullmatch(s)
            if not m or not s:
                continue
            parts = re.findall(r"[.#][\w-]+", m[2])
            tag = (m[1] or "*").lower()
            weight = (sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), tag != "*")
            # Kept under the rarest part; the others are checked.
            under = min(parts, key=lambda x: x[0] != "#") if parts else tag
            self.by.setdefault(under, []).append((tag, frozenset(parts), weight, declared))

    def of(self, node: Node, attributes: dict[str, str]) -> dict[str, str]:
        """display and visibility of an element, where something declares them."""
        names = {f".{c}" for c in attributes.get("class", "").split()} | ({f"#{attributes['id']}"} if attributes.get("id") else set())
        best: dict[str, tuple] = {}

        def take(declared, weight) -> None:
            for prop, value, important in declared:
                rank = (important, weight)
                if prop not in best or rank >= best[prop][0]:
                    best[prop] = (rank, value)

        if self.by:
            for key in ("*", node.tag, *sorted(names)):
                for tag, parts, weight, declared in self.by.get(key, ()):
                    if tag in ("*", node.tag) and parts <= names:
                        take(declared, (0, *weight))
        if "style" in attributes:
            take([(m[1].lower(), m[2].lower(), bool(m[3])) for m in DECLARED.finditer(attributes["style"])], (1, 0, 0, 0))
        return {prop: value for prop, (_, value) in best.items()}


def _seen(node: Node, rules: Rules) -> tuple[bool, bool | None]:
    """(whether the element is displayed, whether its own text is visible; None: as around it)."""
    if node.tag in UNSEEN:
        return False, None
    if not node.attrs and not rules.by:
        return node.tag != "dialog", None
    a = node.attributes()
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False, None
    declared = rules.of(node, a)
    shown = "hidden" not in a and (node.tag != "dialog" or "open" in a)
    if "display" in declared:
        shown = declared["display"] != "none"
    visibility = declared.get("visibility")
    return shown, None if visibility in (None, "inherit") else visibility not in ("hidden", "collapse")


class Page:
    """Lines of text with collapsed white space and pending breaks."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.empty = 0, False, True
        self.indent, self.marker = 0, ""

    def block(self, lines: int) -> None:
        self.breaks, self.space = max(self.breaks, lines), False

    def _start(self) -> None:
        if self.empty:
            self.parts.append(" " * (self.indent - len(self.marker)) + self.marker if self.indent else "")
        elif self.breaks:
            self.parts.append("\n" * self.breaks + " " * (self.indent - len(self.marker)) + self.marker)
        elif self.space:
            self.parts.append(" ")
        elif self.marker:
            self.parts.append(self.marker)
        self.breaks, self.space, self.empty, self.marker = 0, False, False, ""

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        body = words.strip(" ")
        if words[:1] == " " and not self.empty and not self.breaks:
            self.space = True
        if body:
            self._start()
            self.parts.append(body)
            self.space = words[-1:] == " "

    def lines(self, rows: list[str]) -> None:
        """Whole lines as they stand, below the indentation."""
        for k, row in enumerate(rows):
            if k:
                self.parts.append("\n" + (" " * self.indent if row else "") + row)
            else:
                self._start()
                self.parts.append(row)
        self.empty = self.empty and not rows
        self.block(1)

    def line_break(self) -> None:
        self.breaks, self.space = self.breaks + 1 if not self.empty else 0, False

    def result(self) -> str:
        return re.sub(r"[ \t]+(?=\n)", "", "".join(self.parts)).strip("\n")


#: Places of a table's grid for each of its cells up to which columns are padded.
SPARSE = 50


def _cells(s: str) -> int:
    """Columns of a terminal that a string takes: wide characters two, combining ones none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _aligned(rows: list[list[tuple[int, str]]]) -> list[str]:
    """Cells (column, text) padded to the width of their column; a cell may have several lines.

    Columns in which no cell begins take no room. Where spans leave most of the
    grid empty, cells follow one another without padding: a page's text is then
    still in proportion to the page.
    """
    columns = sorted({c for row in rows for c, _ in row})
    at, cells = {c: k for k, c in enumerate(columns)}, sum(map(len, rows))
    padded = len(rows) * len(columns) <= SPARSE * cells + 1000
    split = [[(at[c] if padded else k, x.split("\n")) for k, (c, x) in enumerate(row)] for row in rows]
    width = [0] * len(columns)
    for row in split if padded else []:
        for k, lines in row:
            width[k] = max(width[k], max(map(_cells, lines)))
    out = []
    for row in split:
        for i in range(max((len(lines) for _, lines in row), default=0)):
            parts, done = [], 0
            for k, lines in row:
                parts += [" " * width[c] for c in range(done, k)]
                x = lines[i] if i < len(lines) else ""
                parts.append(x + " " * (width[k] - _cells(x)) if padded else x)
                done = k + 1
            out.append("  ".join(parts).rstrip())
    return out


def _span(value: str, most: int) -> int:
    return max(1, min(int(value), most)) if value.isascii() and value.isdigit() and len(value) < 10 else 1


class _Covered:
    """The row at which each column is free again, as a tree of halves: a span and a search take steps in proportion to its depth."""

    def __init__(self, columns: int):
        self.size = 1 << columns.bit_length()
        #: What covers a node whole, and the least row at which a column below it is free.
        self.whole: dict[int, int] = {}
        self.least: dict[int, int] = {}

    def cover(self, first: int, last: int, end: int) -> None:
        """Columns from first to before last, up to before row end."""
        lo, hi = first + self.size, last + self.size
        while lo < hi:
            for node, taken in ((lo, lo & 1), (hi - 1, hi & 1)):
                if taken:
                    self.whole[node] = max(self.whole.get(node, 0), end)
                    self.least[node] = max(self.least.get(node, 0), end)
            lo, hi = (lo + 1) >> 1, hi >> 1
        for node in (first + self.size, last - 1 + self.size):
            while node := node >> 1:
                self.least[node] = max(self.whole.get(node, 0), min(self.least.get(2 * node, 0), self.least.get(2 * node + 1, 0)))

    def free(self, column: int, row: int) -> int:
        """The first column from this one on that nothing covers in the row."""
        todo = [(1, 0, self.size)]
        while True:
            node, lo, width = todo.pop()
            if lo + width <= column or self.least.get(node, 0) > row:
                continue
            if width == 1:
                return lo
            half = width // 2
            todo += [(2 * node + 1, lo + half, half), (2 * node, lo, half)]


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, str]]]:
    """Cells (text, columns, rows) as (column, text), to the right of those that cells above cover."""
    out: list[list[tuple[int, str]]] = []
    covered = None
    for r, row in enumerate(rows):
        line, column = [], 0
        for text, columns, deep in row:
            if covered:
                column = covered.free(column, r)
            line.append((column, text))
            if deep > 1:
                # No cell is farther to the right than all cells are wide together.
                covered = covered or _Covered(sum(c for some in rows for _, c, _ in some))
                covered.cover(column, column + columns, r + deep)
            column += columns
        out.append(line)
    return out


def render(page: str | None) -> str:
    root, styles = build(page or "")
    rules = Rules(styles)
    out = Page()
    visible = [True]
    lists: list[list] = []
    tables: list[tuple[Page, list[list[tuple[str, int, int]]]]] = []
    pre = 0
    todo: list[tuple] = [("enter", root)]
    while todo:
        what, node = todo.pop()
        if what == "enter" and isinstance(node, str):
            if not visible[-1]:
                continue
            if pre:
                rows = node.expandtabs(8).replace("\r\n", "\n").split("\n")
                for k, row in enumerate(rows):
                    if k:
                        out.line_break()
                    if row:
                        out._start()
                        out.parts.append(row)
            else:
                out.text(node)
            continue
        tag = node.tag
        if what == "enter":
            shown, own = _seen(node, rules)
            if not shown:
                continue
            visible.append(visible[-1] if own is None else own)
            todo.append(("leave", node))
            if tag == "br":
                out.line_break()
            elif tag == "hr":
                out.block(2)
            elif tag == "table":
                out.block(2)
                tables.append((out, []))
            elif tag == "tr" and tables:
                tables[-1][1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1][1]:
                    tables[-1][1].append([])
                out = Page()
            elif tag in SPACED:
                out.block(1 if tag in ("ul", "ol") and lists else 2)
            elif tag in BLOCK:
                out.block(1)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes().get("start", "1") if tag == "ol" else "1"
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                out.marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                out.indent += len(out.marker)
                node.attrs = str(len(out.marker))
            elif tag in ("blockquote", "dd"):
                out.indent += 4
            elif tag == "pre":
                pre += 1
            children = node.children
            if tag == "details" and "open" not in node.attributes():
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            todo.extend(("enter", c) for c in reversed(children))
            continue
        visible.pop()
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            out.indent -= int(node.attrs)
            out.marker = ""
        elif tag in ("blockquote", "dd"):
            out.indent -= 4
        elif tag == "pre":
            pre -= 1
        if tag in ("td", "th") and tables:
            a = node.attributes()
            # The standard's limits: 1000 columns and 65534 rows.
            tables[-1][1][-1].append((out.result(), _span(a.get("colspan", "1"), 1000), _span(a.get("rowspan", "1"), 65534)))
            out = tables[-1][0]
        elif tag == "table":
            outer, cells = tables.pop()
            rows = _aligned([r for r in _grid(cells) if any(text for _, text in r)])
            if rows:
                outer.block(2)
                outer.lines(rows)
            outer.block(2)
        elif tag in SPACED:
            out.block(1 if tag in ("ul", "ol") and lists else 2)
        elif tag in BLOCK:
            out.block(1)
    return out.result()


def _rendered(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = pa.array([render(p.as_py()) for p in part.column("html")], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts], [*keep, "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    keep = ["page_id", "url"]
    schema = T.StructType([*(T.StructField(c, pages.schema[c].dataType) for c in keep), T.StructField("text", T.StringType())])
    return pages.select(*keep, "html").mapInArrow(_rendered(keep), schema)
