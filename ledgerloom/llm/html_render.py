"""Layout-aware rendering of HTML to plain text.

A tree builder reads tags one by one and supplies implied ones (a new paragraph
ends the last, a new cell ends its row mate, and so on). Visibility follows
attributes, inline styles and simple rules of the page's own style sheets;
``visibility`` is inherited, ``display`` takes the subtree. A renderer then walks
the tree and writes all visible text: blocks stand on lines of their own, with a
blank line where browsers have a margin; list items are marked and indented; the
cells of a table stand in a grid, spans included, and are aligned in columns; a
row that is longer than a line goes on in further lines, aligned as well.
Tables are rendered from the innermost out, so nothing recurses, and the time
grows with the length of the page.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from heapq import heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, read

# Fixed values of the HTML standard: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noembed noframes iframe object audio video canvas datalist area base link meta param source track rp title desc metadata defs annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address form li dt dd figcaption tr caption thead tbody tfoot details summary dialog legend hgroup center hr search optgroup option".split())
ENDS_P = (BLOCK - frozenset("li dt dd tr thead tbody tfoot caption html body option optgroup legend".split())) | frozenset(["hr"])
#: An opening tag closes these open ones, up to the scope given.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "tr"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "tr"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "tr"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ()),
}
#: What follows a tag's name up to its end; nothing is read twice, so a tag that never ends costs one pass.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_SHOWN = re.compile(r"(?:^|;)\s*(display|content-visibility|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)\Z", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "lines")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children, self.lines = tag, attrs or {}, [], None


class _Stack:
    """Open elements, with a count of each tag so that a tag that is not open is not looked for."""

    def __init__(self, root: Node):
        self.nodes, self.open = [root], Counter()

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.open[node.tag] += 1

    def cut(self, i: int) -> None:
        for node in self.nodes[i:]:
            self.open[node.tag] -= 1
        del self.nodes[i:]

    def close(self, tags, scope) -> None:
        """End the open elements of ``tags``, as far as the scope."""
        i = len(self.nodes) - 1
        while i > 0 and any(self.open[t] for t in tags):
            tag = self.nodes[i].tag
            if tag in tags:
                self.cut(i)
            elif tag in scope:
                return
            i -= 1


_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")


def tree(html: str) -> Node:
    """The element tree of a page, whatever its errors. A tag that never ends is text."""
    root = Node("html")
    stack = _Stack(root)
    at, n = 0, len(html)

    def text(data: str) -> None:
        if data:
            stack.nodes[-1].children.append(unescape(data) if "&" in data else data)

    def past(end: str, start: int) -> int:
        found = html.find(end, start)
        return n if found < 0 else found + len(end)

    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            text(html[at:])
            break
        lead = html[mark + 1 : mark + 2]
        if not (lead in ("!", "?", "/") or lead.isalpha() and lead.isascii()) or (lead == "/" and not html[mark + 2 : mark + 3].strip()):
            text(html[at : mark + 1])
            at = mark + 1
            continue
        text(html[at:mark])
        if html.startswith("<!--", mark):
            at = past("-->", mark + 4)
        elif html.startswith("<![CDATA[", mark):
            at = past("]]>", mark)
            text(html[mark + 9 : at].removesuffix("]]>"))
        elif lead in "!?" or lead == "/" and not _NAME.match(html, mark + 2):
            at = past(">", mark)
        elif lead == "/":
            end = _NAME.match(html, mark + 2)[0].lower()
            at = past(">", mark)
            if end in ("html", "body"):
                continue
            if not stack.open[end]:
                if end == "p":
                    stack.nodes[-1].children.append(Node("p"))
                continue
            scope = ("table",) if end not in ("table", "html") else ()
            for i in range(len(stack.nodes) - 1, 0, -1):
                tag = stack.nodes[i].tag
                if tag == end:
                    stack.cut(i)
                    break
                if tag in scope or (tag in ("td", "th") and end not in ("tr", "td", "th", "tbody", "thead", "tfoot", "table")):
                    break
        else:
            m = _NAME.match(html, mark + 1)
            rest = _REST.match(html, m.end())
            end = rest.end() if rest else html.find(">", m.end()) + 1  # a quote that never closes is a character
            if not end:
                text(html[mark:])
                break
            at, inner, name = end, html[m.end() : end - 1], m[0].lower()
            attrs: dict = {}
            if inner.strip():
                for x in _ATTR.finditer(inner):
                    value = x[2] if x[2] is not None else x[3] if x[3] is not None else x[4]
                    attrs.setdefault(x[1].lower(), unescape(value) if value else "")
            if name == "html" or name == "body":
                stack.close(("head",), ())
                if name == "body" and stack.nodes[-1] is root:
                    root.children.append(node := Node("body", attrs))
                    stack.push(node)
                else:
                    root.attrs = {**attrs, **root.attrs} if name == "html" else root.attrs
                continue
            if stack.nodes[-1].tag == "head" and name not in HIDDEN and name not in ("noscript",):
                stack.cut(len(stack.nodes) - 1)
            if name in ENDS_P:
                stack.close(("p",), ("table", "td", "th", "button", "object"))
            if name in IMPLIED:
                stack.close(*IMPLIED[name])
            if name in ("td", "th") and stack.nodes[-1].tag in ("table", "tbody", "thead", "tfoot"):
                stack.nodes[-1].children.append(row := Node("tr"))
                stack.push(row)
            if name in _HEADS and stack.nodes[-1].tag in _HEADS:
                stack.cut(len(stack.nodes) - 1)
            node = Node(name, attrs)
            stack.nodes[-1].children.append(node)
            if name in VOID or (inner.endswith("/") and (stack.open["svg"] or stack.open["math"])):
                continue
            if name in RAW or name in ESCAPABLE:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                data = html[at : stop.start() if stop else n]
                node.children.append(unescape(data) if name in ESCAPABLE else data)
                at = past(">", stop.end()) if stop else n
            else:
                stack.push(node)
    return root


class Sheet:
    """Rules of a page's style sheets that hide elements: selectors of one tag, classes and an id, outside at-rules."""

    def __init__(self, sources: list[str]):
        self.by: dict[str, list[tuple[tuple, str, frozenset, str]]] = {}
        order = 0
        for source in sources:
            source, depth, flat = re.sub(r"/\*.*?(?:\*/|\Z)", "", source, flags=re.S), 0, []
            for part in re.split(r"(@[^{};]*\{|[{}])", source):  # at-rules that hold other rules are left out
                if part.startswith("@") or (part == "{" and depth):
                    depth += 1
                elif part == "}" and depth:
                    depth -= 1
                elif not depth:
                    flat.append(part)
            for selectors, style in _RULE.findall("".join(flat)):
                if _SHOWN.search(style):
                    for one in selectors.split(","):
                        if (m := _SIMPLE.match(one.strip())) and one.strip():
                            names = frozenset(re.findall(r"[.#][\w-]+", m[2]))
                            tag = "" if m[1] in (None, "*") else m[1].lower()
                            order += 1
                            rank = (sum(n[0] == "#" for n in names), sum(n[0] == "." for n in names), tag != "", order)
                            self.by.setdefault(min(names, default=tag), []).append((rank, tag, names, style))

    def styles(self, node: Node) -> list[str]:
        if not self.by:
            return []
        own = {"." + c for c in node.attrs.get("class", "").split()} | ({"#" + node.attrs["id"]} if node.attrs.get("id") else set())
        found = [r for name in (*own, node.tag, "") for r in self.by.get(name, ())]
        return [style for _, tag, names, style in sorted(found, key=lambda r: r[0]) if tag in ("", node.tag) and names <= own]


def seen(node: Node, shown: bool, sheet: Sheet) -> bool | None:
    """None where the subtree is absent, else whether the element's own text is shown (``shown``: its parent's)."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return None
    won: dict[str, tuple[bool, str]] = {}
    for style in (*sheet.styles(node), a.get("style", "")):
        for m in _SHOWN.finditer(style):
            name, value, strong = m[1].lower(), m[2].lower(), bool(m[3])
            if strong or not won.get(name, (False, ""))[0]:  # the last one wins, an important one over others
                won[name] = (strong, value)
    if won.get("display", (0, ""))[1] == "none" or won.get("content-visibility", (0, ""))[1] == "hidden":
        return None
    value = won.get("visibility", (0, ""))[1]
    return value == "visible" if value in ("visible", "hidden", "collapse") else shown


def wide(text: str) -> int:
    """Columns that a line takes on a terminal."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Lines:
    """Lines under construction: margins collapse, inline spaces too."""

    def __init__(self):
        self.done: list[str] = []
        self.now = ""
        self.gap = False  # a space is due before the next inline text
        self.margin = False  # a blank line is due before the next line
        self.indent = ""
        self.mark = ""  # a list marker waiting for its first line

    def inline(self, data: str) -> None:
        words = _SPACE.sub(" ", data)
        if not words:
            return
        lead, trail = words[0] == " ", words[-1] == " "
        body = words.strip(" ")
        if not body:
            self.gap = self.gap or bool(self.now)
            return
        if self.now and (lead or self.gap):
            self.now += " "
        self.now += body
        self.gap = trail

    def keep(self, data: str) -> None:
        first, *rest = data.replace("\r\n", "\n").split("\n")
        self.now += (" " if self.gap and self.now else "") + first
        self.gap = False
        for line in rest:
            self.end(force=True)
            self.now = line

    def end(self, force: bool = False) -> None:
        if self.now.strip() or force:
            if self.margin and self.done:
                self.done.append("")
            self.margin = False
            lead = self.indent
            if self.mark:
                lead = self.indent[: len(self.indent) - len(self.mark)] + self.mark
                self.mark = ""
            self.done.append((lead + self.now).rstrip())
        self.now, self.gap = "", False

    def space(self) -> None:
        self.end()
        self.margin = True

    def block(self, lines: list[str]) -> None:
        self.end()
        for line in lines:
            self.now = line
            self.end(force=True)


def _number(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return 1 if not value.isdecimal() else min(int(value), most) if len(value) < 10 else most


def _cells(table: Node, shown: bool, sheet: Sheet) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """Captions, and rows of (rendered cell, columns and rows that it spans)."""
    captions, rows = [], []
    todo: list[tuple] = [(table, shown)]
    while todo:
        node, shown = todo.pop()
        if isinstance(node, str):
            if node.strip() and shown:
                rows.append([(_SPACE.sub(" ", node).strip(), 1, 1)])
            continue
        if node is not table and (shown := seen(node, shown, sheet)) is None:
            continue
        if node.tag == "caption":
            captions.append(_render(node, sheet, shown, False))
        elif node.tag == "tr":
            row = []
            for c in node.children:
                if isinstance(c, Node):
                    if (own := seen(c, shown, sheet)) is not None:
                        row.append((_render(c, sheet, shown if c.tag not in ("td", "th") else own, c.tag not in ("td", "th")), max(1, _number(c, "colspan", 1000)), _number(c, "rowspan", 65534) or 65534))
                elif c.strip() and shown:
                    row.append((_SPACE.sub(" ", c).strip(), 1, 1))
            if row:
                rows.append(row)
        elif node is table or node.tag in ("tbody", "thead", "tfoot"):
            todo.extend((c, shown) for c in reversed(node.children))
        else:
            rows.append([(_render(node, sheet, shown), 1, 1)])
    return captions, rows


#: Columns of text in a line of a table, the two after each cell included. A row goes on in further lines; in endless ones, padding would grow with the square of a page.
LINE = 1000


class _Taken:
    """Columns that cells of rows above still take."""

    def __init__(self):
        self.columns: list[int] = []  # in order
        self.until: list[tuple[int, int]] = []  # a heap of (last row, column)

    def row(self, r: int) -> None:
        """Free what rows before ``r`` took last."""
        while self.until and self.until[0][0] < r:
            c = heappop(self.until)[1]
            del self.columns[bisect_left(self.columns, c)]

    def free(self, k: int) -> int:
        """The first free column from ``k`` on: where the taken ones from there first leave a gap."""
        lo = first = bisect_left(self.columns, k)
        hi = len(self.columns)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.columns[mid] == k + mid - first:
                lo = mid + 1
            else:
                hi = mid
        return k + lo - first

    def take(self, columns: list[tuple[int, int]]) -> None:
        """(column, last row) of cells that reach into rows below."""
        for c, last in columns:
            at = bisect_left(self.columns, c)
            if at == len(self.columns) or self.columns[at] != c:  # a span that meets another leaves it
                self.columns.insert(at, c)
                heappush(self.until, (last, c))


def _beside(cells: list[tuple[int, list[str]]]) -> list[str]:
    """Lines of cells side by side, each at its stop or two spaces after what reaches beyond."""
    made: list[list[str]] = [[] for _ in range(max(len(lines) for _, lines in cells))]
    ends = [0] * len(made)
    for stop, lines in cells:
        for j, text in enumerate(lines):
            if text:
                gap = max(stop - ends[j], 2 if made[j] else 0)
                made[j].append(" " * gap + text)
                ends[j] += gap + wide(text)
    return ["".join(texts).rstrip() for texts in made]


def _table(table: Node, shown: bool, sheet: Sheet) -> list[str]:
    """Lines of a table: cells in a grid, each column as wide as what stands in it.

    Every column has its stop in every row, in the first line or, where the
    columns before it fill that, in a further one. A line that a row has no
    text for is blank, after its last text none follow. A cell that is longer
    than a line begins one and widens no column.
    """
    captions, rows = _cells(table, shown, sheet)
    taken = _Taken()
    grid: list[list[tuple[int, list[str], int]]] = []
    for r, row in enumerate(rows):
        taken.row(r)
        k, line, below = 0, [], []
        for cell, across, down in row:
            k = taken.free(k)
            line.append((k, cell.split("\n"), across))
            if down > 1:
                below += [(k + i, r + down - 1) for i in range(across)]
            k += across
        taken.take(below)
        grid.append(line)
    starts = sorted({k for line in grid for k, *_ in line})  # columns in which no cell begins have no width
    place = {k: i for i, k in enumerate(starts)}
    placed = [[(place[k], lines, bisect_left(starts, k + across) - place[k], max(map(wide, lines))) for k, lines, across in line] for line in grid]
    width = [0] * len(starts)
    for i, _, across, size in sorted((c for line in placed for c in line), key=lambda c: c[2]):
        lack = size - sum(width[i : i + across]) - 2 * (across - 1)
        if lack > 0 and size + 2 <= LINE:
            width[i + across - 1] += lack
    stops: list[tuple[int, int]] = []  # of each column: the line of a row, and the place in it
    fold = at = 0
    for w in width:
        if at + w + 2 > LINE:
            fold, at = fold + 1, 0
        stops.append((fold, at))
        at += w + 2
    out = [line for c in captions for line in c.split("\n")]
    for line in placed:
        parts: list[list[tuple[int, list[str]]]] = [[]]
        last = 0
        for i, lines, _, size in line:
            if any(lines):
                fold, at = stops[i]
                parts += [[] for _ in range(fold - last)]
                if at and size + 2 > LINE:
                    parts.append([])
                    at = 0
                parts[-1].append((at, lines))
                last = fold
        out += [text for cells in parts for text in (_beside(cells) if cells else [""])]
    return out


def _tables(root: Node, sheet: Sheet) -> list[tuple[Node, bool]]:
    """All tables that are not absent, outer before inner, and whether their text is shown."""
    found, todo = [], [(root, True)]
    while todo:
        node, shown = todo.pop()
        if (shown := seen(node, shown, sheet)) is None:
            continue
        if node.tag == "table":
            found.append((node, shown))
        todo.extend((c, shown) for c in node.children if isinstance(c, Node))
    return found


def _render(root: Node, sheet: Sheet, shown: bool = True, own: bool = True) -> str:
    """Text of a subtree whose tables have been rendered."""
    out = _Lines()
    OPEN, CLOSE = 0, 1
    todo: list[tuple] = [(OPEN, c, False, (), shown) for c in reversed(root.children)] if not own else [(OPEN, root, False, (), shown)]
    lists: list[list] = []
    while todo:
        step, node, pre, saved, shown = todo.pop()
        if step == CLOSE:
            tag = node.tag
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                out.space()
            elif tag in BLOCK:
                out.end()
            if tag == "q" and shown:
                out.inline('"')
            if saved:
                out.mark = ""
                out.indent = saved[0]
            continue
        if isinstance(node, str):
            if shown:
                out.keep(node) if pre else out.inline(node)
            continue
        if (shown := seen(node, shown, sheet)) is None:
            continue
        tag, saved = node.tag, ()
        if tag == "br":
            out.end(force=True) if out.now or out.done else None
            continue
        if tag == "wbr":
            continue
        if tag == "hr":
            out.block(["----"] if shown else [])
            continue
        if tag == "img":
            out.inline(node.attrs.get("alt", "") if shown else "")
            continue
        if tag == "input":
            if shown and node.attrs.get("type", "text").lower() not in ("checkbox", "radio", "file", "image", "color", "range", "password"):
                out.inline(node.attrs.get("value", "") or node.attrs.get("placeholder", ""))
            continue
        if node.lines is not None:
            out.space()
            out.block(node.lines)
            out.space()
            continue
        nested = tag in ("ul", "ol", "menu") and lists
        if tag in SPACED and not nested:
            out.space()
        elif tag in BLOCK:
            out.end()
        if tag in ("ul", "ol", "menu"):
            start = node.attrs.get("start", "1")
            lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        elif tag == "li":
            kind = lists[-1] if lists else ["ul", 1]
            mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
            saved = (out.indent,)
            out.indent += " " * len(mark)
            out.mark = mark if shown else ""
        elif tag in ("blockquote", "dd"):
            saved = (out.indent,)
            out.indent += "  "
        elif tag == "q" and shown:
            out.inline('"')
        inside = pre or tag in ("pre", "textarea")
        kids = node.children
        if inside and not pre and kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
            kids = [kids[0][1:], *kids[1:]]
        todo.append((CLOSE, node, pre, saved, shown))
        todo.extend((OPEN, c, inside, (), shown) for c in reversed(kids))
    out.end()
    return "\n".join(out.done).strip("\n")


def render(html: str | None) -> str:
    """Visible text of a page; empty for null or empty pages."""
    if not html:
        return ""
    root = tree(html)
    styles, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            styles += [c for c in node.children if isinstance(c, str)]
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    sheet = Sheet(styles)
    for table, shown in reversed(_tables(root, sheet)):
        table.lines = _table(table, shown, sheet)
    return _render(root, sheet)


def render_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_lines and n_words of each page.

    Null and empty pages give an empty text. Null ids and repeated rows are kept;
    other columns are not read. Very long pages are read whole, in time in
    proportion to their length. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for first, some in byte_batches(batch, "html"):
                texts = [render(h.decode("utf-8", "replace") if h else None) for h in some]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([len(t.split()) for t in texts], pa.int64())], ["page_id", "text", "n_lines", "n_words"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string, n_lines long, n_words long")


def op3_html_rendering(spark, sf_dir):
    """All pages; null and empty ones as in ``render_pages``."""
    return render_pages(read(spark, sf_dir, "pages"))
