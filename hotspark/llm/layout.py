"""HTML to text as a page shows it.

A tokeniser and a tree builder with implied tags send open and close events to a
renderer. Hidden parts are left out, white space is folded as on a page, blocks are set
apart, list items are marked and indented, table cells are aligned in columns.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from hotspark.llm.kernels import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style title template noscript noembed noframes iframe datalist object audio video canvas svg math".split())
#: Start tags that may stand in the head; any other ends it.
HEAD = frozenset("head title meta link base style script template noscript".split())
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table dl figure hr xmp fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center details dialog dd dir div dt figcaption footer form header hgroup legend li main menu nav ol optgroup option search section summary ul caption".split())
#: Start tags that end an open paragraph.
ENDS_P = (BLOCKS - frozenset("html body option optgroup caption legend".split()))
#: An open element is not closed from within these.
WALLS = frozenset("table td th caption button template".split())
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: For a start tag: open elements that it ends, and where the search for them stops.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS | WALLS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | WALLS),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | WALLS),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"]) | WALLS),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"]) | WALLS),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    **{s: (SECTIONS | {"caption", "colgroup"}, frozenset(["table"])) for s in SECTIONS},
}
#: Widest column, and last place of a line, that cells are aligned to; what is longer stands out.
PAD, WIDE = 240, 4000
#: As browsers have them: columns and rows that a cell covers at most.
MAX_ACROSS, MAX_DOWN = 1000, 65534
#: Elements that nest; deeper ones stand beside each other, as in browsers. Their text stays.
MAX_DEPTH = 512

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_ATTR = re.compile(r"[\s/]*+([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++))?)?|[\s/]*+=")
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: The value of a property in a style; the last one counts.
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z-]+)", re.I)
_OFF = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class _Page:
    """Lines of text under construction: of the page or of one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line ends that stand before the next text
        self.indents: list[str] = []
        self.marker = ""
        self.ends_blank = True

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for part in rest:
                self.end(1, force=True)
                self._put(part)
            return
        words = _SPACE.sub(" ", s)
        if words[:1] == " " and (self.ends_blank or not self.line):
            words = words[1:]
        self._put(words)

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
            indent = "".join(self.indents)
            if self.marker:
                indent = indent[:len(indent) - len(self.marker)] + self.marker
                self.marker = ""
            self.line.append(indent)
        self.line.append(s)
        self.ends_blank = s[-1] == " "

    def end(self, gap: int, force: bool = False) -> None:
        """End the line; the next text comes `gap` line ends later at least."""
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
            self.gap = gap
        elif force:
            self.gap += 1
        else:
            self.gap = max(self.gap, gap)
        self.ends_blank = True

    def block(self, lines: list[str]) -> None:
        for s in lines:
            if s:
                self._put(s)
                self.end(1)
            else:
                self.end(1, force=True)

    def finish(self) -> list[str]:
        self.end(0)
        return self.lines


class _Table:
    def __init__(self):
        self.rows: list[list] = []  # of cells: (column, columns covered, lines)
        self.open_row = False
        self.hanging: dict[int, int] = {}  # column -> last row that a cell above covers
        self.at = 0

    def start_row(self) -> None:
        self.at = 0
        self.rows.append([])
        self.open_row = True

    def add(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.start_row()
        while self.hanging.get(self.at, 0) >= len(self.rows):
            self.at += 1
        if down > 1:
            for k in range(across):
                self.hanging[self.at + k] = len(self.rows) + down - 1
        self.rows[-1].append((self.at, across, lines))
        self.at += across

    def layout(self) -> list[str]:
        columns = sorted({at for row in self.rows for at, _, _ in row})
        order = {c: k for k, c in enumerate(columns)}
        widths = [0] * len(columns)
        wide = []
        for row in self.rows:
            for at, across, lines in row:
                length = min(PAD, max(map(len, lines), default=0))
                end = bisect.bisect_left(columns, at + across)
                if end <= order[at] + 1:
                    widths[order[at]] = max(widths[order[at]], length)
                else:
                    wide.append((order[at], end, length))
        # a cell that covers columns too narrow for it widens the last of them
        for first, end, length in wide:
            spare = length - sum(widths[first:end]) - 2 * (end - first - 1)
            if spare > 0:
                widths[end - 1] += spare
        places, at = [], 0
        for width in widths:
            places.append(min(at, WIDE))
            at += width + 2
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for at, _, lines in row:
                    if k < len(lines) and lines[k]:
                        place = places[order[at]]
                        line = (line.ljust(place) if len(line) + 2 <= place or not line else line + "  ") + lines[k]
                out.append(line.rstrip(" "))
        return out


class _Cell:
    def __init__(self, page: _Page, across: int, down: int):
        self.page, self.across, self.down = page, across, down


class Renderer:
    """The open elements and what they have written so far."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []  # tag, how it is left
        self.count: Counter[str] = Counter()  # open elements by tag
        self.pages = [_Page()]
        self.tables: list[_Table] = []
        self.cells: list[_Cell] = []
        self.captions = 0
        self.lists: list[int | None] = []
        self.hidden = 0
        self.seen = [True]  # whether text shows, for the page and each open element
        self.keep = 0

    def open(self, tag: str, attrs: dict[str, str]) -> None:
        names, count = self.stack, self.count
        if count["head"] and tag not in HEAD:
            self.close("head")
        if tag in ("html", "body") and count[tag]:
            return
        if count["p"] and tag in ENDS_P:
            self._end_inside(frozenset(["p"]), WALLS)
        if tag in IMPLIED and any(count[t] for t in IMPLIED[tag][0]):
            self._end_inside(*IMPLIED[tag])
        if tag in ("td", "th") and self.tables and not self.hidden and not self.tables[-1].open_row:
            self.open("tr", {})
        page = self.pages[-1]
        if tag in VOID:
            if self.hidden or not self.seen[-1]:
                return
            if tag == "br":
                page.end(1, force=not page.line)
            elif tag == "hr":
                page.end(2)
            elif tag == "input" and attrs.get("type", "").lower() in ("submit", "button", "reset") and attrs.get("value"):
                page.text(html.unescape(attrs["value"]), False)
            return
        while len(names) >= MAX_DEPTH:
            self._leave()
        count[tag] += 1
        style = html.unescape(attrs["style"]) if "style" in attrs else ""
        shown = _DISPLAY.findall(style) if style else []
        gone = tag in HIDDEN or "hidden" in attrs or bool(shown and shown[-1].lower() == "none") or (tag == "dialog" and "open" not in attrs)
        # an element may be visible within one that is not
        visible = _VISIBILITY.findall(style) if style else []
        self.seen.append(visible[-1].lower() == "visible" if visible and visible[-1].lower() in ("visible", "hidden", "collapse") else self.seen[-1])
        if gone or self.hidden:
            self.hidden += 1
            names.append((tag, "hidden"))
            return
        if tag == "table":
            page.end(2 if not self.cells else 1)
            self.tables.append(_Table())
            names.append((tag, "table"))
        elif tag == "tr" and self.tables:
            self.tables[-1].start_row()
            names.append((tag, "row"))
        elif tag in ("td", "th") and self.tables:
            self.cells.append(_Cell(page, _span(attrs.get("colspan"), MAX_ACROSS), _span(attrs.get("rowspan"), MAX_DOWN)))
            self.pages.append(_Page())
            names.append((tag, "cell"))
        elif tag in LISTS:
            page.end(2 if not self.lists else 1)
            self.lists.append(_number(attrs.get("start"), 1) if tag == "ol" else None)
            names.append((tag, "list"))
        elif tag == "li":
            page.end(1)
            mark = "- "
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] = _number(attrs.get("value"), self.lists[-1])
                mark = f"{self.lists[-1]}. "
                self.lists[-1] += 1
            page.indents.append(" " * len(mark))
            page.marker = mark
            names.append((tag, "item"))
        elif tag in ("dd", "blockquote"):
            page.end(2 if tag in SPACED else 1)
            page.indents.append("  ")
            names.append((tag, "indented"))
        elif tag in BLOCKS:
            page.end(2 if tag in SPACED else 1)
            if tag in ("pre", "textarea", "xmp"):
                self.keep += 1
            names.append((tag, "pre" if tag in ("pre", "xmp") else "block"))
        else:
            names.append((tag, "inline"))

    def close(self, tag: str) -> None:
        if tag == "br":
            return self.open("br", {})
        if not self.count[tag]:
            if tag == "p" and not self.hidden:
                self.pages[-1].end(2)
            return None
        walls = frozenset() if tag in ("table", "body", "html") else frozenset(["table"]) if tag in IMPLIED or tag == "caption" else frozenset(["td", "th", "table", "caption"])
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._leave()
                break
            if self.stack[k][0] in walls:
                break
        return None

    def text(self, s: str) -> None:
        if self.count["head"] and self.stack[-1][0] == "head" and s.strip():
            self.close("head")
        if self.hidden or not s or not self.seen[-1]:
            return
        if self.tables and self.stack and self.stack[-1][1] in ("table", "row") or self.stack and self.stack[-1][0] in SECTIONS and self.tables:
            if not s.strip():
                return
        self.pages[-1].text(html.unescape(s) if "&" in s else s, self.keep > 0)

    def _end_inside(self, wanted: frozenset, walls: frozenset) -> None:
        """Close the outermost wanted element that no wall hides, with all in it."""
        found = None
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in wanted:
                found = k
                break
            if name in walls:
                break
        if found is not None:
            while len(self.stack) > found:
                self._leave()

    def _leave(self) -> None:
        tag, way = self.stack.pop()
        self.count[tag] -= 1
        self.seen.pop()
        page = self.pages[-1]
        if way == "hidden":
            self.hidden -= 1
        elif way == "table":
            lines = self.tables.pop().layout()
            page.block(lines)
            page.end(2 if not self.cells else 1)
        elif way == "row":
            self.tables[-1].open_row = False
        elif way == "cell":
            cell = self.cells.pop()
            lines = self.pages.pop().finish()
            if self.tables:
                self.tables[-1].add(lines, cell.across, cell.down)
        elif way == "list":
            self.lists.pop()
            page.end(2 if not self.lists else 1)
        elif way in ("item", "indented"):
            page.end(2 if tag == "blockquote" else 1)
            if page.indents:
                page.indents.pop()
            page.marker = ""
        elif way in ("block", "pre"):
            page.end(2 if tag in SPACED else 1)
            if way == "pre":
                self.keep -= 1

    def finish(self) -> str:
        while self.stack:
            self._leave()
        return "\n".join(self.pages[0].finish())


def _span(value: str | None, most: int) -> int:
    return max(1, min(most, _number(value, 1)))


def _number(value: str | None, other: int) -> int:
    return int(value) if value is not None and re.fullmatch(r"-?[0-9]{1,9}", value) else other


def render(page: str | None) -> str:
    """The visible text of a page; a null or empty page has none, plain text is kept as one block."""
    if not page:
        return ""
    out, at, n = Renderer(), 0, len(page)
    no_more: set[str] = set()  # end marks that do not occur any more

    def find(mark: str, start: int) -> int:
        if mark in no_more:
            return -1
        k = page.find(mark, start)
        if k < 0:
            no_more.add(mark)
        return k

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            out.text(page[at:])
            break
        if m.start() > at:
            out.text(page[at:m.start()])
        at = m.end()
        if m[1]:
            end = find("-->", at - 2)
            at = end + 3 if end >= 0 else n
            continue
        if m[3] is None:
            end = find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        tag, attrs = m[3].lower(), {}
        while at < n and page[at] != ">":
            a = _ATTR.match(page, at)
            if a is None or a.end() == at:
                at += 1
                continue
            if a[1] and not m[2]:
                attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
            at = a.end()
        at += 1
        if m[2]:
            out.close(tag)
            continue
        out.open(tag, attrs)
        if tag in RAW:
            end = _OFF[tag].search(page, at) if tag not in no_more else None
            if end is None:
                no_more.add(tag)
            stop = end.start() if end else n
            if tag in ("textarea", "xmp") or out.hidden:
                out.text(page[at:stop])
            at = stop
    return out.finish()


def extract(df: DataFrame, column: str = "html", keep: list[str] | None = None, name: str = "text") -> DataFrame:
    """Kept columns and the page's visible text.

    One row for each row; a null or empty page gives an empty text, equal pages equal
    texts; a page of any length and depth is rendered whole (nothing recurses). An empty
    table gives an empty one; a kept column with the new name is replaced.
    """
    def make():
        return lambda pages: [pa.array([render(p) for p in pages.to_pylist()], pa.string())]

    return map_texts(df, column, list(keep if keep is not None else [c for c in df.columns if c != column]), [T.StructField(name, T.StringType())], make)
