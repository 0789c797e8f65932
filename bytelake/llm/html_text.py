"""Text of HTML pages as a reader sees it: a tree with implied tags, visibility rules and a layout of blocks, lists and tables."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag. Of these, title and textarea have character references.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg math datalist title meta link select option textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption tr ul".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu dir".split())
#: A start tag of the first kind ends an open element of the second, up to a boundary.
_PARAGRAPH_ENDERS = BLOCK - frozenset("body html dd dt li caption tr legend".split()) | {"dd", "dt", "li"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, set()),
}
#: End tags do not close an element beyond these.
SCOPE = frozenset("table td th caption html button object template".split())
#: Quotes open a value only behind an equals sign; elsewhere they are part of a name or of an unquoted value.
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?)?+")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
#: Columns and rows that a cell spans at most (fixed values of the standard).
WIDEST, HIGHEST = 1000, 65534
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())


class Node:
    __slots__ = ("attributes", "children", "numbers", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children, self.numbers = tag, attributes or {}, [], None

    def number_of(self, item: Node) -> int:
        """The number of an item of this ordered list; all are counted at once."""
        if self.numbers is None:
            self.numbers, number = {}, _number(self.attributes.get("start"), 1)
            for c in self.children:
                if isinstance(c, Node) and c.tag == "li" and visible(c):
                    self.numbers[id(c)] = number = _number(c.attributes.get("value"), number)
                    number += 1
        return self.numbers[id(item)]


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    """The page's tree. Unknown end tags are dropped, open elements end with the page, and start tags imply the ends and parents that the standard's tree builder gives them."""
    root = Node("html")
    stack = [root]
    # elements are numbered as they open; of each tag, the numbers of its open elements, so none is sought through a deep stack
    numbers, opened, n = [0], defaultdict(list), 0
    at = 0

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def pop() -> Node:
        numbers.pop()
        opened[stack[-1].tag].pop()
        return stack.pop()

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s))

    def end(names, boundary) -> None:
        beyond = last(boundary)
        while (k := last(names)) > beyond:
            while numbers[-1] >= k:
                pop()

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal n
        if tag == "html":
            root.attributes |= {k: v for k, v in attributes.items() if k not in root.attributes}
            return
        if tag in ENDS:
            end(*ENDS[tag])
        if tag in _PARAGRAPH_ENDERS:
            end({"p"}, SCOPE)
        top = stack[-1].tag
        if tag == "tr" and top == "table":
            start("tbody", {})
        elif tag in ("td", "th") and top in ("table", "thead", "tbody", "tfoot"):
            start("tr", {})
        if top == "head" and tag not in HIDDEN and tag not in ("base", "meta", "link"):
            pop()
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            n += 1
            stack.append(node)
            numbers.append(n)
            opened[tag].append(n)

    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            if stack[-1].tag == "head" and page[at : m.start()].strip():
                pop()
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                start("br", {})
            elif tag == "p" and not opened["p"]:
                start("p", {})
                pop()
            else:
                scope = {"table"} if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else SCOPE - {tag}
                k = last((tag,))
                if k > (0 if tag in ("table", "body") else last(scope)):
                    if tag in FORMATTING:  # blocks opened inside of it go on
                        opened[tag].pop()
                        place = bisect_left(numbers, k)
                        del stack[place], numbers[place]
                    else:
                        while numbers[-1] >= k:
                            pop()
            continue
        start(tag, _attributes(m[3]) if "=" in m[3] or " " in m[3] or "\n" in m[3] else {})
        if tag in RAW and stack[-1].tag == tag:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            raw = page[at : close.start()]
            pop().children.append(html.unescape(raw) if tag in ("title", "textarea") else raw)
            at = close.end()
    text(page[at:])
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a:
        return False
    return not (a.get("style") and _GONE.search(a["style"]))


class _Page:
    """Lines as they come: inline text gathers white space to one blank, blocks start lines of their own, spaced ones leave one line empty."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []  # pieces, none of them empty
        self.gap, self.blank = False, False

    def inline(self, text: str) -> None:
        for k, part in enumerate(_SPACE.split(text)):
            self.gap = self.gap or k > 0
            if part:
                if self.gap and self.line:
                    self.line.append(" ")
                self.line.append(part)
                self.gap = False

    def verbatim(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.line.append(first)
        for x in rest:
            self.new_line()
            if x:
                self.line.append(x)

    def new_line(self) -> None:
        self.put("".join(self.line))
        self.line, self.gap = [], False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(line.rstrip(" "))

    def block(self, spaced: bool) -> None:
        """Ends the line, if there is one; spaced: the next one follows an empty line."""
        if self.line:
            self.new_line()
        self.gap = False
        self.blank = self.blank or spaced

    def out(self) -> list[str]:
        self.block(False)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        first = next((k for k, line in enumerate(self.lines) if line), 0)
        return self.lines[first:]


def _run(job: Generator):
    """The result of a generator that yields generators for their results: recursion with a stack of its own, so pages may be of any depth."""
    jobs, value = [job], None
    while jobs:
        try:
            inner = jobs[-1].send(value)
        except StopIteration as done:
            jobs.pop()
            value = done.value
        else:
            jobs.append(inner)
            value = None
    return value


def _lines(node: Node) -> Generator:
    page = _Page()
    for child in node.children:
        yield _lay(child, page, node)
    return page.out()


def _indented(page: _Page, lines: list[str], first: str, rest: str) -> None:
    for k, line in enumerate(lines or [""]):
        page.put(((first if k == 0 else rest) + line) if line or k == 0 else "")


def _lay(node: Node | str, page: _Page, parent: Node, pre: bool = False) -> Generator:
    if isinstance(node, str):
        (page.verbatim if pre else page.inline)(node)
        return
    if not visible(node):
        return
    tag = node.tag
    if tag == "br":
        page.new_line()
    elif tag == "hr":
        page.block(True)
        page.put("---")
        page.block(True)
    elif tag == "li":
        page.block(False)
        if parent.tag == "ol":
            mark = f"{parent.number_of(node)}. "
        else:
            mark = "* "
        _indented(page, (yield _lines(node)), mark, " " * len(mark))
    elif tag in ("dd", "blockquote"):
        page.block(tag in SPACED)
        _indented(page, (yield _lines(node)), "  ", "  ")
        page.block(tag in SPACED)
    elif tag == "table":
        page.block(True)
        for line in (yield _table(node)):
            page.put(line)
        page.block(True)
    elif tag == "q":
        page.inline('"')
        yield _children(node, page, pre)
        page.line.append('"')
    else:
        block = tag in BLOCK
        # a list inside a list's item, or inside another, keeps close to it
        spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and parent.tag in ("li", "ul", "ol"))
        if block:
            page.block(spaced)
        yield _children(node, page, pre or tag in ("pre", "listing", "xmp"))
        if block:
            page.block(spaced)
        elif tag in ("td", "th"):  # outside of a table
            page.gap = True


def _children(node: Node, page: _Page, pre: bool) -> Generator:
    for k, child in enumerate(node.children):
        if k == 0 and node.tag in ("pre", "listing") and isinstance(child, str):
            child = child.removeprefix("\r").removeprefix("\n")
        yield _lay(child, page, node, pre)


def _number(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", text) else otherwise


def _table(table: Node) -> Generator:
    """The caption, then the rows with their cells' lines side by side, each column as wide as its widest line. Cells that span columns or rows take their place and widen none; what stands outside of cells comes first."""
    captions, rows, loose = [], {"thead": [], "tbody": [], "tfoot": []}, Node("div")

    def gather(node: Node, section: str) -> None:
        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    loose.children.append(c)
            elif not visible(c):
                continue
            elif c.tag in rows:
                gather(c, c.tag)
            elif c.tag == "tr":
                rows[section].append(c)
            elif c.tag == "caption":
                captions.append(c)
            elif c.tag not in ("colgroup", "col"):
                loose.children.append(c)

    gather(table, "tbody")
    grid: list[list[tuple[int, int, list[str]]]] = []
    free: list[int] = []  # for each column, the first row that no cell from above reaches
    for y, row in enumerate(rows["thead"] + rows["tbody"] + rows["tfoot"]):
        x, cells = 0, []
        for c in row.children:
            if isinstance(c, str):
                if c.strip():
                    loose.children.append(c)
                continue
            if not visible(c):
                continue
            while x < len(free) and free[x] > y:
                x += 1
            wide = min(WIDEST, max(1, _number(c.attributes.get("colspan"), 1)))
            high = min(HIGHEST, max(1, _number(c.attributes.get("rowspan"), 1)))
            if high > 1:
                free += [0] * (x + wide - len(free))
                free[x : x + wide] = [max(y + high, f) for f in free[x : x + wide]]
            cells.append((x, wide, (yield _lines(c))))
            x += wide
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for x, wide, lines in cells:
            if wide == 1:
                widths[x] = max([widths.get(x, 0), *map(len, lines)])
    starts, at, left = {}, 0, sorted(x for x, w in widths.items() if w)[::-1]
    for x in sorted({x for cells in grid for x, _, _ in cells}):
        while left and left[-1] < x:
            at += widths[left.pop()] + 2
        starts[x] = at
    out = yield _lines(loose)
    for c in captions:
        out += yield _lines(c)
    for cells in grid:
        cells = [(x, lines) for x, _, lines in cells if lines]
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            pieces, size, cells = [], 0, [c for c in cells if len(c[1]) > k]
            for x, lines in cells:
                if lines[k]:
                    gap = starts[x] - size if size < starts[x] or not size else 2
                    pieces += [" " * gap, lines[k]]
                    size += gap + len(lines[k])
            out.append("".join(pieces).rstrip())
    return out


def render(page: str | None) -> str:
    """All visible text of a page. Null or empty pages give the empty text."""
    return "\n".join(_run(_lines(parse((page or "").replace("\x00", "")))))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: page_id, text (all visible text, laid out), n_chars, n_lines (0 for an empty text).

    Null html is empty; null ids stay null; repeated rows are rendered each; other columns are ignored; an empty table gives no rows. Broken markup never fails. One pass without a shuffle.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                texts = [render(x) for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                    names=["page_id", "text", "n_chars", "n_lines"],
                )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string")).mapInArrow(part, "page_id long, text string, n_chars long, n_lines long")
