import html
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytelake.llm.html_text import extract, render

CASES = {
    "": "",
    "plain &amp; <b>bold</b>,\n <i>it</i>": "plain & bold, it",
    "<title>t</title><p>one<p>two<br>line<div>three</div>four": "one\n\ntwo\nline\n\nthree\nfour",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "* a\n* b\n  * c\n* d",
    "<ol start=3><li>x<li value=9>y<li>z<li hidden>h</ol>": "3. x\n9. y\n10. z",
    "<table><caption>cap<tr><th>Name<th>Value<tr><td>long name<td>1<tr><td>z<td>2<br>3</table>": "cap\nName       Value\nlong name  1\nz          2\n           3",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell here</table>": "a  b\n   c\nwide cell here",
    "<table>loose<tr><td>in</table>": "loose\nin",
    "a<script>var t='</p>';</script>b<style>p{}</style><!-- <p>c --><noscript>d</noscript><template>e</template>": "ab",
    "<p hidden>x</p><p style='color:red; display: none'>y</p><p style='visibility:hidden'>z</p><p aria-hidden=true>seen": "seen",
    "<pre>\n a  b\n\n   c</pre>after": " a  b\n\n   c\n\nafter",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<h1>H</h1>text<hr>end</p>x": "H\n\ntext\n\n---\n\nend\n\nx",
    "<b><p>mis</b>nested</p>": "misnested",
    "<td>cell</td><td>other</td> <li>item": "cell other\n* item",
    "<a href='x>y' title=\"<p>\">link</a> <unknown>kept</unknown> 1 < 2 &lt; 3 &nbosp;": "link kept 1 < 2 < 3 &nbosp;",
    "<textarea><p>t</textarea><select><option>o</select><img alt=i><input value=v>done": "done",
    "<q>said</q>&nbsp;x": '"said"\xa0x',
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<script>never closed <p>x": "",
    "<ruby>a<rt>b</ruby>": "ab",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert render(page) == CASES[page]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "</table>", "<tr>", "<td colspan=3>", "<li>", "<ul>", "</ul>", "<div hidden>", "</div>", "<!--", "<a b='", "&#x0;", "&amp", "x y", "\n", "<pre>", "<", ">", "'", "\x00", "<body>", "</html>", "<head>", "<br/>"]), max_size=30))
def test_never_fails(parts):
    assert isinstance(render("".join(parts)), str)


def test_deep_and_long():
    assert render("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert render("<b>" * 5000 + "x") == "x" and render("word " * 200_000) == " ".join(["word"] * 200_000)
    assert render("<ul><li>" * 3000 + "x").strip(" *\n") == "x"


@pytest.mark.parametrize("open_", ["<div>", "<span>", "<font color=red>"])
def test_deep_pages_are_as_shallow_ones(open_):
    deep = open_ * 250
    assert render(deep + "a<script>var x = '<p>code';</script><style>p{}</style>b") == "ab"
    assert render(deep + "a<b hidden>gone<i>gone</i></b><i style='display:none'>gone</i><template>gone</template>b") == "ab"
    assert render(deep + "<ul><li>x<li>y</ul><table><tr><td>c<td>d</table>") == "* x\n* y\n\nc  d"
    assert render("<section hidden>" + deep + "<u>gone</u></font></u>gone</section>seen") == "seen"


def test_stray_quotes():
    assert render('<div class=foo">text</div> <p id="a" "b>more</p>') == "text\n\nmore"
    assert render("<b title=it's>one</b> two <a href = 'x>y' data=x\"hidden\">three</a>") == "one two three"


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b", 0), (None, None, None, 0), (1, "u", "<p>a<p>b", 0)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, extract(pages).collect()), key=str) == [(1, "a\n\nb", 4, 3), (1, "a\n\nb", 4, 3), (None, "", 0, 0)]
    assert extract(pages.limit(0)).count() == 0


def tree(rng, depth, inline=False):
    """A random element as (tag, attributes, children); children are elements or texts."""
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["one", " two  three\n", "<&>", " ", "é", "a b c ", ""])
    tags = ["b", "i", "span", "q"] if inline else ["b", "span", "div", "section", "p", "h2", "ul", "ol", "blockquote", "dl", "table", "br", "hr", "script", "hidden", "pre"]
    tag = rng.choice(tags)
    many = lambda f, n=4: [f() for _ in range(rng.randrange(n))]
    if tag in ("ul", "ol"):
        start = {"start": str(rng.randrange(20))} if tag == "ol" and rng.random() < 0.3 else {}
        return tag, start, many(lambda: ("li", {"value": str(rng.randrange(90))} if rng.random() < 0.2 else {"hidden": ""} if rng.random() < 0.1 else {}, many(lambda: tree(rng, depth - 1))))
    if tag == "dl":
        return tag, {}, many(lambda: (rng.choice(["dt", "dd"]), {}, many(lambda: tree(rng, depth - 1))))
    if tag == "table":
        span = lambda: {k: str(rng.randrange(1, 4)) for k in ("colspan", "rowspan") if rng.random() < 0.2}
        return tag, {}, [("tbody", {}, many(lambda: ("tr", {}, many(lambda: ("td", span(), many(lambda: tree(rng, depth - 1)))))))]
    if tag in ("br", "hr"):
        return tag, {}, []
    if tag == "script":
        return tag, {}, ["var x = 1"]
    if tag == "hidden":
        return "div", {"style": "display:none"}, many(lambda: tree(rng, depth - 1))
    if tag == "pre":
        return tag, {}, [" x\n  y  z"]
    return tag, {}, many(lambda: tree(rng, depth - 1, inline or tag in ("p", "h2", "b", "span", "q")))


def written(node):
    if isinstance(node, str):
        return html.escape(node)
    tag, attributes, children = node
    inside = children[0] if tag == "script" else "".join(map(written, children))
    return f"<{tag}{''.join(f' {k}=\"{v}\"' for k, v in attributes.items())}>{inside}" + ("" if tag in ("br", "hr") else f"</{tag}>")


SPACED_ = {"p", "h2", "ul", "ol", "dl", "blockquote", "pre", "table", "hr"}
BLOCK_ = SPACED_ | {"div", "section", "dt", "dd", "li"}


def events(node, parent, pre=False):
    """The page as a flat list: characters, ("end",) of a block or ("space",) around it, ("break",), and ("line", text) that stand as they are."""
    if isinstance(node, str):
        return [("pre" if pre else "text", c) for c in node]
    tag, attributes, children = node
    if tag == "script" or "hidden" in attributes or attributes.get("style"):
        return []
    inner = lambda: slow_lines(node)
    around = ("space",) if tag in SPACED_ and not (tag in ("ul", "ol") and parent in ("li", "ul", "ol")) else ("end",)
    if tag == "br":
        return [("break",)]
    if tag == "hr":
        return [around, ("line", "---"), around]
    if tag in ("dd", "blockquote"):
        return [around, *(("line", "  " + x if x else x) if k else ("line", "  " + x) for k, x in enumerate(inner() or [""])), around]
    if tag == "table":
        return [around, *(("line", x) for x in slow_table(node)), around]
    out = []
    if tag in ("ul", "ol"):
        n = int(attributes.get("start", 1))
        for child in children:
            if "hidden" in child[1]:
                continue
            n = int(child[1].get("value", n))
            mark = f"{n}. " if tag == "ol" else "* "
            n += 1
            lines = slow_lines(child) or [""]
            out += [("end",), ("line", mark + lines[0]), *(("line", " " * len(mark) + x if x else "") for x in lines[1:])]
    else:
        for child in children:
            out += events(child, tag, pre or tag == "pre")
        if tag == "q":
            out = [("text", '"'), *out, ("quote",)]
    return [around, *out, around] if tag in BLOCK_ else out


def slow_lines(node):
    """The lines of an element's inside, one event at a time."""
    stream = [e for child in node[2] for e in events(child, node[0])]
    lines, line, gap, blank = [], "", False, False

    def put(x):
        nonlocal blank
        lines.extend([""] if blank and lines else [])
        lines.append(x.rstrip(" "))
        blank = False

    for kind, *what in [*stream, ("end",)]:
        if kind == "text":
            if what[0] in " \n":
                gap = True
            else:
                line, gap = line + (" " if gap and line else "") + what[0], False
        elif kind == "quote":
            line += '"'
        elif kind == "pre":
            if what[0] == "\n":
                put(line)
                line, gap = "", False
            else:
                line += what[0]
        elif kind == "line":
            put(what[0])
        elif kind == "break":
            put(line)
            line, gap = "", False
        else:
            if line:
                put(line)
            line, gap, blank = "", False, blank or kind == "space"
    while lines and not lines[-1]:
        del lines[-1]
    while lines and not lines[0]:
        del lines[0]
    return lines


def slow_table(node):
    taken, cells = set(), []
    for y, row in enumerate(node[2][0][2]):
        x = 0
        for cell in row[2]:
            while (y, x) in taken:
                x += 1
            wide, high = int(cell[1].get("colspan", 1)), int(cell[1].get("rowspan", 1))
            taken |= {(y + j, x + i) for i in range(wide) for j in range(1, high)}
            cells.append((y, x, wide, slow_lines(cell)))
            x += wide
    width = {x: max([0, *(len(s) for _, x2, wide, lines in cells for s in lines if x2 == x and wide == 1)]) for x in range(200)}
    out = []
    for y in range(len(node[2][0][2])):
        mine = [(x, lines) for y2, x, _, lines in cells if y2 == y]
        for k in range(max([0, *(len(lines) for _, lines in mine)])):
            line = ""
            for x, lines in mine:
                if k < len(lines) and lines[k]:
                    start = sum(w + 2 for x2, w in width.items() if x2 < x and w)
                    line = (line + " " * (start - len(line)) if start > len(line) or not line else line + "  ") + lines[k]
            out.append(line.rstrip())
    return out


@pytest.mark.parametrize("seed", range(400))
def test_equals_a_slow_renderer(seed):
    rng = random.Random(seed)
    body = [tree(rng, 5) for _ in range(4)]
    page = "".join(map(written, body))
    assert render(page) == "\n".join(slow_lines(("body", {}, body))), page


def test_time_follows_the_length():
    pages = {
        "words": lambda n: "<p>" + "wörd " * n, "tags": lambda n: "<p>" + "<b>x</b> " * n, "items": lambda n: "<ol>" + "<li>x" * n, "spans": lambda n: "<table>" + "<tr><td colspan=1000 rowspan=1000>a" * (n // 500),
        "row": lambda n: "<table><tr>" + "<td>a" * n, "verbatim": lambda n: "<pre>" + "x\n" * n, "breaks": lambda n: "<br>" * n + "x",
    }
    for name, page in pages.items():
        text = page(100_000)
        start = time.perf_counter()
        render(text)
        assert time.perf_counter() - start < 20, name
    assert render("<ol>" + "<li>x" * 100_000).endswith("\n100000. x")
