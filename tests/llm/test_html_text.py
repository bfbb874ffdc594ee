import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fovea.llm.html_text import extract_text, page_text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>one<p>two<div>three</div>four<br>five", "one\n\ntwo\n\nthree\nfour\nfive"),
        ("<ul><li>a<li>b<ul><li>c<li>d</ul><li>e</ul>", "- a\n- b\n  - c\n  - d\n- e"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<table><tr><th>Name<th>No<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name   No\nalpha  1\nb      22"),
        ("<table><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>", "wide cell here\na  b"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("<table>loose<tr><td>in</table>", "loose\n\nin"),
        ("<title>no</title><style>p{}</style><script>var t='</p>';</script>yes<!-- no --><noscript>no</noscript>", "yes"),
        ("<p hidden>no</p><p style='DISPLAY : none'>no</p><b style=visibility:hidden>no</b>yes", "yes"),
        ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("<pre>\n  a\n    b</pre>", "  a\n    b"),
        ("a &amp; b &lt;c&gt; &copy; &#65;&am", "a & b <c> © A&am"),
        ("a <b> bold </b> c", "a bold c"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("<a href='x>y'>link</a> after", "link after"),
        ("text <a href=\"never closed", "text"),
        ("<p>a</b></i></div>b", "ab"),
        ("<dl><dt>t<dd>d<dt>u<dd>v</dl>", "t\n  d\nu\n  v"),
        ("<select><option>one<option>two</select>", "one\ntwo"),
        ("<head><title>t</title><p>body text", "body text"),
        ("<script>never closed <p>x", ""),
        ("<template><p>no</template>yes", "yes"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
        ("<table><tr><td>a<td rowspan=0>B<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  B  c\nd     e\nf     g"),
        ("<table><tbody><tr><td rowspan=9>A<td>b<tbody><tr><td>c<td>d</table>", "A  b\nc  d"),
        ("<table><tr><td rowspan=2 colspan=2>AAAA<td>b<tr><td>c<tr><td>x<td>y<td>z</table>", "AAAA  b\n      c\nx  y  z"),
        ("<table><tr><td>a<td hidden>no<td>c<tr><td>d<td>e<td>f</table>", "a     c\nd  e  f"),
        ("<table><tr><td>a<td style='visibility:hidden'>no<td>c<tr><td>d<td>e<td>f</table>", "a     c\nd  e  f"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
        ("<div style='visibility:hidden'><p>no<p style='visibility:visible'>yes<table style='visibility:visible'><tr><td>cell</table></div>", "yes\n\ncell"),
        ("<div style='display:none'><b style='visibility:visible'>no</b></div>yes", "yes"),
        ("<p style=\"content:'display:none'\">yes</p>", "yes"),
        ("<p style='color:red;/* display:none */'>yes</p><p style='background:url(a;display:none)'>yes</p><p style='x;display:none'>no</p>", "yes\n\nyes"),
        ("<p style='display:none!important;display:block'>no</p><p style='display:none;display:block'>yes</p>", "yes"),
        ("<svg><title>no</title><desc>no</desc><text>yes</text></svg> <math><mi>x</mi><annotation>no</annotation></math>", "yes x"),
        ("<div>" * 3000 + "<script>if (a<b) {}</script><div hidden>no<div>no</div></div>yes<table><tr><td>cell" + "</div>" * 3000, "yes\n\ncell"),
        ("<font>" * 5000 + "<p hidden>no</p>yes", "yes"),
    ],
)
def test_pages(html, text):
    assert page_text(html) == text


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<b><p>" * 30_000, "<a x=\"" * 50_000, "<" * 200_000, "<table><tr><td>" * 3000, "<!--" * 50_000, "</p>" * 50_000, "&" * 100_000, "<table><tr><td rowspan=65534 colspan=1000>x" * 500, "<ul><li>" * 20_000 + "x", "<p style='" + "a:b;" * 100_000 + "'>x", "<p style=\"" + "a:'" * 50_000 + "\">x"])
def test_broken_pages_end(html):
    began = time.time()
    page_text(html)
    assert time.time() - began < 20


HOSTILE = ["<ul><li>{}", "<ol><li>{}", "<blockquote>{}", "<dl><dd>{}", "<table><tr><td>{}", "<table><tr><td>{}<td>{}", "<div><table><tbody><tr><th>{}</th><td>", "<tr><td rowspan=0>{}", "<tr><td rowspan=60000>{}", "<td colspan=1000>{}<td>{}", "<br>{}"]


@pytest.mark.parametrize("unit", HOSTILE)
def test_pages_with_text_at_every_level_stay_small(unit):
    """Output within a fixed multiple of the page, all words in it, in time that grows with the page."""
    html = ("<table><tr><td>" + "w" * 500 + "<td>" if unit[1] == "b" and unit[2] == "r" else "<table>" if unit[1:3] in ("tr", "td") else "") + unit.replace("{}", "word ") * 10_000
    began = time.time()
    text = page_text(html)
    assert time.time() - began < 20
    assert text.count("word") == html.count("word")
    assert len(text) <= 25 * len(html)


def test_indents_end_but_marks_stay():
    lines = page_text("<ul><li>x" * 30).split("\n")
    assert lines[:2] == ["- x", "  - x"] and lines[-1] == " " * 38 + "- x" and {line.strip() for line in lines} == {"- x"}


def test_a_table_that_pads_too_much_is_not_aligned():
    """Cells that reach down push each row further to the right; text stays in order."""
    few, many = ("<table>" + "<tr><td rowspan=0>x" * n + "</table>" for n in (4, 2000))
    assert page_text(few) == "x\n   x\n      x\n         x"
    assert page_text(many) == "\n".join(["x"] * 2000)


def test_tables_deep_in_others_show_cell_under_cell():
    html = "<table><tr><td>a<td>"
    assert page_text(html * 2 + "b") == "a  a  b"
    assert page_text(html * 12 + "b").split() == ["a"] * 12 + ["b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<pre>", "</pre>", "<br>", "<h1>", "</h1>", "word", " ", "<div hidden>", "</div>"]), max_size=40))
def test_nothing_crashes_and_words_keep_their_number(parts):
    text = page_text("".join(parts))
    assert text.count("word") <= parts.count("word")
    if "<div hidden>" not in parts:
        assert text.count("word") == parts.count("word")


def test_table(spark):
    rows = [(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (2, "u", None, 5), (3, "u", "", 5), (None, "u", "<b>x", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted(map(str, extract_text(pages).collect())) == sorted(f"Row(page_id={i}, text={t!r})" for i, t in ((1, "a"), (1, "a"), (2, None), (3, ""), (None, "x")))
    assert extract_text(pages.limit(0)).count() == 0


def grid(rows):
    """Columns of cells given as (text, columns, rows) by filling a plain grid square by square."""
    taken, out = set(), []
    for y, row in enumerate(rows):
        x = 0
        for text, over, down in row:
            while (y, x) in taken:
                x += 1
            taken |= {(y + j, x + i) for j in range(down) for i in range(over)}
            out.append((y, x, text))
            x += over
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "bb", "ccc"]), st.integers(1, 2), st.integers(1, 3)), min_size=1, max_size=4), min_size=1, max_size=5))
def test_cells_stand_where_a_plain_grid_puts_them(rows):
    """Words of cells of one column begin at one place, the columns in order."""
    rows = [[(f"{text}{y}{k}", over, down) for k, (text, over, down) in enumerate(row)] for y, row in enumerate(rows)]
    html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={o} rowspan={d}>{t}</td>" for t, o, d in row) + "</tr>" for row in rows) + "</table>"
    lines = page_text(html).split("\n")
    assert [line.split() for line in lines] == [[t for t, _, _ in row] for row in rows]
    single = {t: o == 1 for row in rows for t, o, _ in row}
    begins = {}
    for y, x, text in grid(rows):
        line = lines[y]
        if all(single[t] for t in line.split()):
            begins.setdefault(x, set()).add(line.index(text))
    assert all(len(b) == 1 for b in begins.values())
    firsts = [min(begins[x]) for x in sorted(begins)]
    assert firsts == sorted(firsts)
