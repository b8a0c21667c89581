"""Layout-aware rendering of pages."""

import time

import pytest

from tablemine.llm.html_layout import extract, visible_text

CASES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<h1>T</h1>text <b>bold</b>\n  <i>x</i>y", "T\n\ntext bold xy"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=4><li>a</li><li><p>b</p><p>c</p></li></ol>", "4. a\n5. b\n\n   c"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<blockquote>q</blockquote>", "  q"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1</table>", "Name   N\nalpha  1"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>", "wide     z\n1     2  3"),
    ("<table><tr><td>a<p>b</p></td><td><table><tr><td>x<td>y</table></td></table>", "a / b  x  y"),
    ("<pre>\n a\n   b\n</pre>", " a\n   b"), ("<script>var a='<p>';</script>x<style>p{}</style>", "x"),
    ("<head><title>t</title></head><body>b", "b"), ("<!-- <p>no</p> -->yes", "yes"),
    ("<div hidden>a</div><div style='color:red; DISPLAY : none'>b</div><span style='visibility:hidden'>c</span>d", "d"),
    ("<input type=hidden value=h><input value=v><textarea>t &lt;</textarea>", "v\n\nt <"),
    ("<a title='x>y'>link</a>", "link"), ("<select><option>a<option>b</select>", "a\nb"), ("<img alt='a cat'>", "a cat"),
    ("</p></div>stray", "stray"), ("a < b and c > d", "a < b and c > d"), ("x<noscript>n</noscript>", "x"),
]


#: Text in a table outside its cells, and text of drawings.
STRAYS = [
    ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
    ("<table><form><tr><td>a<td>b</tr></form><tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tr><div>a</div></tr></table>z", "a\n\nz"), ("<table>note<tr><td>a<td>b</table>", "note\n\na  b"),
    ("<table><tr>text</tr></table>", "text"), ("<table><tbody>x<tr><td>a</td>y</tr></tbody>z</table>", "xyz\n\na"),
    ("<table><tr><div>s<td>a</td></div><td>b</td></tr></table>", "s\n\na  b"),
    ("<table><div hidden><tr><td>a<td>b</table>", "a  b"), ("<table><tr hidden>x<td>a</td></tr></table>", "x"),
    ("<table><center><tr><td>a<td>b</tr></center></table>", "a  b"),
    ("<table><tr><p>one<p>two<td>a</table>", "one\n\ntwo\n\na"), ("<table><tr><img alt='i'><td>a</table>", "i\n\na"),
    ("<table><tr><td>a<tr><table><tr><td>b</table>", "a\n\nb"), ("<table><tr><td>a<caption>c</table>", "c\na"),
    ("<table><tr><td><table>in<tr><td>x</table><td>b</table>", "in / x  b"),
    ("<table> <tr> <td>a</td> <td>b</td> </tr> </table>", "a  b"),
    ("<table><script>s</script><tr><template>t</template><td>a</table>", "a"),
    ("a<svg><title>t</title><g><text>one <tspan>two</tspan></text></g><path/><text>three</text></svg>b", "a\none two\nthree\nb"),
    ("a<svg><title>t</title><path d='M0'/>x</svg>b", "ab"),
    ("<svg><defs><text>d</text></defs><text display=none>n</text><text>s<desc>e</desc></text></svg>", "s"),
    ("<svg><foreignObject><p>f</p></foreignObject></svg>", "f"), ("<pre>a <svg><text>s</text></svg></pre>", "a s"),
]


def test_quoted_values_of_any_length():
    for value in ("<p>no</p>" * 5_000, "x > y " * 5_000, "<i " * 50_000):
        for quote in "\"'":
            tag = f"<div data-x={quote}{value}{quote}"
            assert visible_text(f"a{tag}>b</div>c") == "a\nb\nc"
            assert visible_text(f"a{tag} hidden>b</div>c") == "ac"
            assert visible_text(f"a{tag} style='display:none'>b</div>c") == "ac"
    assert visible_text("<p class=it's>a<p title='x>y'>b") == "a\n\nb"  # a quote inside a value or name begins none
    assert visible_text("<a href=\"x\"\">a</a> \"b\" > c") == "a \"b\" > c"
    assert visible_text("<a href=\"x>a</a>b") == "ab"


def test_open_quotes_are_read_once():
    t = time.time()
    for unit in ("<a b=\"<c d=\"", "<a b=\"<c=\" d=", "<a b='<a c=\"", "<a=\"<b=\" ", "<a b='x>", "<a b=\"><", "<a b='\"'<"):
        for end in ("", "<", "\"", "'<", ">"):
            visible_text(unit * 30_000 + end)
    assert time.time() - t < 60


@pytest.mark.parametrize("markup,text", STRAYS)
def test_text_outside_cells(markup, text):
    assert visible_text(markup) == text


@pytest.mark.parametrize("markup,text", CASES)
def test_cases(markup, text):
    assert visible_text(markup) == text


def test_large_and_broken_pages_are_quick():
    t = time.time()
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert visible_text("<table><tr><td>" * 400 + "x").strip().endswith("x")
    assert visible_text("<b" * 50_000) is not None
    assert visible_text("<a href=\"x>" * 20_000 + "x") is not None
    assert visible_text("&amp;" * 100_000) == "&" * 100_000
    assert len(visible_text("<p>word</p>" * 50_000).split()) == 50_000
    assert len(visible_text("<table>" + "<tr>x<div>y" * 50_000)) >= 100_000
    assert time.time() - t < 60


def test_operator(spark):
    rows = [(1, "<p>a", "old"), (1, "<p>a", "old"), (2, None, "old"), (None, "", "old")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = extract(pages)
    assert got.columns == ["page_id", "html", "text"]
    assert sorted(((r.page_id or 0, r.text) for r in got.collect())) == [(0, ""), (1, "a"), (1, "a"), (2, "")]
    assert extract(pages.limit(0)).count() == 0


def test_spanning_cells_take_no_room_of_their_own():
    import time
    import tracemalloc
    row = "<tr><td colspan=1000 rowspan=1000>x</td></tr>"
    page = f"<table>{row * 2000}</table>"
    start = time.process_time()
    lines = visible_text(page).split("\n")
    assert time.process_time() - start < 3
    assert len(lines) == 2000 and all(x.strip() == "x" for x in lines)
    tracemalloc.start()
    visible_text(f"<table>{row * 500}</table>")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def _table_by_grid(rows):
    """Lines of a table of (text, colspan, rowspan), by filling every position."""
    taken, cells = set(), {}
    for r, row in enumerate(rows):
        c = 0
        for text, wide, high in row:
            while (r, c) in taken:
                c += 1
            taken |= {(r + d, c + k) for d in range(1, high) for k in range(wide)}
            if text:
                cells[r, c] = text
            c += wide
    columns = sorted({c for _, c in cells})
    width = {k: max([len(t) for (_, c), t in cells.items() if c == k and len(t) <= 80], default=0) for k in columns}
    if len(columns) == 1:
        return [cells[k] for k in sorted(cells)]
    return ["  ".join(cells.get((r, c), "").ljust(width[c]) for c in columns).rstrip() for r in range(len(rows))
            if any((r, c) in cells for c in columns)]


def test_tables_equal_a_full_grid():
    import random
    r = random.Random(9)
    for _ in range(300):
        rows = [[(r.choice(["", "a", "bb", "ccc dd", "w" * 90]), r.choice((1, 1, 1, 2, 5)), r.choice((1, 1, 1, 2, 4)))
                 for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 6))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}</td>" for t, w, h in row) + "</tr>"
                                   for row in rows) + "</table>"
        want = _table_by_grid(rows)
        assert [x for x in visible_text(page).split("\n") if x] == want, rows
