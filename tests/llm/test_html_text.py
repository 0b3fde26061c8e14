import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.html_text import extract, visible_text

CASES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<h1>T</h1>x <b>bold</b>, y", "T\n\nx bold, y"),
    ("<ul><li>one<li>two<ul><li>deep</ul><li>three</ul>after", "- one\n- two\n  - deep\n- three\n\nafter"),
    ("<ol start=3><li>c<li>d</ol>", "3. c\n4. d"),
    ("<table><tr><th>Name<th>Age<tr><td>Al<td>5<tr><td>Barbara<td>41</table>", "Name     Age\nAl       5\nBarbara  41"),
    ("<table><caption>Cap</caption><tbody><tr><td>a</td><td>b</td></tr></tbody></table>x", "Cap\na  b\n\nx"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>", "wide  z\n1  2  3"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("<head><title>T</title><style>.x{display:none} #y, p.z{visibility:hidden}</style></head><body>see<p class=x>no</p><p class='a x'>no</p><p>yes</p>", "see\n\nyes"),
    ("<p hidden>no<p style='DISPLAY : none'>no<p style='visibility:hidden'>no<p>yes", "yes"),
    ("<script>if (a < b) document.write('</p>')</script>ok<noscript>no</noscript><!-- no --><template>no</template>", "ok"),
    ("<pre>a  b\n  c\n\nd</pre>e", "a  b\n  c\n\nd\n\ne"),
    ("&lt;b&gt; &amp; &eacute;&nbsp;x 1 < 2 &copy;", "<b> & é\xa0x 1 < 2 ©"),
    ("a<b>b</b>c <i>d</i> e", "abc d e"),
    ("</div>stray</p>end", "stray\n\nend"),
    ("<a href='x>y'>link</a> <a href=\"u", "link"),
    ("<input type=hidden value=no>a<img alt=no>b", "ab"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"),
    ("<select><option>no<option>no</select>yes", "yes"),
    ("", ""),
    (None, ""),
    ("<", "<"),
    ("<p></p><p> </p>x", "x"),
    ("<b>a<p>b</b>c", "a\n\nbc"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_layout(page, want):
    assert visible_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p title=it's>first</p><p>second</p>", "first\n\nsecond"),
        ('<a href="x"">one</a><p>two</p>', "one\n\ntwo"),
        ('<a href="x"">one</a><p>two</p><p class="c">three', "one\n\ntwo\n\nthree"),
        ("<p \"a>one</p><p b'>two</p>", "one\n\ntwo"),
        ('<p a"b=c>one<p a=b"c>two', "one\n\ntwo"),
        ("<p a = 'x>y' / = \">\">one</p>", '">one'),
        ("<p title=>one<p class='x'hidden>no<p>two", "one\n\ntwo"),
        ("</p it's>one</b \">two", "onetwo"),
        ("x <é y</p><p>z", "x <é y\n\nz"),
        ('<p>a<p title="b>c', "a"),
    ],
)
def test_stray_quotes_end_with_their_tag(page, want):
    assert visible_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<table><tr>total<td>5</td></tr></table>", "total\n5"),
        ("<table><tbody>note<tr><td>a<td>b</tr>more</tbody></table>x", "note\nmore\na  b\n\nx"),
        ("<table><thead>head<tr>one<th>h</thead><tfoot>foot<tr><td>f</tfoot></table>", "head\none\nfoot\nh\nf"),
        ("<table>cap<tr> \n <td>a</td> \n </tr></table>", "cap\na"),
        ("<table><tr hidden>no<td>no</tr><tr>yes<td>a</tr></table>", "yes\na"),
    ],
)
def test_text_outside_cells_is_kept(page, want):
    assert visible_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p style='backface-visibility:hidden'>a", "a"),
        ("<style>@media print{p{display:none}}</style><p>a", "a"),
        ("<style media=print>p{display:none}</style><p>a", "a"),
        ("<style>@media screen and (min-width:1px){p{display:none}} @media not print{b{display:none}}</style><p>a</p><b>b</b>i", "i"),
        ("<style>@media (max-width:600px){p{display:none}}</style><p>a", "a"),
        ("<style>@font-face{font-family:x;src:url(y)} @import 'z'; .x{display:none}</style><p class=x>a</p>b", "b"),
        ("<style>.x{display:none} .x{display:block}</style><p class=x>a", "a"),
        ("<style>.x{display:none!important} .x{display:block}</style><p class=x style='display:block'>a</p>b", "b"),
        ("<style>#i{display:block} .x{display:none}</style><p id=i class=x>a", "a"),
        ("<style>/* .y{ */ p.z{visibility:hidden}</style><p class=z>a</p><p>b</p><b class=z>c", "b\n\nc"),
        ("<style>div .x > b{display:none}</style><div><p class=x><b>a</b><i><b>c</b></i></p></div><p class=x><b>d", "c\n\nd"),
        ("<style>[data-off]{display:none} [role=note]{display:none}</style><p data-off>a</p><p role=note>b</p><p role=x>c", "c"),
        ("<style>p:hover{display:none} a + p{display:none}</style><p>a", "a"),
        ("<p style='visibility:hidden'>a <b style='visibility:visible'>b</b> c</p>d", "b\n\nd"),
        ("<p hidden style='display:block'>a", "a"),
        ("<dialog>a</dialog><dialog open>b</dialog>", "b"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
        ("<svg><title>no</title><defs><text>no</text></defs>no<text>one</text><g><text>two <tspan>three</tspan></text></g></svg>end", "one\ntwo three\nend"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>a<td rowspan=0>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td colspan=2 rowspan=2>ab<td>c<tr><td>d<tr><td>1<td>2<td>3</table>", "ab    c\n      d\n1  2  3"),
        ("<table><tr><td>" + "w" * 60 + "<td>b<tr><td>c<td>d</table>", "w" * 60 + "  b\nc" + " " * 61 + "d"),
        ("<table><tr style='visibility:hidden'><td>a<td style='visibility:visible'>b<tr><td>c<td>d</table>", "   b\nc  d"),
    ],
)
def test_what_is_visible(page, want):
    assert visible_text(page) == want


def test_wide_cells_and_spans_cost_no_more_than_their_text():
    page = "<table><tr><td>" + "w" * 200_000 + "<td>x" + "<tr><td>a<td>b" * 20_000 + "</table>"
    assert len(visible_text(page)) < 2_000_000
    assert len(visible_text("<table>" + "<tr><td colspan=1000>a<td>b" * 20_000 + "</table>")) < 2_000_000
    start = time.time()
    visible_text("<style>" + ".x p{display:none}" * 2_000 + "</style>" + "<p>a" * 2_000)
    assert time.time() - start < 30


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "<ul>", "<li>", "</ul>", "<div hidden>", "</div>", "<pre>", "</pre>", "<h1>", "</h1>", "<br>", "text", " ", "\n", "<!--", "-->", "<script>", "</script>", "&amp;", "<", ">", "<b", '"', "<dd>", "<thead>", "<style>p{display:none}</style>"]), max_size=40))
def test_any_soup_gives_text(parts):
    out = visible_text("".join(parts))
    assert isinstance(out, str) and out == out.strip("\n")


def test_time_grows_with_length():
    for page in ("<div>" * 100_000 + "x", "<a " * 200_000, "<" * 200_000, "<p>x" * 100_000, "<table><tr><td>" * 3_000, "<ul><li>" * 3000, "<!-- " * 100_000, "<script>" * 50_000, '<a b="' * 100_000):
        start = time.time()
        visible_text(page)
        assert time.time() - start < 10, page[:20]


def test_table(spark):
    rows = [(1, "u", "<p>a"), (None, None, None), (2, "v", ""), (2, "v", "<td>x")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(((str(r.page_id), r.url, r.text) for r in extract(pages).collect()), key=str)
    assert got == sorted([("1", "u", "a"), ("None", None, ""), ("2", "v", ""), ("2", "v", "x")], key=str)
    assert extract(pages.limit(0)).count() == 0


class Plain(HTMLParser):
    """Words of a page by another library's tokenizer: all but what scripts, styles, the head and hidden elements hold."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript", "template"):
            self.off += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "noscript", "template"):
            self.off -= 1

    def handle_data(self, data):
        if not self.off:
            self.words += re.findall(r"[^\s|]+", data)


def test_every_visible_word_of_the_pages_in_order(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        other = Plain()
        other.feed(r.html or "")
        other.close()
        text = re.sub(r"(?m)^ *(?:- |\d+\. )", "", visible_text(r.html))
        assert "".join(re.findall(r"[^\s|]+", text)) == "".join(other.words), r.page_id


def test_pages_lose_scripts_and_keep_paragraphs(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        text = visible_text(r.html)
        assert "track(" not in text and "margin:0" not in text and "<p>" not in text
        assert text.count("\n- ") >= 5 or text.startswith("- ")
