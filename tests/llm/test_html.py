"""Rendering of pages: hand-derived layouts, random text blocks, the given pages, defined cases."""

import random
import re
import time
from html import escape, unescape
from html.parser import HTMLParser

import pytest

from corpuslens.llm.htmltext import extract, visible_text

SF = "/root/testdata/sf0.01"
CASES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("  a \n b  ", "a b"),
    ("<p>one<p>two</p>three", "one\n\ntwo\n\nthree"),
    ("a<div>b</div>c", "a\nb\nc"), ("a <b>b</b><i> c</i>d", "a b cd"), ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<h1>T</h1><p>t", "T\n\nt"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "* a\n* b\n  * c\n* d\n\ne"),
    ("<ol start=3><li>a<li value=7>b</li><li>c</ol>", "3. a\n7. b\n8. c"),
    ("<ul><li><p>a</p><p>b</p></li></ul>", "* a\n\n  b"),
    ("<table><tr><th>ab<td>c<tr><td>d<td>efg</table>", "ab | c\nd  | efg"),
    ("<table><caption>cap</caption><tbody><tr><td>1<td>2<br>3<tr><td colspan=2>wide<td>x</table>y",
     "cap\n1    | 2\n     | 3\nwide |   | x\n\ny"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>o</table>", "in | ner | o"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
    ("<pre>\n a\n  b\n</pre>c", " a\n  b\n\nc"), ("<blockquote>q<br>r</blockquote>", "> q\n> r"),
    ("<title>no</title><script>var a='<p>'</script><style>p{}</style>yes", "yes"),
    ("<p hidden>a</p><p style='color:red; display : none'>b</p><p style=display:block>c</p><span style='visibility:hidden'>d</span>", "c"),
    ("<!-- c --><!DOCTYPE html><?x?>a<!-- open", "a"), ("a < b <3 &lt;p&gt; &nope; &#65;", "a < b <3 <p> &nope; A"),
    ("<p>a</b></i>b</div>c", "abc"), ("<div>a<p>b</div>c", "a\n\nb\n\nc"), ("</p>x<select><option>o</select>", "x"),
    ("<a title='a>b'>link</a>", "link"), ("<head><meta charset=x>text", "text"), ("<noscript>n</noscript><textarea>t</textarea>v", "v"),
    ("a<hr>b", "a\n\n---\n\nb"), ("<script>never ends", ""), ("<P>UP</P>", "UP"), ("<q>x</q>", "“x”"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_layout(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<p title=it's>Don't go there</p> more <b>x</b>", "Don't go there\n\nmore x"), ('<p 5" x>a</p><b "c>d</b>', "a\n\nd"),
    ("<a href=x=\"y>z</a> \"w", 'z "w'), ("<a title = 'a>b' href=\"c>d\">link</a>", "link"), ("<a title=>b</a>", "b"),
    ("<p title=it's hidden>a</p>b", "b"), ("<p =\"a>b", "b"), ("<a title='a'b=\"c>d\">e", "e"),
])
def test_quotes_open_values_only(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("a <math><mi>x</mi><mo>=</mo><mfrac><mrow><mi>b</mi><mo>+</mo><mn>1</mn></mrow><msup><mi>c</mi><mn>2</mn></msup></mfrac></math> d", "a x=(b+1)/c^2 d"),
    ("<math><semantics><mi>x</mi><annotation>tex</annotation></semantics></math>y", "xy"),
    ("a<svg><title>t</title><defs><text>no</text></defs><path d=z /><text>one</text><text>two</text></svg>b", "a one two b"),
    ("<textarea>\nt\n u</textarea>v", "t\n u v"), ("<p>x<select><option>o<option selected>p</select>y", "x p y"),
    ("<select><option>o<option>p</select>", "o"), ("<select multiple><optgroup label=g><option>o<option>p</select>", "g o p"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>", "a | b |  | c\nd |   |  | e\nf | g"),
])
def test_formulas_drawings_forms_and_row_spans(spark, html, text):
    assert visible_text(html, forms=True) == text
    assert extract(spark.createDataFrame([(1, html)], "page_id long, html string")).first().text == text


def test_random_blocks_keep_all_text_in_order():
    draw = random.Random(0)
    for _ in range(200):
        words, html = [], []
        for _ in range(draw.randrange(1, 15)):
            w = "".join(draw.choice("abé<&\"") for _ in range(draw.randrange(1, 6)))
            tag = draw.choice(["p", "div", "b", "li", "td", "h2", "section", "i", "blockquote"])
            html.append(f"<{tag}> {escape(w)} {draw.choice(['', f'</{tag}>'])}")
            words.append(w)
        shown = visible_text("".join(html))
        assert [w for w in shown.split() if w not in ("*", ">", "|")] == words


@pytest.mark.parametrize("html, text", [
    ("<div style='visibility:hidden'>a<p style='visibility:visible'>b</p>c</div>d", "b\n\nd"),
    ("<dialog>a</dialog><dialog open>b</dialog><details>c<summary>s</summary>d</details><details open><summary>t</summary>e</details>", "b\ns\nt\ne"),
    ("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "漢kan"), ("a<meter value=1>m</meter><progress>p</progress>b", "ab"),
    ("x<input type=submit value=Go><input type=reset><input type=button value='B &amp; C'><input type=text value=no>y", "x Go Reset B & C y"),
    ("<style>.gone, p.off{display:none} #one{visibility:hidden} /* b{display:none} */ @media print{i{display:none}} a .no{display:none}</style>"
     "<p class='x gone'>a</p><p class=off>b</p><div class=off>c</div><b id=one>d</b><i>e</i><u class=no>f</u>", "c\nef"),
    ("<style>div{display:none}</style><style>div{display:block}</style><div>a</div><div hidden>b</div>", "a\nb"),
    ("<style>td{visibility:hidden}</style><table><tr><td>a<th>b<tr><td>c<th>d</table>", " | b\n | d"),
    ("<table><tr style='visibility:collapse'><td>a<td style='visibility:visible'>b<tr><td>c<td>d</table>", "  | b\nc | d"),
    ("<table><tr><td>名前<td>x<tr><td>abc<td>y</table>", "名前 | x\nabc  | y"),
    ("a<b", "a"), ("a <p title='x", "a"), ("x<y and <b>z</b>", "xz"), ("1 <2 and 3< 4", "1 <2 and 3< 4"), ("a</b", "a"),
])
def test_visibility_rules_and_labels(html, text):
    assert visible_text(html, forms=True) == text


@pytest.mark.parametrize("part", ["<a", "x<y ", "<p ", '<p title="', "<p title='", "<a b='\"", "</p ", "<!-", "<style>", "<style>@", "<style>a{", "<style>;", "<p>", "<td>", "<li>", "a{", "&amp", "<!--"])
def test_time_is_linear(part):
    start = time.time()
    visible_text(part * 100_000)
    visible_text(part * 100_000 + "x='>'")
    assert time.time() - start < 20


def test_tables_of_any_depth_are_aligned():
    deep = visible_text("<table><tr><td>" * 500 + "<table><tr><td>a<td>b<tr><td>ccc<td>d</table>")
    assert deep == "a   | b\nccc | d"


def test_deep_and_long_pages():
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert len(visible_text("<p>" + "word " * 200_000)) == 5 * 200_000 - 1
    assert visible_text("<" * 20_000) == "<" * 20_000
    assert visible_text("<table><tr><td>" * 3000 + "x") == "x"


class Plain(HTMLParser):
    """Words outside script, style and title, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_given_pages_keep_their_words(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = extract(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        plain = Plain()
        plain.feed(html[r.page_id])
        plain.close()
        want = re.sub(r"\s+", "", "".join(plain.words))
        got = re.sub(r"(?m)^(\* )+|^\s*\d+\. ", "", r.text)
        assert re.sub(r"[\s|]+", "", got) == re.sub(r"[\s|]+", "", want), r.page_id


def test_nulls_repeats_and_empty_table(spark):
    pages = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "<p>a", None)], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract(pages).collect()) == [(0, "a"), (1, ""), (1, "")]
    assert extract(pages.limit(0)).count() == 0
    assert extract(pages, keep=("html", "page_id")).filter("page_id IS NULL").first().html == "<p>a"
