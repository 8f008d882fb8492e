from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions.common import let, running
from pagemill.operators.content import main_content
from pagemill.sources.nodes import node_table, parse_nodes, parse_page


def outline(html: str) -> str:
    """Tree as nested text: tag(children), 'text', !comment."""
    t = parse_page(html)

    def show(i: int) -> str:
        if t.tag[i] == "#text":
            return repr(t.text[i])
        if t.tag[i] == "#comment":
            return "!" + t.text[i]
        if t.tag[i] == "#instruction":
            return "?" + t.text[i]
        inner = [show(j) for j in range(i + 1, t.last[i] + 1) if t.parent[j] == i]
        return t.tag[i] + (f"({' '.join(inner)})" if inner else "")

    return show(0) if t.pre else ""


@pytest.mark.parametrize("html,want", [
    ("<html><head><title>t</title></head><body><p>a</body></html>", "html(head(title('t')) body(p('a')))"),
    ("<p><b>x<br><p>y</p>z", "html(body(p(b('x' br)) p('y') 'z'))"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "html(body(ul(li('a') li('b' ul(li('c'))) li('d'))))"),
    ("<table><tr><td>1<td>2<tr><th>3</table>e", "html(body(table(tr(td('1') td('2')) tr(th('3'))) 'e'))"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "html(body(dl(dt('a') dd('b') dt('c'))))"),
    ("<div>a</span></p>b</div>", "html(body(div('ab')))"),
    ("<div><span>a</div>b", "html(body(div(span('a')) 'b'))"),
    ("<table><tr><td><b>a</tr></table>", "html(body(table(tr(td(b('a'))))))"),
    ("<div><table><tr><td></div>x</td></table></div>", "html(body(div(table(tr(td('x'))))))"),
    ("<script>if (a<b) '</p>'</script>x", "html(head(script(\"if (a<b) '</p>'\")) body(p('x')))"),
    ("plain & text", "html(body(p('plain & text')))"),
    ("a &lt; &copy; &nbsp;b", "html(body(p('a < © \\xa0b')))"),
    ("&amp &copy=1 &#65 &#x42;&#1;&#150;&nope; &apos;&hellip;", "html(body(p(\"&amp &copy=1 A B\\x96&nope; '…\")))"),
    ("<body><!-- c --><p>1<!--x-->2</p>", "html(body(! c  p('1' !x '2')))"),
    ("<title>t<p>x", "html(head(title('t')) body(p('x')))"),
    ("<div/>t<img src=x>u", "html(body(div 't' img 'u'))"),
    ("<!DOCTYPE html>\n<html>\n<body>x</body></html>\n", "html(body('x\\n'))"),
    ("a < b <c", "html(body(p('a < b <c')))"),
    ("<p>one</p><body class=k>two", "html(body(p('one') 'two'))"),
    ("<select><option>a<option>b</select>", "html(body(select(option('a') option('b'))))"),
    ("<p>a<?php x?>b</p>", "html(body(p('a' ?php x? 'b')))"),
    ("", ""),
    # a quote opens a value right after "=" only
    ("<a href=\"/x\"\">one</a> mid <a href=\"/y\">two</a>", "html(body(a('one') ' mid ' a('two')))"),
    ("<p title=it's>Hello text</p> and don't stop", "html(body(p('Hello text') \" and don't stop\"))"),
    ("<p title=\"a>hello</p>", "html(body(p('hello')))"),
    ("<p \" x='>' y=\">\">z", "html(body(p('z')))"),
    ("<p a=b\"c>d\">e", "html(body(p('d\">e')))"),
    ("<p a = \"x > y\" b>z</p a='>'>w", "html(body(p('z') 'w'))"),
])
def test_tree(html, want):
    assert outline(html) == want


def test_attributes():
    t = parse_page("<a HREF='x&amp;y&sect=1' class=\"a > b\" disabled id=q data-x = '1' href=second>t</a>")
    assert dict(t.attrs[t.tag.index("a")]) == {"href": "x&y&sect=1", "class": "a > b", "disabled": "", "id": "q", "data-x": "1"}


def test_positions():
    t = parse_page("<div>a<p>b</p>c<p>d</p></div>")
    div = t.tag.index("div")
    children = [i for i in range(len(t.pre)) if t.parent[i] == div]
    assert [t.prev[i] for i in children] == [-1] + children[:-1]
    assert [t.nth[i] for i in children if t.tag[i] == "p"] == [1, 2]
    assert t.last[div] == len(t.pre) - 1
    for i in range(len(t.pre)):
        kids = [j for j in range(len(t.pre)) if t.parent[j] == i]
        assert t.kids[i] == len(kids) and t.child[i] == (kids[-1] if kids else -1)


def test_stray_quotes_and_attributes():
    t = parse_page("<a href=\"/x\"\" title=it's alt=\"un>b</a>")
    assert dict(t.attrs[t.tag.index("a")]) == {"href": "/x", "title": "it's", "alt": '"un'}


def test_deep_nesting_keeps_its_structure():
    t = parse_page("<div>" * 1000 + "<p>in</p>")
    p = t.tag.index("p")
    assert t.depth[p] == 1002 and t.depth[t.parent[p]] == 1001
    assert all(t.depth[i] == t.depth[t.parent[i]] + 1 and t.pre[i] <= t.last[t.parent[i]] for i in range(1, len(t.pre)))


def test_unclosed_tags_take_linear_time(spark):
    page = "<body>" + "".join(f"<i>{n}" for n in range(80_000))
    begin = time.perf_counter()
    t = parse_page(page)
    assert max(t.depth) == 80_002 and sum(len(x or "") for x in t.text) == len(page) - 6 - 3 * 80_000
    parse_page("<b><div>" + "<i>" * 40_000 + "</b>" * 40_000)
    parse_page("<i>" * 40_000 + "</u>" * 40_000 + "<meta>" * 40_000)
    parse_page("<!" * 100_000)
    assert time.perf_counter() - begin < 10


def test_deep_pages_through_main_content(spark):
    deep = "<html><body><div>" + "<div>" * 1000 + "<p>" + "some words of text " * 20 + "</p>"
    wide = "<html><body>" + "".join(f"<i>{n} " for n in range(20_000))
    pages = spark.createDataFrame([(1, deep), (2, wide)], "page_id long, html string")
    begin = time.perf_counter()
    found = {r.page_id: r.content for r in main_content(pages).collect()}
    assert found[1].startswith("some words of text") and time.perf_counter() - begin < 60


def test_running(spark):
    rnd = random.Random(1)
    for n in (0, 1, 63, 64, 65, 500):
        values = [rnd.randint(-5, 9) for _ in range(n)]
        table = spark.createDataFrame([(values,)], "v array<int>")
        sums, tops = table.select(running(F.col("v"), F.lit(0), lambda a, b: a + b),
                                  running(F.col("v"), F.lit(-9), lambda a, b: F.greatest(a, b))).first()
        assert sums == [sum(values[:i + 1]) for i in range(n)] and tops == [max(values[:i + 1]) for i in range(n)]


def test_odd_input_terminates():
    for html in ("<", "<<<a", "<a href='", "<!--", "<script>", "</", "<a b=\"c>d", "<?x", "\x00<p>\x01z"):
        parse_page(html)
    assert outline("\x00<p>\x01z") == "html(body(p('\\x01z')))"


def test_marks_of_rendering_are_ordinary_characters_of_pages(spark):
    body = "<html><body><div>" + "".join(f"<p>text {i} with \x01 \x02 \x03 \x04 \x040 marks</p>" for i in range(5)) + "</div>"
    pages = spark.createDataFrame([(1, body)], "page_id long, html string")
    assert main_content(pages).first().content == "\n".join(f"text {i} with \x01 \x02 \x03 \x04 \x040 marks" for i in range(5))


def test_some_columns_only(spark):
    pages = spark.createDataFrame([(1, "<p>a<b>c")], "page_id long, html string")
    assert [tuple(r) for r in node_table(pages, ["tag", "kids"]).collect()] == [
        (1, "html", 1), (1, "body", 1), (1, "p", 2), (1, "#text", 0), (1, "b", 1), (1, "#text", 0)]


def test_table_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (2, ""), (3, None)], "page_id long, html string")
    sizes = {r.page_id: r.n for r in parse_nodes(pages).select("page_id", F.size("nodes").alias("n")).collect()}
    assert sizes == {1: 4, 2: 0, 3: 0}
    rows = node_table(pages).orderBy("pre").select("page_id", "tag", "text").collect()
    assert [tuple(r) for r in rows] == [(1, "html", None), (1, "body", None), (1, "p", None), (1, "#text", "a")]


def test_let_evaluates_once(spark):
    rows = spark.range(1).select(let(F.rand(), lambda v: v - v).alias("d"))
    assert rows.first().d == 0.0
