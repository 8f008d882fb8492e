"""Title and main content: hand-written pages, and random pages against a tree that is really pruned."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.operators import content as c
from pagemill.sources.nodes import parse_page



# -- a naive model: text and tail on elements, nodes removed one by one --------------------------------

class El:
    def __init__(self, tag, attrs, pre):
        self.tag, self.attrs, self.pre, self.text, self.tail, self.kids, self.up = tag, attrs, pre, "", "", [], None

    def walk(self):
        for kid in self.kids:
            yield kid
            yield from kid.walk()

    def all_text(self):
        inner = "".join(("" if k.tag == "#comment" else k.all_text()) + k.tail for k in self.kids)
        return self.text + inner

    def remove(self):
        at = self.up.kids.index(self)
        if at:
            self.up.kids[at - 1].tail += self.tail
        else:
            self.up.text += self.tail
        del self.up.kids[at]


def tree(html):
    t = parse_page(html)
    made = {}
    for i in range(len(t.pre)):
        if t.tag[i] == "#text":
            if t.prev[i] >= 0:
                made[t.prev[i]].tail = t.text[i]
            else:
                made[t.parent[i]].text = t.text[i]
            continue
        made[i] = El(t.tag[i], dict(t.attrs[i]), i)
        if t.tag[i] == "#comment":
            made[i].text = t.text[i]
        if t.parent[i] >= 0:
            made[i].up = made[t.parent[i]]
            made[i].up.kids.append(made[i])
    return made.get(0)


def joined(el, *names, sep=" "):
    return sep.join(el.attrs.get(n, "") for n in names)


def weight(el):
    words = joined(el, "class", "id", "style")
    return (1 - 2 * len(re.findall(c.NEGATIVE_WORDS, words, re.I)) + 4 * len(re.findall(c.POSITIVE_WORDS, words, re.I))
            + 2 * (el.tag in c.HEAVY_TAGS))


def hidden(el):
    look = joined(el, "class", "id", "style", sep="")
    return (el.tag in ["#comment", "a", "textarea", *c.NON_CONTENT_TAGS]) or ("display" in look and "none" in look)


def breadth_first(body):
    level = list(body.kids)
    while level:
        yield from level
        level = [k for el in level for k in el.kids if not hidden(k)]


def own_score(el):
    """Length of the texts counted for an element, and its score; None when there is too little."""
    chars = sum((3 if k.tag == "p" else 1) * (len(k.text.strip()) + len(k.tail.strip()))
                for k in el.kids if not hidden(k))
    return chars * weight(el) if chars >= c.MIN_TEXT else None


def container(el):
    line = [el]
    while line[-1].up is not None:
        line.append(line[-1].up)
    if el.tag not in c.INNER_TAGS or len(line) == 1:
        return el
    above = line[1:6]
    return next((e for e in above if e.tag == "div"), above[-1])


def unwanted(el):
    def size(e):
        return len("".join(e.all_text().split()))

    links = [size(e) for e in el.walk() if e.tag == "a"]
    return (el.tag in ["#comment", *c.NON_CONTENT_TAGS] or bool(re.search(c.DROPPED_PARTS, joined(el, "class", "id")))
            or (bool(links) and sum(n for n in links if n > c.MIN_LINK_TEXT) > c.LINK_SHARE * size(el)))


def naive(html):
    """(pre of the block, its text), by taking the tree apart."""
    root = tree(html)
    bodies = [e for e in [root, *root.walk()] if e.tag == "body"] if root else []
    scored = [(own_score(el), el) for el in (breadth_first(bodies[0]) if bodies else [])]
    scored = [(score, -i, el) for i, (score, el) in enumerate(scored) if score is not None]
    if not scored:
        return None, ""
    block = container(max(scored, key=lambda s: s[:2])[2])
    order = list(block.walk())
    ends = [i for i, el in enumerate(order) if el.tag == "#comment" and re.search(c.STOP_COMMENT, el.text)]
    doomed = [el for i, el in enumerate(order) if (ends and i > ends[0]) or unwanted(el)]
    for el in doomed:
        el.remove()
    for el in block.walk():
        if el.tag in c.LINE_TAGS:
            el.tail = f"\n{el.tail.strip()}\n"
        elif el.tag in c.CELL_TAGS:
            el.text += "  "
    return block.pre, "\n".join(filter(None, (line.strip() for line in block.all_text().split("\n"))))


def run(spark, htmls):
    rows = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").repartition(8)
    parsed = c.parse_whole(rows)
    got = c.with_content(parsed).select("page_id", c.block_of(F.col("nodes"), F.col("whole")).alias("block"), "content").collect()
    return {r.page_id: (r.block, r.content) for r in got}


def page(body, head=""):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


LONG = "A sentence that is long enough to count as text. "


# -- hand-written pages ---------------------------------------------------------------------------------

@pytest.mark.parametrize("body,want", [
    # paragraphs beside a sidebar of links
    (f"<div id=main><p>{LONG}</p><p>{LONG}2</p></div><div class=sidebar><ul><li><a href=x>some other headline</a></ul></div>",
     f"{LONG.strip()}\n{LONG}2"),
    # the best node is a quote, its div is taken
    (f"<div><span>x</span><blockquote><p>{LONG}</p></blockquote>y</div>", f"x{LONG.strip()}\ny"),
    # text directly in a paragraph below the body belongs to no block
    (f"<p>{LONG}</p>", ""),
    # everything after the end mark goes, tails of parts begun before stay
    (f"<div><p>{LONG}</p><!-- 正文 到此 结束 --><p>{LONG}late</p>tail</div>", f"{LONG.strip()}\ntail"),
    # text behind a dropped node is kept
    (f"<div><p>{LONG}</p><span class=copyright>c</span>kept</div>", f"{LONG.strip()}\nkept"),
    # a hidden child is not counted but still rendered
    (f"<div><p>{LONG}</p><p style='display: none'>hidden words here</p></div>", f"{LONG.strip()}\nhidden words here"),
    # cells get two spaces
    (f"<div><p>{LONG}</p><table><tr><th>a</th><td>b<script>1</script>c</td></tr><tr><td>d</td></tr></table></div>",
     f"{LONG.strip()}\na  bc\nd"),
    ("", ""),
])
def test_blocks(spark, body, want):
    html = page(body)
    assert naive(html)[1] == want
    assert run(spark, [html])[0][1] == want


def test_negative_scores_can_win(spark):
    html = page(f"<div class='footer comment sidebar'><p>{LONG}</p></div>")
    assert run(spark, [html])[0][1] == LONG.strip()


def test_ties_go_to_the_shallower_block(spark):
    html = page("<div id=d><div id=e><i>0123456789</i></div></div><div id=f><i>0123456789</i></div>")
    block, _ = run(spark, [html])[0]
    assert block == naive(html)[0]
    t = parse_page(html)
    assert dict(t.attrs[block])["id"] == "f"


def test_fragments_without_a_body(spark):
    frag = f"<p>x</p><div><p>{LONG}</p></div>"
    single = f"<div><p>{LONG}</p></div>"
    headed = f"<title>t</title>{frag}"
    got = run(spark, [frag, single, headed, ""])
    assert [got[i][1] for i in range(4)] == ["", LONG.strip(), LONG.strip(), ""]


def title_of(spark, html):
    rows = spark.createDataFrame([(0, html)], "page_id long, html string")
    return c.main_content(rows).first().title


@pytest.mark.parametrize("head,body,want", [
    ("<title> A long title </title>", "", "A long title"),
    ("<title>A long title - site</title>", "", "A long title"),
    ("<title>short</title><meta name=title content='From the meta'>", "", "From the meta"),
    ("<title>short</title><meta name=title>", "", ""),
    ("<title>News</title>", "<h1 class=title>A headline here</h1>", "A headline here"),
    ("<title>News</title>", "<h1 id=x-title>New</h1><h2 class=title>Second headline</h2>", "New"),
    ("<title>News</title>", "<h1 class=title>Eight888</h1><b class=subtitle>Ninenine9</b>", "Ninenine9"),
    ("<title>News</title>", "<h1 class=title>A headline of far more than twenty characters</h1>", "News"),
    ("<title>News</title>", "<h1 class=font01>Old style head</h1>", "Old style head"),
    ("", "<p>x</p>", ""),
    ("", "<h1 class=title>ab</h1>", "ab"),
])
def test_titles(spark, head, body, want):
    assert title_of(spark, page(body, head)) == want


# -- random pages -----------------------------------------------------------------------------------------

TAGS = ["div", "p", "span", "b", "a", "ul", "li", "table", "tr", "td", "th", "h1", "h2", "blockquote", "pre", "code",
        "section", "dl", "dd", "select", "textarea", "script", "iframe"]
NAMES = ["content", "sidebar", "author", "main-text", "foot", "post-add", "copyright x", "zoom", "ad", "display none"]


def random_markup(rng, depth):
    out = []
    for _ in range(rng.randint(0, 4 if depth else 6)):
        kind = rng.random()
        if kind < 0.35:
            out.append(rng.choice(["", " ", "\n", "word ", "two words", LONG, " x\ny ", "long word sequence\n\n", "　全角 "]))
        elif kind < 0.42:
            out.append(rng.choice(["<br>", "<img src=x>", "<!-- c -->", "<!-- 相关阅读 -->", "<!---->", "<hr>"]))
        else:
            tag = rng.choice(TAGS)
            attr = f" class='{rng.choice(NAMES)}'" if rng.random() < 0.25 else ""
            attr += f" id={rng.choice(NAMES).split()[0]}" if rng.random() < 0.1 else ""
            attr += rng.choice([" style='display:none'", " style='color: red'"]) if rng.random() < 0.08 else ""
            inner = random_markup(rng, depth + 1) if depth < 6 else "leaf text"
            if tag == "script":
                inner = rng.choice(["", "code()", "a<b"])
            end = f"</{tag}>" if rng.random() < 0.9 or tag in ("script",) else ""
            out.append(f"<{tag}{attr}>{inner}{end}")
    return "".join(out)


def test_random_pages(spark):
    rng = random.Random(7)
    htmls = [page(random_markup(rng, 0)) for _ in range(600)]
    want = {i: naive(h) for i, h in enumerate(htmls)}
    got = run(spark, htmls)
    wrong = [i for i in want if want[i] != got[i]]
    assert not wrong, (len(wrong), htmls[wrong[0]], want[wrong[0]], got[wrong[0]])
    assert sum(bool(w[1]) for w in want.values()) > 200


def test_stored_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    htmls = [r.html for r in rows]
    got = run(spark, htmls)
    assert all(got[i] == naive(h) for i, h in enumerate(htmls))
