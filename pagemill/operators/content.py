"""Title and main content of a page.

Everything is computed inside the page's own row from its node array: scoring
and pruning look at parents, children and subtrees by array index, so the job
has no shuffle and a failed task only redoes its own pages.  Sums over
subtrees are differences of running sums and "inside a node of this kind" is a
running maximum, so the work grows with the nodes of a page, not their depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.common import let, running, squeeze_ws, strip
from pagemill.functions.text import clean_title
from pagemill.operators.fields import in_order, piece, subtree, text_content, texts_of
from pagemill.sources.nodes import COMMENT, INSTRUCTION, TEXT, is_element, parse_nodes

# Keywords in class, id and style that speak for or against a block, in matching order.
POSITIVE_WORDS = ("article|arti|body|content|entry|hentry|main|page|artical|zoom|arti|context|message|editor|"
                  "pagination|post|txt|text|blog|story")
NEGATIVE_WORDS = ("copyright|combx|comment|com-|contact|foot|footer|footnote|decl|copy|notice|masthead|media|meta|"
                  "outbrain|promo|related|scroll|link|pagebottom|bottom|other|shoutbox|sidebar|sponsor|shopping|"
                  "tags|tool|widget")
# Tags without content, tags that weigh more, tags too small to be a block, line-breaking tags.
NON_CONTENT_TAGS = ["head", "meta", "script", "style", "object", "embed", "iframe", "marquee", "select"]
HEAVY_TAGS = ["div", "p", "table"]
INNER_TAGS = ["p", "pre", "code", "blockquote"]
LINE_TAGS = ["div", "h1", "h2", "h3", "p", "br", "table", "tr", "dl"]
CELL_TAGS = ["th", "td"]
# End-of-text comments, and class or id of parts to drop.
STOP_COMMENT = "正文.*结束|正文下|相关阅读|声明"
DROPPED_PARTS = "author|post-add|copyright"

MIN_TITLE, LONG_TITLE = 7, 20
MIN_TEXT = 10
MIN_LINK_TEXT, LINK_SHARE = 5, 0.4
CLIMB = 5

# Marks used while rendering; the same characters in texts are written as _PLAIN and a digit meanwhile.
_EDGE, _CELL, _LINE, _PLAIN = "\x01", "\x02", "\x03", "\x04"


def _attr(x: Column, name: str) -> Column:
    return F.coalesce(x["attrs"][name], F.lit(""))


def _first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def inside(nodes: Column, flags: Column) -> Column:
    """Per node, whether it lies below a node that is flagged; both arrays are one run of nodes in document order."""
    ends = F.transform(nodes, lambda x, i: F.when(F.get(flags, i), x["last"]).otherwise(-1))
    return let(running(ends, F.lit(-1), lambda a, b: F.greatest(a, b)), lambda m: F.transform(
        nodes, lambda x, i: F.coalesce(F.get(m, i - 1) >= x["pre"], F.lit(False))))


def sums(values: Column) -> Column:
    """Running sums of integers, each with its own value in it."""
    return running(values, F.lit(0), lambda a, b: a + b)


def below(cumulated: Column, x: Column) -> Column:
    """Sum over what lies below a node, from running sums over all nodes of the page."""
    return F.get(cumulated, x["last"]) - F.get(cumulated, x["pre"])


def has_body(nodes: Column, whole: Column) -> Column:
    """Whether the page has a body to look at.

    A bare fragment (no doctype or <html>, no head) only counts as a body when
    it is a single element; several parts become an anonymous container.
    """
    def single(body: Column) -> Column:
        parts = F.filter(nodes, lambda x: (x["parent"] == body["pre"])
                         & ((x["tag"] != TEXT) | (strip(x["text"]) != "")))
        return let(parts, lambda p: F.coalesce((F.size(p) == 1) & (_first(p)["tag"] != TEXT), F.lit(False)))

    return let(_first(F.filter(nodes, lambda x: x["tag"] == "body")), lambda body: body.isNotNull() & (
        whole | F.exists(nodes, lambda x: x["tag"] == "head") | single(body)))


def page_title(nodes: Column) -> Column:
    """Title cascade: <title>, then meta, then nodes whose id or class names a title (G1)."""

    def named(word: str) -> Column:
        return F.filter(nodes, lambda x: is_element(x) & (
            _attr(x, "id").contains(word) | _attr(x, "class").contains(word)))

    def fold(title: Column) -> Column:
        spots = let(named("title"), lambda t: F.when(F.size(t) > 0, t).otherwise(named("font01")))
        found = let(spots, lambda t: F.transform(texts_of(nodes, t, lambda x: text_content(nodes, x), lambda t: t), strip))

        def step(state: Column, t: Column) -> Column:
            now = state["title"]
            within = now.contains(t) & (F.length(t) * 2 > F.length(now))
            better = (F.length(t) <= LONG_TITLE) & ((F.length(t) > F.length(now)) | (F.length(t) > MIN_TITLE))
            return (F.when(state["done"], state)
                    .when(within, F.struct(t.alias("title"), F.lit(True).alias("done")))
                    .when(better, F.struct(t.alias("title"), F.lit(False).alias("done")))
                    .otherwise(state))

        start = F.struct(title.alias("title"), F.lit(False).alias("done"))
        return F.aggregate(found, start, step, lambda s: s["title"])

    def from_meta(title: Column) -> Column:
        meta = _first(F.filter(nodes, lambda x: (x["tag"] == "meta") & (x["attrs"]["name"] == "title")))
        return F.when((F.length(title) < MIN_TITLE) & meta.isNotNull(), _attr(meta, "content")).otherwise(title)

    element = _first(F.filter(nodes, lambda x: x["tag"] == "title"))
    first = F.when(element.isNotNull(), strip(text_content(nodes, element))).otherwise("")
    return let(first, lambda a: let(from_meta(a), lambda b: F.when(F.length(b) < MIN_TITLE, fold(b)).otherwise(b)))


def node_weight(x: Column) -> Column:
    """1, minus 2 per negative and plus 4 per positive keyword, plus 2 for block tags."""
    words = F.concat_ws(" ", _attr(x, "class"), _attr(x, "id"), _attr(x, "style"))
    return (F.lit(1) - 2 * F.regexp_count(words, F.lit(f"(?iu){NEGATIVE_WORDS}"))
            + 4 * F.regexp_count(words, F.lit(f"(?iu){POSITIVE_WORDS}"))
            + F.when(x["tag"].isin(HEAVY_TAGS), 2).otherwise(0))


def is_blocked(x: Column) -> Column:
    """Children that are not visited, with all below them and the text after them."""
    look = F.concat(_attr(x, "class"), _attr(x, "id"), _attr(x, "style"))
    return (x["tag"] != TEXT) & (x["tag"].isin(COMMENT, INSTRUCTION, "a", "textarea", *NON_CONTENT_TAGS)
                                 | ((F.size(x["attrs"]) > 0) & look.contains("display") & look.contains("none")))


def block_scores(nodes: Column, whole: Column) -> Column:
    """array<struct(pre, depth, text_len, score)> of the candidate blocks.

    Each text counts once: directly inside a child it belongs to the child's
    parent, behind a child it belongs to that child's parent as well.
    """

    def lengths(blocked: Column) -> Column:
        """Per element or comment: the text it starts with and the text behind it, 0 where it is blocked."""
        def length(text: Column, mine: Column) -> Column:
            return F.when((text["tag"] == TEXT) & mine, F.length(strip(text["text"]))).otherwise(0)

        def own(x: Column) -> Column:
            first, behind = F.get(nodes, x["pre"] + 1), F.get(nodes, x["last"] + 1)
            both = (length(first, (first["parent"] == x["pre"]) & (first["prev"] < 0))
                    + length(behind, behind["prev"] == x["pre"]))
            times = F.when(x["tag"] == "p", 3).otherwise(1)
            return F.when((x["tag"] == TEXT) | F.get(blocked, x["pre"]), 0).otherwise(both * times)

        return F.transform(nodes, own)

    def of_children(x: Column, length: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            return F.struct(F.get(nodes, state["at"])["prev"].alias("at"),
                            (state["chars"] + F.get(length, state["at"])).alias("chars"))
        start = F.struct(x["child"].alias("at"), F.lit(0).alias("chars"))
        return F.aggregate(F.sequence(F.lit(1), x["kids"]), start, step, lambda s: s["chars"])

    def scores(body: Column, blocked: Column, length: Column) -> Column:
        under = body["depth"] + 2  # from here on a blocked node hides its subtree

        def visited(hidden: Column) -> Column:
            return F.filter(nodes, lambda x: (
                (x["pre"] > body["pre"]) & (x["pre"] <= body["last"]) & (x["last"] > x["pre"])
                & ((x["depth"] < under) | ~F.get(blocked, x["pre"])) & ~F.get(hidden, x["pre"])))

        def score(x: Column) -> Column:
            return F.struct(x["pre"].alias("pre"), x["depth"].alias("depth"), of_children(x, length).alias("text_len"),
                            node_weight(x).alias("weight"))

        hiding = F.transform(nodes, lambda x, i: F.get(blocked, i) & (x["depth"] >= under))
        scored = let(let(hiding, lambda h: inside(nodes, h)), lambda hidden: F.filter(
            F.transform(visited(hidden), score), lambda s: s["text_len"] >= MIN_TEXT))
        return F.transform(scored, lambda s: F.struct(
            s["pre"], s["depth"], s["text_len"], (s["text_len"] * s["weight"]).alias("score")))

    body = _first(F.filter(nodes, lambda x: x["tag"] == "body"))
    found = let(body, lambda b: let(F.transform(nodes, is_blocked), lambda k: let(
        lengths(k), lambda n: scores(b, k, n))))
    return F.when(has_body(nodes, whole), found)


def best_block(scores: Column) -> Column:
    """pre of the highest score; ties go to the first in breadth-first order."""
    ranked = F.transform(scores, lambda s: F.struct(
        s["score"].alias("score"), (-s["depth"]).alias("up"), (-s["pre"]).alias("front")))
    return -F.array_max(ranked)["front"]


def climb(nodes: Column, pre: Column) -> Column:
    """From a paragraph-like block up to the nearest div, at most five parents."""
    node = F.get(nodes, pre)
    chain, at = [], node
    for _ in range(CLIMB):
        chain.append(at["parent"])
        at = F.get(nodes, at["parent"])

    def up(parents: Column) -> Column:
        div = _first(F.filter(parents, lambda a: F.get(nodes, a)["tag"] == "div"))
        return F.when(node["tag"].isin(INNER_TAGS) & (F.size(parents) > 0),
                      F.coalesce(div, F.element_at(parents, -1))).otherwise(pre)

    return let(F.filter(F.array(*chain), lambda a: a >= 0), up)


def link_shares(nodes: Column, top: Column) -> Column:
    """Per node of the subtree of ``top``, aligned with ``nodes``: text and link text without whitespace.

    struct(text, links), NULL where the node has no link below it; no array at
    all when the subtree has no link.  Every link longer than the minimum
    counts, nested ones again.
    """
    def within(x: Column) -> Column:
        return (x["pre"] > top["pre"]) & (x["pre"] <= top["last"])

    def lengths() -> Column:
        return F.transform(nodes, lambda x: F.when(
            (x["tag"] == TEXT) & within(x), F.length(squeeze_ws(x["text"]))).otherwise(0))

    def links(length: Column) -> Column:
        return F.transform(nodes, lambda x: F.when((x["tag"] == "a") & within(x), let(
            below(length, x), lambda n: F.when(n > MIN_LINK_TEXT, n).otherwise(0))).otherwise(0))

    def shares(anchors: Column, length: Column, link: Column) -> Column:
        return F.transform(nodes, lambda x: F.when(
            is_element(x) & (within(x) | (x["pre"] == top["pre"])) & (below(anchors, x) > 0),
            F.struct(below(length, x).alias("text"), below(link, x).alias("links"))))

    some = F.exists(subtree(nodes, top), lambda x: x["tag"] == "a")
    none = F.lit(None).cast("array<struct<text:int,links:int>>")
    anchors = sums(F.transform(nodes, lambda x: (x["tag"] == "a").cast("int")))
    return F.when(some, let(anchors, lambda a: let(sums(lengths()), lambda n: let(
        sums(links(n)), lambda k: shares(a, n, k))))).otherwise(none)


def pruned(nodes: Column, block: Column) -> Column:
    """Boolean array over the block's subtree, block first: dropped, itself or by an ancestor.

    Text behind a dropped node is a sibling, so it stays.
    """

    def flagged(stop: Column, share: Column) -> Column:
        def flag(x: Column) -> Column:
            part = F.concat_ws(" ", _attr(x, "class"), _attr(x, "id"))
            density = F.get(share, x["pre"])
            linked = F.coalesce(density["links"] > density["text"] * F.lit(LINK_SHARE), F.lit(False))
            return ((x["tag"] != TEXT) & (x["pre"] > block["pre"])
                    & (x["tag"].isin(COMMENT, INSTRUCTION, *NON_CONTENT_TAGS) | (x["pre"] > F.coalesce(stop, x["pre"]))
                       | ((F.size(x["attrs"]) > 0) & part.rlike(DROPPED_PARTS)) | linked))
        return F.transform(subtree(nodes, block), flag)

    def spread(flags: Column) -> Column:
        return F.when(F.exists(flags, lambda f: f), let(inside(subtree(nodes, block), flags), lambda under: F.zip_with(
            flags, under, lambda f, u: f | u))).otherwise(flags)

    stop = _first(F.filter(subtree(nodes, block), lambda x: (x["tag"] == COMMENT)
                           & x["text"].rlike(f"(?d){STOP_COMMENT}")))["pre"]
    return let(link_shares(nodes, block), lambda s: let(let(stop, lambda p: flagged(p, s)), spread))


def render(nodes: Column, block: Column, dropped: Column) -> Column:
    """Text of what is left of the block, one line per line-breaking part.

    Text behind an element runs up to the next remaining element or end tag,
    across dropped nodes.  Edges of remaining elements are marked first, then
    the marked runs get their line breaks or cell gap.
    """
    def opening(x: Column) -> Column:
        plain = x["text"]
        for i, mark in enumerate((_PLAIN, _EDGE, _CELL, _LINE)):
            plain = F.replace(plain, F.lit(mark), F.lit(f"{_PLAIN}{i}"))
        return F.when(x["tag"] == TEXT, plain).when(x["tag"].isin(CELL_TAGS), _EDGE + _CELL).otherwise(_EDGE)

    def ending(x: Column) -> Column:
        return F.when(x["tag"].isin(LINE_TAGS), _EDGE + "\n" + _LINE).otherwise(_EDGE)

    def trimmed(marked: Column) -> Column:
        gaps = F.regexp_replace(marked, f"{_CELL}([^{_EDGE}]*)", "$1  ")
        lines = F.regexp_replace(gaps, f"{_LINE}([^{_EDGE}]*)", "$1\n")
        plain = F.replace(lines, F.lit(_EDGE), F.lit(""))
        for i, mark in reversed(list(enumerate((_PLAIN, _EDGE, _CELL, _LINE)))):
            plain = F.replace(plain, F.lit(f"{_PLAIN}{i}"), F.lit(mark))
        return F.array_join(F.filter(F.transform(F.split(plain, "\n"), strip), lambda t: t != ""), "\n")

    rest = F.filter(F.slice(nodes, block["pre"] + 2, block["last"] - block["pre"]),
                    lambda x: ~F.get(dropped, x["pre"] - block["pre"]))
    return let(rest, lambda r: trimmed(in_order(
        F.transform(r, lambda x: piece(x["pre"], x, opening(x))),
        F.transform(F.filter(r, lambda x: x["tag"] != TEXT), lambda x: piece(x["last"], x, ending(x), end=True)))))


def parse_whole(pages: DataFrame) -> DataFrame:
    """Nodes of each page, with ``whole`` telling documents from fragments."""
    return parse_nodes(pages.withColumn("whole", F.col("html").rlike(r"(?is)^\s*<(?:html|!doctype)")))


def block_of(nodes: Column, whole: Column) -> Column:
    """pre of the container the content is taken from, NULL when there is none."""
    return let(best_block(block_scores(nodes, whole)), lambda pre: climb(nodes, pre))


def _step(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later steps use in many places; a projection could be written into each of them."""
    return rows.withColumn(name, F.explode(F.array(value)))


def with_content(parsed: DataFrame) -> DataFrame:
    """``parsed`` (nodes, whole, …) with ``content``: the text of its best block, '' without one."""
    nodes = F.col("nodes")
    block = F.get(nodes, F.col("block"))
    rows = _step(parsed, "block", block_of(nodes, F.col("whole")))
    rows = _step(rows, "dropped", F.when(F.col("block").isNotNull(), let(block, lambda b: pruned(nodes, b))))
    text = F.when(F.col("block").isNotNull(), let(block, lambda b: render(nodes, b, F.col("dropped")))).otherwise("")
    return rows.select(*parsed.columns, text.alias("content"))


def main_content(pages: DataFrame) -> DataFrame:
    """(page_id, title, content) of every page; content is '' where no block is found."""
    rows = with_content(parse_whole(pages.select("page_id", "html")))
    return rows.select("page_id", let(page_title(F.col("nodes")), clean_title).alias("title"), "content")
