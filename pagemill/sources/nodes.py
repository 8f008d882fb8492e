"""Pages as node tables.

Spark ships no HTML parser, so one small executor-side helper turns a page into
an array of nodes; everything after that is Spark expressions.  The array is
indexed by ``pre`` (document order): parents, children and subtrees are found
by index, and a node lies inside another exactly when its ``pre`` is in
(pre, last], so selection and scoring stay inside the page's own row and need
no shuffle.  A node takes a fixed number of entries however deep it lies.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.entities import name2codepoint
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.common import let, running

# Executors need not have this package installed: the parser travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT = "#text"
COMMENT = "#comment"
INSTRUCTION = "#instruction"

NODE_TYPE = T.StructType([
    T.StructField("pre", T.IntegerType()),      # document order, also the array index
    T.StructField("last", T.IntegerType()),     # pre of the last descendant (pre itself for leaves)
    T.StructField("parent", T.IntegerType()),   # -1 at the root
    T.StructField("prev", T.IntegerType()),     # previous sibling, -1 for the first child
    T.StructField("depth", T.IntegerType()),
    T.StructField("nth", T.IntegerType()),      # position among siblings of the same tag
    T.StructField("child", T.IntegerType()),    # last child, -1 without children
    T.StructField("kids", T.IntegerType()),     # number of children
    T.StructField("tag", T.StringType()),       # element name, #text, #comment or #instruction
    T.StructField("text", T.StringType()),      # content of the nodes that are no elements
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])

# HTML element classes.
VOID = frozenset("area base basefont br col embed frame hr img input isindex link meta param source wbr".split())
RAW_TEXT = frozenset(["script", "style"])
HEAD_ONLY = frozenset("base link meta script style title".split())
FONT = frozenset("b big i s small strike tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address blockquote caption center dd dir div dl dt fieldset form hr li menu ol p pre table "
    "tbody td tfoot th thead tr ul".split()) | HEADINGS
CELLS = frozenset(["td", "th"])
ROW_GROUPS = frozenset(["thead", "tbody", "tfoot"])
# An end tag does not reach past an open element of a higher level.
END_LEVEL = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5,
             "head": 6, "body": 6, "html": 7}

# A quote opens a value right after "=" only, and only if it is closed again; elsewhere it is a character like others.
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
_NAME = r"[^\s/>][^\s/>=]*+"
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<\?(?P<instruction>[^>]*)>"
    r"|<![^>]*>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)>",
    re.S)
_ATTR = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+")
_ODD_NAME = re.compile("[\"'<]")
_EMPTY_TAG = re.compile(r"(?:^|[\s\"'])/$")
_OPEN_COMMENT = re.compile(r"<!--(?P<comment>.*)", re.S)
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW_TEXT}


def _closed_by(open_tag: str, new_tag: str) -> bool:
    """Whether a start tag implies the end of the innermost open element."""
    if open_tag in ("p", "title"):
        return new_tag in CLOSES_P
    if open_tag in FONT:
        return new_tag in ("p", "center", "td", "th")
    if open_tag in HEADINGS:
        return new_tag in ("p", "li", "table", "form", "fieldset")
    if open_tag == "a":
        return new_tag in ("a", "table", "td", "th")
    if open_tag in CELLS:
        return new_tag in CELLS or new_tag == "tr" or new_tag in ROW_GROUPS
    if open_tag == "tr" or open_tag in ROW_GROUPS:
        return new_tag in ROW_GROUPS or new_tag == open_tag
    if open_tag in ("dt", "dd"):
        return new_tag in ("dt", "dd")
    return open_tag == new_tag and open_tag in ("li", "option")


# Named references need their semicolon ("?a=1&copy=2" is no copyright sign), numeric ones do not.
_REFERENCE = re.compile(r"&(?:#[xX](?P<hex>[0-9a-fA-F]+);?|#(?P<dec>[0-9]+);?|(?P<name>[a-zA-Z][a-zA-Z0-9]*);)")
_NAMED = {**name2codepoint, "apos": 39}


def _character(reference: re.Match) -> str:
    if name := reference["name"]:
        return chr(_NAMED[name]) if name in _NAMED else reference[0]
    code = int(reference["hex"], 16) if reference["hex"] else int(reference["dec"])
    text = code in (9, 10, 13) or 32 <= code < 0xD800 or 0xE000 <= code < 0xFFFE or 0x10000 <= code < 0x110000
    return chr(code) if text else ""


def unescape(text: str) -> str:
    return _REFERENCE.sub(_character, text) if "&" in text else text


class _PageTree:
    """Nodes of one page in columns, built left to right with a stack."""

    def __init__(self) -> None:
        self.pre, self.last, self.parent, self.prev, self.depth, self.nth = [], [], [], [], [], []
        self.child, self.kids = [], []
        self.tag, self.text, self.attrs = [], [], []
        self.open: list[int] = []
        self.counts: list[dict] = []      # children per tag of each open node
        self.places: dict[str, list[int]] = {}                # where on the stack each tag is open
        self.barriers: list[list[int]] = [[] for _ in range(max(END_LEVEL.values()) + 1)]  # the same by level
        self.has_head = self.has_body = False

    def add(self, tag: str, text: str | None = None, attrs: dict | None = None) -> int:
        pre = len(self.pre)
        self.pre.append(pre)
        self.last.append(pre)
        self.child.append(-1)
        self.kids.append(0)
        self.tag.append(tag)
        self.text.append(text)
        self.attrs.append(list(attrs.items()) if attrs else [])
        self.depth.append(len(self.open))
        if self.open:
            parent = self.open[-1]
            self.parent.append(parent)
            self.prev.append(self.child[parent])
            self.child[parent] = pre
            self.kids[parent] += 1
            nth = self.counts[-1].get(tag, 0) + 1
            self.counts[-1][tag] = nth
        else:
            self.parent.append(-1)
            self.prev.append(-1)
            nth = 1
        self.nth.append(nth)
        return pre

    def push(self, tag: str, attrs: dict | None = None) -> None:
        self.has_head = self.has_head or (tag == "head" and len(self.open) == 1)
        place = len(self.open)
        self.places.setdefault(tag, []).append(place)
        if tag in END_LEVEL:
            self.barriers[END_LEVEL[tag]].append(place)
        self.open.append(self.add(tag, attrs=attrs))
        self.counts.append({})

    def pop(self) -> None:
        pre = self.open.pop()
        self.last[pre] = len(self.pre) - 1
        self.counts.pop()
        self.places[self.tag[pre]].pop()
        if self.tag[pre] in END_LEVEL:
            self.barriers[END_LEVEL[self.tag[pre]]].pop()

    def top(self) -> str | None:
        return self.tag[self.open[-1]] if self.open else None

    def imply(self, tag: str) -> None:
        """Open the html / head / body a start tag or text needs."""
        if not self.open and tag != "html":
            self.push("html")
        if tag in ("html", "head", "body", "frameset") or self.has_body:
            return
        if tag in HEAD_ONLY:
            if self.top() == "html" and not self.has_head:
                self.push("head")
            return
        if any(self.tag[i] not in ("html", "head") for i in self.open):
            return
        while len(self.open) > 1:
            self.pop()
        self.push("body")
        self.has_body = True

    def start(self, tag: str, attrs: dict, empty: bool) -> None:
        if tag in ("html", "body") and (self.has_body if tag == "body" else bool(self.open)):
            target = self.tag.index(tag)
            known = dict(self.attrs[target])
            self.attrs[target] = list({**attrs, **known}.items())
            return
        while self.open and _closed_by(self.top(), tag):
            self.pop()
        self.imply(tag)
        if tag == "body":
            while len(self.open) > 1:
                self.pop()
            self.has_body = True
        if empty or tag in VOID:
            self.add(tag, attrs=attrs)
        else:
            self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return  # what follows still belongs to the body
        at = (self.places.get(tag) or [-1])[-1]
        if at > max((b[-1] for b in self.barriers[END_LEVEL.get(tag, 0) + 1:] if b), default=-1):
            while len(self.open) > at:
                self.pop()

    def characters(self, text: str) -> None:
        if not text:
            return
        if self.top() in (None, "html", "head"):
            if text.isspace():
                return
            self.imply("p")
            if self.top() != "p":
                self.push("p")
        before = self.child[self.open[-1]] if self.open else -1
        if before >= 0 and self.tag[before] == TEXT:
            self.text[before] += text
        else:
            self.add(TEXT, text)

    def aside(self, kind: str, text: str) -> None:
        if self.open:  # what stands before the root is not part of the tree
            self.add(kind, text)


def parse_page(html: str) -> _PageTree:
    """Tolerant tree building: implied ends, stray end tags and raw text handled."""
    tree, at = _PageTree(), 0
    html = html.replace("\0", "")  # parsers of HTML drop this character and no other
    size, last_end = len(html), html.rfind(">")
    while at < size:
        token = _TOKEN.search(html, at) if at <= last_end else _OPEN_COMMENT.search(html, at)
        if token is None:
            tree.characters(unescape(html[at:]))
            break
        if token.start() > at:
            tree.characters(unescape(html[at:token.start()]))
        if at > last_end:
            tree.aside(COMMENT, token["comment"])
            break
        at = token.end()
        tag = token["tag"]
        if tag is None:
            for kind, name in ((COMMENT, "comment"), (INSTRUCTION, "instruction")):
                if token[name] is not None:
                    tree.aside(kind, token[name])
            continue
        tag = tag.lower()
        if token["end"]:
            tree.end(tag)
            continue
        attrs: dict[str, str] = {}
        for name, value in _ATTR.findall(token["attrs"]):
            if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0]:
                value = value[1:-1]
            if not _ODD_NAME.search(name):
                attrs.setdefault(name.lower(), unescape(value))
        empty = _EMPTY_TAG.search(token["attrs"]) is not None
        tree.start(tag, attrs, empty)
        if tag in RAW_TEXT and not empty:
            stop = _RAW_END[tag].search(html, at)
            end = stop.start() if stop else size
            if end > at:
                tree.characters(html[at:end])
            at = end
    while tree.open:
        tree.pop()
    return tree


_ROWS_PER_BATCH = 64       # pages per Arrow batch handed back,
_CHARS_PER_BATCH = 1 << 23  # or fewer when the pages are long


def _offsets(lengths: Iterable[int]) -> pa.Array:
    return pa.array(np.cumsum([0, *lengths], dtype=np.int64).astype(np.int32))


def _node_arrays(trees: list[_PageTree], names: Sequence[str]) -> pa.ListArray:
    """The trees' columns as one Arrow list of structs, built flat."""
    def column(name: str) -> pa.Array:
        values = list(chain.from_iterable(getattr(t, name) for t in trees))
        if name in ("tag", "text"):
            return pa.array(values, pa.string())
        if name != "attrs":
            return pa.array(np.array(values, np.int32))
        pairs = list(chain.from_iterable(values))
        return pa.MapArray.from_arrays(_offsets(map(len, values)), pa.array([k for k, _ in pairs], pa.string()),
                                       pa.array([v for _, v in pairs], pa.string()))

    nodes = pa.StructArray.from_arrays([column(n) for n in names], list(names))
    return pa.ListArray.from_arrays(_offsets(len(t.pre) for t in trees), nodes)


def _parser(names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "html"]
            html = batch.column("html")
            start, trees, chars = 0, [], 0
            for i in range(batch.num_rows):
                source = html[i].as_py() or ""
                trees.append(parse_page(source))
                chars += len(source)
                if len(trees) == _ROWS_PER_BATCH or chars > _CHARS_PER_BATCH or i + 1 == batch.num_rows:
                    passed = [batch.column(n).slice(start, len(trees)) for n in rest]
                    yield pa.RecordBatch.from_arrays(passed + [_node_arrays(trees, names)], rest + ["nodes"])
                    start, trees, chars = i + 1, [], 0
    return parse


#: Session setting: number of partitions that pages are parsed in; unset, they are parsed where they are read.
PARSE_PARTITIONS = "pagemill.parse.partitions"


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Pages in ``parts`` partitions, or as many as the session's ``PARSE_PARTITIONS`` says; as they are without either.

    Worth its shuffle where a table has fewer files than the cluster has cores,
    which the caller knows. Batches of a stream stay as they come.
    """
    parts = parts or int(df.sparkSession.conf.get(PARSE_PARTITIONS, "0"))
    if not parts or df.isStreaming:
        return df
    keys = [c for c in df.columns if c != "html"]
    return df.repartition(parts, *(keys or ["html"]))


def _node_type(fields: Sequence[str] | None) -> T.StructType:
    return NODE_TYPE if fields is None else T.StructType([NODE_TYPE[f] for f in fields])


def parse_nodes(pages: DataFrame, fields: Sequence[str] | None = None, parts: int | None = None) -> DataFrame:
    """Replace ``html`` by ``nodes``; project and filter pages before calling this.

    ``fields`` names the node columns to hand over, where not all are wanted;
    ``parts`` redistributes the pages first (see ``spread``).
    """
    kept = [f for f in pages.schema.fields if f.name != "html"]
    kind = _node_type(fields)
    schema = T.StructType(kept + [T.StructField("nodes", T.ArrayType(kind))])
    return spread(pages, parts).mapInArrow(_parser(kind.names), schema)


def node_table(pages: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per node, with the page's other columns."""
    parsed = parse_nodes(pages, fields)
    keep = [c for c in parsed.columns if c != "nodes"]
    return parsed.select(*keep, F.inline("nodes"))


def structural_pairs(outer: Column, inner: Column) -> Column:
    """The pairs of two node arrays of a page in which one node lies inside the other: array<struct(outer, inner)> (H5).

    Both arrays are in document order. One pass over the places where outer
    nodes begin and end and where inner ones lie counts, for each outer node, the
    inner ones up to its begin and its end; what is between them is a slice.
    """
    def events(o: Column, i: Column) -> Column:
        mark = lambda at, kind, who, end: F.struct(at.alias("at"), F.lit(kind).alias("kind"), who.alias("who"), F.lit(end).alias("end"))
        return F.sort_array(F.concat(F.transform(i, lambda x: mark(x["pre"], 0, F.lit(-1), 0)),
                                     F.transform(o, lambda x, k: mark(x["pre"], 1, k, 0)), F.transform(o, lambda x, k: mark(x["last"], 1, k, 1))))

    def counted(marks: Column) -> Column:
        counts = running(F.transform(marks, lambda m: 1 - m["kind"]), F.lit(0), lambda x, y: x + y)
        found = let(counts, lambda c: F.transform(marks, lambda m, k: F.when(m["kind"] == 1, F.struct(m["who"], m["end"], F.get(c, k).alias("n")))))
        return F.transform(F.sort_array(F.filter(found, lambda f: f.isNotNull())), lambda f: f["n"])

    def pairs(both: Column) -> Column:
        o, i = both["outer"], both["inner"]
        return let(let(events(o, i), counted), lambda n: F.flatten(F.transform(o, lambda x, k: F.transform(
            F.slice(i, F.get(n, 2 * k) + 1, F.get(n, 2 * k + 1) - F.get(n, 2 * k)), lambda y: F.struct(x.alias("outer"), y.alias("inner"))))))

    return let(F.struct(outer.alias("outer"), inner.alias("inner")), pairs)


def contained(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Nodes with each node of ``outer`` (page_id, pre, last, ...) that encloses them (H5).

    The rows of a page meet as two arrays, so nothing is made beyond the result
    however few nodes are asked for. Where both come from one table of parsed
    pages, ``structural_pairs`` on its arrays does without the shuffle.
    """
    def gathered(rows: DataFrame, name: str) -> DataFrame:
        rest = F.struct(*(c for c in rows.columns if c != "page_id"))
        in_order = lambda a, b: F.when(a["pre"] < b["pre"], -1).when(a["pre"] > b["pre"], 1).otherwise(0)
        return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(rest), in_order).alias(name))

    both = gathered(nodes, "_inner").join(gathered(outer.where("last > pre"), "_outer"), "page_id")
    found = both.select("page_id", F.explode(structural_pairs(F.col("_outer"), F.col("_inner"))).alias("p"))
    return found.select("page_id", "p.inner.*", *(F.col(f"p.outer.{c}").alias(f"outer_{c}") for c in outer.columns if c != "page_id"))


class _PageNodes:
    """Row source for SQL: the nodes of whole columns of pages, one array per page, built flat."""

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        ids = pages.column("page_id").cast(pa.int64())
        start, trees, chars = 0, [], 0
        for i, source in enumerate(pages.column("html").to_pylist()):
            trees.append(parse_page(source or ""))
            chars += len(source or "")
            if len(trees) == _ROWS_PER_BATCH or chars > _CHARS_PER_BATCH or i + 1 == pages.num_rows:
                yield pa.table({"page_id": ids.slice(start, len(trees)), "nodes": _node_arrays(trees, NODE_TYPE.names)})
                start, trees, chars = i + 1, [], 0


def register_sql(spark: SparkSession, name: str = "page_nodes") -> None:
    """Table function for SQL (M6u): ``SELECT page_id, inline(nodes) FROM page_nodes(TABLE(SELECT page_id, html FROM pages))``.

    Arrow batches go in and out, each task over its own rows.
    """
    kind = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("nodes", T.ArrayType(NODE_TYPE))])
    spark.udtf.register(name, F.arrow_udtf(_PageNodes, returnType=kind))


def is_element(node: Column) -> Column:
    return ~node["tag"].isin(TEXT, COMMENT, INSTRUCTION)
