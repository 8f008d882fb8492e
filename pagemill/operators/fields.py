"""Field extraction: attribute, text, pair and markup of selected nodes.

Two families differ in their rules for nothing found and for text:
``soup`` fields default to many values and treat an empty default as none,
``tree`` fields default to one value and fail only when the default is None.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.common import let, not_empty, running, squeeze_ws, strip
from pagemill.operators.select import Selector, select
from pagemill.sources.nodes import COMMENT, INSTRUCTION, TEXT, VOID, is_element


def subtree(nodes: Column, node: Column) -> Column:
    """The node and everything below it, in document order."""
    return F.slice(nodes, node["pre"] + 1, node["last"] - node["pre"] + 1)


def texts(nodes: Column, node: Column) -> Column:
    """Text pieces of the subtree in document order."""
    return F.transform(F.filter(subtree(nodes, node), lambda x: x["tag"] == TEXT), lambda x: x["text"])


def text_content(nodes: Column, node: Column) -> Column:
    return F.array_join(texts(nodes, node), "")


def _stripped(nodes: Column, node: Column) -> Column:
    return F.filter(F.transform(texts(nodes, node), strip), lambda t: t != "")


def text_compact(nodes: Column, node: Column, separator: str | None = None) -> Column:
    """Stripped pieces joined, then all whitespace removed; NULL when empty."""
    return not_empty(squeeze_ws(F.array_join(_stripped(nodes, node), separator or "")))


def text_strip(nodes: Column, node: Column) -> Column:
    """Stripped pieces joined, inner whitespace kept; NULL when empty."""
    return not_empty(F.array_join(_stripped(nodes, node), ""))


def nested(found: Column) -> Column:
    """Whether one of the nodes, in document order, lies in another: then one lies in the node before it."""
    return F.size(F.filter(found, lambda x, i: (i > 0) & (x["pre"] <= F.get(found, i - 1)["last"]))) > 0


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _cut(whole: Column, start: Column, length: Column) -> Column:
    """A part of encoded text by its place in bytes, which costs what it returns."""
    return F.decode(F.substring(whole, start + 1, length), "UTF-8")


def _sum_before(sums: Column, place: Column) -> Column:
    return F.coalesce(F.get(sums, place - 1), F.lit(0))


def texts_of(nodes: Column, found: Column, one: Callable[[Column], Column], piece: Callable[[Column], Column],
             separator: str | Column = "") -> Column:
    """The text of each node found: the pieces of its texts that aren't empty, joined.

    Nodes beside each other are joined one by one (``one``). Where some lie in
    others, the page's pieces are joined once, with running offsets, and each
    node's text is a part of that.
    """
    gap = F.lit(separator) if isinstance(separator, str) else separator

    def joined(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda t: F.octet_length(t)), F.lit(0), lambda a, b: a + b)
        return let(F.struct(_bytes(F.array_join(pieces, "")).alias("whole"), ends.alias("ends")), parts)

    def parts(page: Column) -> Column:
        def part(x: Column) -> Column:
            start = _sum_before(page["ends"], x["pre"])
            length = F.get(page["ends"], x["last"]) - start
            return F.when(length == 0, "").otherwise(_cut(page["whole"], start, length - F.octet_length(gap)))

        return F.transform(found, part)

    def with_gap(x: Column) -> Column:
        return let(F.when(x["tag"] == TEXT, piece(x["text"])).otherwise(""), lambda t: F.when(t == "", "").otherwise(F.concat(t, gap)))

    return F.when(nested(found), let(F.transform(nodes, with_gap), joined)).otherwise(F.transform(found, one))


def _escape(col: Column, quote: bool = False) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"),) if quote else ()):
        col = F.replace(col, F.lit(char), F.lit(name))
    return col


def piece(at: Column, x: Column, text: Column, end: bool = False) -> Column:
    """A piece of output at a place of the page; end tags follow what stands there, innermost first."""
    inner = -x["pre"] if end else F.lit(0)
    return F.struct(at.alias("at"), F.lit(int(end)).alias("end"), inner.alias("inner"), text.alias("text"))


def in_order(*pieces: Column) -> Column:
    """The pieces' texts in order of their places, joined."""
    return F.array_join(F.transform(F.sort_array(F.concat(*pieces)), lambda p: p["text"]), "")


def _start_tag(x: Column, end: str | Column) -> Column:
    attrs = F.array_join(F.transform(F.map_entries(x["attrs"]), lambda e: F.concat(
        F.lit(" "), e["key"], F.lit('="'), _escape(e["value"], quote=True), F.lit('"'))), "")
    return F.concat(F.lit("<"), x["tag"], attrs, end if isinstance(end, Column) else F.lit(end))


def _aside(x: Column) -> Column:
    return F.when(x["tag"] == COMMENT, F.concat(F.lit("<!--"), x["text"], F.lit("-->"))).when(
        x["tag"] == INSTRUCTION, F.concat(F.lit("<?"), x["text"], F.lit(">")))


def ascii_markup(col: Column) -> Column:
    """Characters beyond ASCII as numeric references."""
    def reference(c: Column) -> Column:
        return F.when(F.ascii(c) > 127, F.concat(F.lit("&#"), F.ascii(c), F.lit(";"))).otherwise(c)

    return F.when(col.rlike(r"[^\x00-\x7F]"), F.array_join(
        F.transform(F.regexp_extract_all(col, F.lit(r"(?s)[\x00-\x7F]+|."), F.lit(0)), reference), "")).otherwise(col)


def _opening(x: Column) -> Column:
    return F.when(x["tag"] == TEXT, _escape(x["text"])).otherwise(F.coalesce(
        _aside(x), _start_tag(x, F.when(x["last"] == x["pre"], "/>").otherwise(">"))))


def _closing(x: Column) -> Column:
    return F.concat(F.lit("</"), x["tag"], F.lit(">"))


def _pieces(below: Column) -> tuple[Column, Column]:
    return (F.transform(below, lambda x: piece(x["pre"], x, _opening(x))),
            F.transform(F.filter(below, lambda x: x["last"] > x["pre"]), lambda x: piece(x["last"], x, _closing(x), end=True)))


def _tail(nodes: Column, node: Column) -> Column:
    after = let(F.get(nodes, node["last"] + 1), lambda n: F.when(
        (n["tag"] == TEXT) & (n["prev"] == node["pre"]), _escape(n["text"])).otherwise(""))
    return F.coalesce(after, F.lit(""))


def markup(nodes: Column, node: Column, tail: bool = True) -> Column:
    """The subtree as markup, followed by the text after it."""
    whole = let(subtree(nodes, node), lambda below: in_order(*_pieces(below)))
    return F.concat(whole, _tail(nodes, node)) if tail else whole


def markups_of(nodes: Column, found: Column, tail: bool | Column) -> Column:
    """The markup of each node found; where some lie in others, the page is written out once and each node's part cut from that."""
    more = F.lit(tail) if isinstance(tail, bool) else tail

    def end(x: Column) -> Column:
        return F.when(more, _tail(nodes, x)).otherwise("")

    def written(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda p: F.octet_length(p["text"])), F.lit(0), lambda a, b: a + b)
        return let(ends, lambda e: F.struct(
            _bytes(F.array_join(F.transform(pieces, lambda p: p["text"]), "")).alias("whole"),
            # in order of the pieces: the opening ones, one per node, tell where a node starts, the closing ones where it ends
            F.filter(F.transform(pieces, lambda p, i: F.when(p["end"] == 0, F.struct(
                _sum_before(e, i).alias("start"), F.get(e, i).alias("stop")))), lambda at: at.isNotNull()).alias("opened"),
            F.transform(F.sort_array(F.filter(F.transform(pieces, lambda p, i: F.struct(
                F.when(p["end"] == 1, -p["inner"]).alias("pre"), F.get(e, i).alias("at"))), lambda c: c["pre"].isNotNull())),
                lambda c: c["at"]).alias("stops"),
            F.transform(running(F.transform(nodes, lambda x: (x["last"] > x["pre"]).cast("int")), F.lit(0), lambda a, b: a + b),
                        lambda n: n - 1).alias("closed")))

    def part(page: Column, x: Column) -> Column:
        opened = F.get(page["opened"], x["pre"])
        stop = F.when(x["last"] > x["pre"], F.get(page["stops"], F.get(page["closed"], x["pre"]))).otherwise(opened["stop"])
        return F.concat(_cut(page["whole"], opened["start"], stop - opened["start"]), end(x))

    at_once = let(let(F.sort_array(F.concat(*_pieces(nodes))), written), lambda page: F.transform(found, lambda x: part(page, x)))
    return F.when(nested(found), at_once).otherwise(
        F.transform(found, lambda x: F.concat(markup(nodes, x, tail=False), end(x))))


def pretty_markup(nodes: Column, node: Column) -> Column:
    """The subtree with every tag and text on a line of its own, indented by depth."""
    def line(x: Column, text: Column) -> Column:
        return F.concat(F.repeat(F.lit(" "), x["depth"] - node["depth"]), text, F.lit("\n"))

    def opening(x: Column) -> Column:
        text = strip(x["text"])
        return (F.when((x["tag"] == TEXT) & (text == ""), "")
                .when(x["tag"] == TEXT, line(x, _escape(text)))
                .otherwise(line(x, F.coalesce(_aside(x), _start_tag(x, F.when(x["tag"].isin(*VOID), "/>").otherwise(">"))))))

    def body(below: Column) -> Column:
        closed = F.filter(below, lambda x: is_element(x) & ~x["tag"].isin(*VOID))
        return in_order(
            F.transform(below, lambda x: piece(x["pre"], x, opening(x))),
            F.transform(closed, lambda x: piece(
                x["last"], x, line(x, F.concat(F.lit("</"), x["tag"], F.lit(">"))), end=True)))

    return let(subtree(nodes, node), body)


Extractor = Callable[["Field", Column, Column], Column]
Values = Callable[["Field", Column, Column], Column]


def _attrs(field: Field, nodes: Column, found: Column) -> Column:
    return F.transform(found, lambda x: F.coalesce(x["attrs"][field.target], F.lit(field.default).cast("string")))


def compact_texts(nodes: Column, found: Column, separator: str | None = None) -> Column:
    """``text_compact`` of each node found, '' for nothing: white space can go piece by piece."""
    return texts_of(nodes, found, lambda x: F.coalesce(text_compact(nodes, x, separator), F.lit("")), squeeze_ws,
                    "".join((separator or "").split()))


def stripped_texts(nodes: Column, found: Column) -> Column:
    """``text_strip`` of each node found, '' for nothing."""
    return texts_of(nodes, found, lambda x: F.coalesce(text_strip(nodes, x), F.lit("")), strip)


def _texts(field: Field, nodes: Column, found: Column) -> Column:
    made = compact_texts(nodes, found, field.separator) if field.family == "soup" else stripped_texts(nodes, found)
    return F.transform(made, lambda t: F.when(t != "", t).otherwise(F.lit(field.default).cast("string")))


def _text_attrs(field: Field, nodes: Column, found: Column) -> Column:
    return F.zip_with(_texts(field, nodes, found), _attrs(field, nodes, found), lambda t, a: F.struct(t.alias("text"), a.alias("attr")))


# kind -> how the selected nodes become values
KINDS: dict[str, Values] = {
    "attr": _attrs,
    "text": _texts,
    "attr_text": _text_attrs,
    "html": lambda field, nodes, found: markups_of(nodes, found, tail=field.family == "tree"),
    "string": lambda field, nodes, found: F.transform(found, lambda x: x["text"]),
}


@dataclass(frozen=True)
class Field:
    """What to select and what to take from it: a kind by name, or a function of the user's own (M6u)."""

    kind: str | Extractor
    selector: Selector
    family: str = "soup"
    many: bool | None = None
    target: str | None = None
    separator: str | None = None
    default: str | None = None

    @property
    def is_many(self) -> bool:
        return self.family == "soup" if self.many is None else self.many

    def found(self, nodes: Column, scope: Column | None = None) -> Column:
        chosen = select(nodes, self.selector, scope)
        return chosen if self.is_many else F.slice(chosen, 1, 1)

    def extract(self, nodes: Column, scope: Column | None = None) -> Column:
        """struct(value, error): ``error`` is set where a required field found nothing."""
        has_default = bool(self.default) if self.family == "soup" else self.default is not None
        pair = self.kind == "attr_text"
        name = self.kind if isinstance(self.kind, str) else self.kind.__name__.strip("_")

        def build(found: Column) -> Column:
            if isinstance(self.kind, str):
                values = KINDS[self.kind](self, nodes, found)
            else:
                values = F.transform(found, lambda x: self.kind(self, nodes, x))
            fallback = F.lit(None)
            if has_default:
                one = F.lit(self.default)
                if pair:
                    one = F.struct(one.alias("text"), F.lit(None).cast("string").alias("attr"))
                fallback = F.array(one) if self.is_many else one
            value = values if self.is_many else F.get(values, F.lit(0))
            nothing = F.size(found) == 0
            error = F.when(nothing, F.lit(f"nothing matched for {name}")) if not has_default else F.lit(None)
            return F.struct(F.when(nothing, fallback).otherwise(value).alias("value"),
                            error.cast("string").alias("error"))

        return let(self.found(nodes, scope), build)


def attr_field(target: str, selector: Selector, **options) -> Field:
    if options.get("family") == "tree":
        options.setdefault("default", "")
    return Field("attr", selector, target=target, **options)


def text_field(selector: Selector, **options) -> Field:
    return Field("text", selector, **options)


def attr_text_field(target: str, selector: Selector, **options) -> Field:
    return Field("attr_text", selector, target=target, **options)


def html_field(selector: Selector, **options) -> Field:
    return Field("html", selector, **options)
