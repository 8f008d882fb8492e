"""Fields whose selectors are data: columns of a rule table instead of expressions of a query (A2, H1).

A step is a list of tests; a selector is an array of steps.  One expression
evaluates any selector on a page's nodes, so a plan doesn't grow with the
number of rules.

All selectors of a page's rules form a trie (``PROGRAM_TYPE``), whose nodes are
runs of steps: what several selectors begin with is looked for once, below
what the runs before it have found, and fields that several rules have are
taken once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.common import java_pattern, let, squeeze_ws, strip
from pagemill.operators.fields import Field, markups_of, texts, texts_of
from pagemill.operators.select import Match, Step, below, class_tokens, outermost, own_string
from pagemill.sources.nodes import TEXT, is_element

TEST_TYPE = T.StructType([
    T.StructField("on", T.StringType()),      # tag, attr, class or string
    T.StructField("name", T.StringType()),    # of the attribute
    T.StructField("op", T.StringType()),      # any, in, like, prefix or contains
    T.StructField("values", T.ArrayType(T.StringType())),
])
STEP_TYPE = T.StructType([
    T.StructField("element", T.BooleanType()),  # else a text
    T.StructField("tests", T.ArrayType(TEST_TYPE)),
    T.StructField("nth", T.IntegerType()),
    T.StructField("child", T.BooleanType()),
])
FIELD_TYPE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("many", T.BooleanType()),
    T.StructField("target", T.StringType()),
    T.StructField("separator", T.StringType()),
    T.StructField("fallback", T.StringType()),
    T.StructField("steps", T.ArrayType(STEP_TYPE)),
])


# -- fields as rows -----------------------------------------------------------------------------------

def _test(on: str, name: str | None, test: Match, op: str = "match") -> tuple:
    if op in ("prefix", "contains"):
        return on, name, op, [test]
    if test is True:
        return on, name, "any", []
    if isinstance(test, re.Pattern):
        return on, name, "like", [java_pattern(test)]
    if isinstance(test, (list, tuple)):
        if any(not isinstance(t, str) for t in test):
            return on, name, "like", ["|".join(f"(?:{java_pattern(t) if isinstance(t, re.Pattern) else '^' + re.escape(t) + '$'})" for t in test)]
        return on, name, "in", list(test)
    return on, name, "in", [test]


def _step_row(step: Step) -> tuple:
    tests = []
    if step.tag is not None and step.tag is not True and step.tag != TEXT:
        tests.append(_test("tag", None, step.tag))
    if step.id is not None:
        tests.append(_test("attr", "id", step.id))
    tests += [_test("token", "class", name) for name in step.classes]
    for name, op, value in step.attrs:
        tests.append(_test("class" if op == "class" else "attr", name, value, op))
    if step.string is not None:
        tests.append(_test("string", None, step.string))
    return step.tag != TEXT, tests, step.nth, step.child


def field_row(field: Field) -> tuple:
    """A field as a row of FIELD_TYPE; fields of user functions can't be data."""
    if not isinstance(field.kind, str):
        raise ValueError("a field with a function of its own is no data")
    fallback = field.default if field.default or field.family == "tree" else None
    return (field.kind, field.family, field.is_many, field.target, field.separator, fallback,
            [_step_row(s) for s in field.selector.steps])


# -- evaluation ---------------------------------------------------------------------------------------

def _meets(value: Column, test: Column) -> Column:
    first = F.get(test["values"], F.lit(0))
    return F.coalesce(
        F.when(test["op"] == "any", value.isNotNull())
        .when(test["op"] == "in", F.array_contains(test["values"], value))
        # this function keeps the last pattern compiled; a step's tests see the same one for all nodes
        .when(test["op"] == "like", F.regexp_instr(value, first) > 0)
        .when(test["op"] == "prefix", F.startswith(value, first))
        .otherwise(F.contains(value, first)), F.lit(False))


def _passes(nodes: Column, x: Column, step: Column) -> Column:
    def one(test: Column) -> Column:
        text = F.when(step["element"], own_string(nodes, x)).otherwise(x["text"])
        value = F.when(test["on"] == "tag", x["tag"]).when(test["on"] == "string", text).otherwise(x["attrs"][test["name"]])
        tokens = test["on"].isin("token", "class") & F.coalesce(F.exists(class_tokens(x), lambda t: _meets(t, test)), F.lit(False))
        return tokens | ((test["on"] != "token") & _meets(value, test))

    kind = F.when(step["element"], is_element(x)).otherwise(x["tag"] == TEXT)
    return kind & (step["nth"].isNull() | (step["nth"] == x["nth"])) & F.forall(step["tests"], one)


RUN_TYPE = T.ArrayType(STEP_TYPE)
PROGRAM_TYPE = T.StructType([
    T.StructField("trie", T.ArrayType(T.StructType([
        T.StructField("parent", T.IntegerType()),  # place in the trie, which it comes before; -1 for a selector's first run
        T.StructField("run", RUN_TYPE)]))),
    T.StructField("fields", T.ArrayType(T.StructType([
        T.StructField("end", T.IntegerType()),     # place of its selector's last run
        T.StructField("field", FIELD_TYPE)]))),
])
_AREA = "array<struct<pre:int,last:int,depth:int>>"


def runs_of(steps: Column) -> Column:
    """The steps cut before every descendant axis."""
    def cut(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~F.get(s, i)["child"])
        return let(begins, lambda b: F.transform(b, lambda i, k: F.slice(s, i + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - i)))

    return let(steps, cut)


def _ends(nodes: Column, x: Column, upwards: Column) -> Column:
    """Whether the node and its parents match a run, given from its last step."""
    def up(state: Column, step: Column) -> Column:
        y = F.get(nodes, state["at"])
        return F.struct(F.coalesce(y["parent"], F.lit(-1)).alias("at"), (state["fits"] & F.coalesce(_passes(nodes, y, step), F.lit(False))).alias("fits"))

    return F.aggregate(upwards, F.struct(x["pre"].alias("at"), F.lit(True).alias("fits")), up, lambda s: s["fits"])


def run_found(nodes: Column, areas: Column, run: Column) -> Column:
    """The nodes below the areas that end a run which begins there; a run that begins with a child axis does so at the root."""
    def search(upwards: Column) -> Column:
        def test(x: Column, u: Column) -> Column:
            begin = x["depth"] - (F.size(upwards) - 1)
            return (begin > u["depth"]) & (~F.element_at(upwards, -1)["child"] | (begin == 0)) & _ends(nodes, x, upwards)

        return below(nodes, areas, test)

    return let(F.reverse(run), search)


def _page(nodes: Column) -> Column:
    """All of the page as an area."""
    return F.array(F.struct(F.lit(-1).alias("pre"), (F.size(nodes) - 1).alias("last"), F.lit(-1).alias("depth"))).cast(_AREA)


def chosen(nodes: Column, steps: Column) -> Column:
    """The nodes that end a selector, in document order."""
    def through(runs: Column) -> Column:
        def step(areas: Column, run: Column) -> Column:
            return outermost(run_found(nodes, areas, run)).cast(_AREA)

        before = F.aggregate(F.slice(runs, F.lit(1), F.size(runs) - 1), _page(nodes), step)
        return let(before, lambda areas: run_found(nodes, areas, F.element_at(runs, -1)))

    return let(runs_of(steps), through)


def trie_found(nodes: Column, trie: Column) -> Column:
    """For each place of the trie the nodes that end its run, each run looked for once."""
    kind = "array<struct<found:array<int>,areas:" + _AREA + ">>"

    def grow(done: Column, spot: Column) -> Column:
        areas = F.when(spot["parent"] < 0, _page(nodes)).otherwise(F.get(done, spot["parent"])["areas"])
        found = let(areas, lambda a: run_found(nodes, a, spot["run"]))
        return F.concat(done, let(found, lambda m: F.array(F.struct(
            F.transform(m, lambda x: x["pre"]).alias("found"), outermost(m).alias("areas")))).cast(kind))

    return F.transform(F.aggregate(trie, F.array().cast(kind), grow), lambda s: s["found"])


def program_values(nodes: Column, program: Column) -> Column:
    """For each field of the program its values, as ``field_values`` gives them."""
    def values(found: Column) -> Column:
        def one(f: Column) -> Column:
            spots = F.get(found, f["end"])
            limited = F.when(f["field"]["many"], spots).otherwise(F.slice(spots, 1, 1))
            return let(F.transform(limited, lambda at: F.get(nodes, at)), lambda m: values_of(nodes, f["field"], m))

        return F.transform(program["fields"], one)

    return let(trie_found(nodes, program["trie"]), values)


def field_values(nodes: Column, field: Column) -> Column:
    """array<struct(text, attr)> of a field that is data; NULL where it finds nothing and has no fallback."""
    def limited(found: Column) -> Column:
        return F.when(field["many"], found).otherwise(F.slice(found, 1, 1))

    return let(field["steps"], lambda steps: let(let(chosen(nodes, steps), limited), lambda found: values_of(nodes, field, found)))


def values_of(nodes: Column, field: Column, found: Column) -> Column:
    """What the field takes from the nodes that its selector found."""
    soup = field["family"] == "soup"
    gap = F.when(soup, squeeze_ws(F.coalesce(field["separator"], F.lit("")))).otherwise("")
    piece = lambda t: F.when(soup, squeeze_ws(t)).otherwise(strip(t))

    def one(x: Column) -> Column:
        pieces = F.filter(F.transform(texts(nodes, x), piece), lambda t: t != "")
        return F.call_function("array_join", pieces, gap)

    def value(words: Column, x: Column) -> Column:
        attr = F.when(field["kind"].isin("attr", "attr_text"), F.coalesce(x["attrs"][field["target"]], field["fallback"]))
        return F.struct(words.alias("text"), attr.alias("attr"))

    made = F.when(field["kind"].isin("text", "attr_text"), F.transform(
        texts_of(nodes, found, one, piece, gap), lambda t: F.when(t != "", t).otherwise(field["fallback"]))).when(
        field["kind"] == "html", markups_of(nodes, found, field["family"] == "tree")).when(
        field["kind"] == "string", F.transform(found, lambda x: x["text"])).otherwise(
        F.transform(found, lambda _: F.lit(None).cast("string")))
    is_attr = field["kind"] == "attr"
    fallback = F.array(F.struct(F.when(~is_attr, field["fallback"]).alias("text"), F.when(is_attr, field["fallback"]).alias("attr")))
    return F.when(F.size(found) > 0, F.zip_with(made, found, value)).when(field["fallback"].isNotNull(), fallback)
