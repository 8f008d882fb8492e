"""Element selection on the node array.

A selector is data: a tuple of steps, cut into runs before every descendant
axis.  A run looks at a node and the fixed number of parents that its child axes
name; the runs follow each other set at a time.  No self-join and no shuffle is
involved.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.common import java_pattern, let, running
from pagemill.sources.nodes import COMMENT, INSTRUCTION, TEXT, is_element

Match = str | re.Pattern | bool | list


@dataclass(frozen=True)
class Step:
    """One step: tests on an element and how it hangs below the step before."""

    tag: Match | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, Match], ...] = ()  # (name, op, value)
    nth: int | None = None
    string: Match | None = None
    child: bool = False

    def __hash__(self) -> int:
        return hash(repr(self))


@dataclass(frozen=True)
class Selector:
    """Steps and the part of the page they apply to.

    reach: 'inside' the scope (its ancestors still count for earlier steps),
    'self' also tests the scope element and ignores what lies outside it,
    'page' looks at the whole page whatever the scope.
    """

    steps: tuple[Step, ...]
    reach: str = "inside"


def descend(*steps: Step, reach: str = "inside") -> Selector:
    """CSS-like chain; set ``child=True`` on a step for the child axis."""
    return Selector(tuple(steps), reach)


def find_all(tag: Match | None = None, attrs: dict[str, Match] | None = None, string: Match | None = None,
             recursive: bool = True) -> Selector:
    """Selector by tag and attribute tests."""
    if tag is None and not attrs and string is not None:
        return Selector((Step(tag=TEXT, string=string),))
    tests = tuple((name, "class" if name == "class" else "match", value) for name, value in (attrs or {}).items())
    return Selector((Step(tag=tag, attrs=tests, string=string, child=not recursive),))


def _matches(value: Column, test: Match) -> Column:
    if test is True:
        return value.isNotNull()
    if isinstance(test, re.Pattern):
        return value.rlike(java_pattern(test))
    if isinstance(test, (list, tuple)):
        either = F.lit(False)
        for one in test:
            either = either | _matches(value, one)
        return either
    return value == test


def _attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def class_tokens(node: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(_attr(node, "class"), r"\s+", " ")), " ")


def own_string(nodes: Column, node: Column) -> Column:
    """The element's only string, looked up through only children; else NULL.

    A subtree is such a chain exactly when its last node lies as deep as the
    subtree has nodes.
    """
    leaf = F.get(nodes, node["last"])
    chain = (leaf["depth"] - node["depth"] == node["last"] - node["pre"]) & leaf["tag"].isin(TEXT, COMMENT, INSTRUCTION)
    return F.when(chain, leaf["text"])


def _test(nodes: Column, node: Column, step: Step) -> Column:
    tests = []
    if step.tag == TEXT:
        return (node["tag"] == TEXT) & _matches(node["text"], step.string if step.string is not None else True)
    if step.tag is None or step.tag is True:
        tests.append(is_element(node))
    else:
        tests.append(_matches(node["tag"], step.tag))
        if not isinstance(step.tag, str):
            tests.append(is_element(node))
    if step.id is not None:
        tests.append(_attr(node, "id") == step.id)
    for name in step.classes:
        tests.append(F.array_contains(class_tokens(node), name))
    for name, op, value in step.attrs:
        attr = _attr(node, name)
        if op == "class":  # any single token, or the whole value
            tests.append(_matches(attr, value) | F.exists(class_tokens(node), lambda t: _matches(t, value)))
        elif op == "match":
            tests.append(_matches(attr, value))
        elif op == "prefix":
            tests.append(attr.startswith(value))
        elif op == "contains":
            tests.append(attr.contains(value))
        else:
            raise ValueError(f"unknown attribute test {op}")
    if step.nth is not None:
        tests.append(node["nth"] == step.nth)
    if step.string is not None:
        tests.append(_matches(own_string(nodes, node), step.string))
    result = tests[0]
    for one in tests[1:]:
        result = result & one
    return F.coalesce(result, F.lit(False))


def _run(nodes: Column, node: Column, steps: Sequence[Step]) -> Column:
    """Whether ``node`` and its parents match steps joined by the child axis, the last one at ``node``."""
    result = _test(nodes, node, steps[-1])
    if len(steps) > 1:
        result = result & (node["parent"] >= 0) & _run(nodes, F.get(nodes, node["parent"]), steps[:-1])
    return F.coalesce(result, F.lit(False))


def _runs(steps: Sequence[Step]) -> list[list[Step]]:
    """Cut the steps before every descendant axis."""
    runs: list[list[Step]] = []
    for step in steps:
        if step.child and runs:
            runs[-1].append(step)
        else:
            runs.append([step])
    return runs


def outermost(found: Column) -> Column:
    """Of nodes in document order those that lie in no other of them, as (pre, last, depth)."""
    def keep(m: Column) -> Column:
        return let(running(F.transform(m, lambda x: x["last"]), F.lit(-1), F.greatest), lambda ends: F.filter(
            m, lambda x, i: (i == 0) | (F.get(ends, i - 1) < x["pre"])))

    short = lambda x: F.struct(x["pre"].alias("pre"), x["last"].alias("last"), x["depth"].alias("depth"))
    return F.transform(let(found, lambda m: F.when(F.size(m) < 2, m).otherwise(keep(m))), short)


def below(nodes: Column, areas: Column, test: Callable[[Column, Column], Column]) -> Column:
    """The nodes below the areas that pass ``test`` (node, area), in document order; areas hold no other."""
    return F.flatten(F.transform(areas, lambda u: F.filter(
        F.slice(nodes, u["pre"] + 2, u["last"] - u["pre"]), lambda x: test(x, u))))


def _next(nodes: Column, steps: Sequence[Step]) -> Callable[[Column], Column]:
    """From nodes found to those that end a run whose first step lies below one of them."""
    return lambda found: below(nodes, outermost(found), lambda x, u: (
        x["depth"] - (len(steps) - 1) > u["depth"]) & _run(nodes, x, steps))


def _satisfied(nodes: Column, scope: Column, runs: Sequence[Sequence[Step]]) -> Column:
    """How many of the runs the scope and its ancestors hold, each placed as far up as it fits, and the depths where they end."""
    def place(state: Column, x: Column) -> Column:
        fits = F.lit(False)
        for i, steps in enumerate(runs):
            under = F.coalesce(F.try_element_at(state, F.lit(-1)), F.lit(-1))
            fits = F.when(F.size(state) == i, (x["depth"] - (len(steps) - 1) > under) & _run(nodes, x, steps)).otherwise(fits)
        return F.when(fits, F.concat(state, F.array(x["depth"]))).otherwise(state)

    up = running(F.sequence(F.lit(0), scope["depth"]), scope["pre"] + 0, lambda at, d: F.when(d == 0, at).otherwise(F.get(nodes, at)["parent"]))
    path = F.transform(F.reverse(up), lambda at: F.get(nodes, at))
    return F.aggregate(path, F.slice(F.array(F.lit(0)), 1, 0), place)


def select(nodes: Column, selector: Selector, scope: Column | None = None) -> Column:
    """Array of the matching nodes in document order.

    Steps are taken set at a time from the first: what ends a run of steps is
    reduced to its outermost nodes, and only what lies below them is looked at
    for the next run.  So a selector costs a page's nodes per step, however deep
    they lie and however many of them match.
    """
    runs, pool = _runs(selector.steps), nodes
    anchored, top = selector.steps[0].child, F.lit(0)
    inside = scope is not None and selector.reach == "inside"
    if scope is not None and selector.reach != "page":
        first = 1 if selector.reach == "self" else 2
        pool = F.slice(nodes, scope["pre"] + first, scope["last"] - scope["pre"] + (2 - first))
        if selector.reach == "self":
            top = scope["depth"]
        if anchored:
            top = scope["depth"] + 1

    def starts(under: Column, steps: Sequence[Step], exact: bool = False) -> Column:
        def test(x: Column) -> Column:
            start = x["depth"] - (len(steps) - 1)
            return ((start == under) if exact else (start >= under)) & _run(nodes, x, steps)

        return F.filter(pool, test)

    if not inside or anchored or len(runs) == 1:
        found = starts(top, runs[0], anchored)
        for steps in runs[1:]:
            found = let(found, _next(nodes, steps))
        return found

    def from_scope(held: Column) -> Column:
        """Runs that the scope and its ancestors hold are done with; the one after them begins anywhere in the scope."""
        found = starts(F.lit(0), runs[0])
        for i, steps in enumerate(runs[1:], 1):
            fresh = starts(F.get(held, F.lit(i - 1)) + 1, steps)
            found = F.when(F.size(held) > i, F.slice(pool, 1, 0)).when(F.size(held) == i, fresh).otherwise(
                let(found, _next(nodes, steps)))
        return found

    return let(_satisfied(nodes, scope, runs[:-1]), from_scope)
