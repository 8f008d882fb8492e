"""Selectors set at a time, and many rules of a page in one pass."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators.fields import attr_field, attr_text_field, html_field, text_field
from pagemill.operators.rule_fields import chosen
from pagemill.operators.select import Step, descend, find_all, select
from pagemill.sources.nodes import parse_nodes, parse_page
from pagemill.sources.rules import Rule, extract_by_rule, extract_rules, rule_page_join, rule_table, site_programs


def parsed(spark, *html):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)]
    return parse_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"))


def random_page(draw, size):
    """Nested spans and divs with classes x and y."""
    out, open_tags = [], []
    for _ in range(size):
        if open_tags and draw.random() < 0.45:
            out.append(f"</{open_tags.pop()}>")
        else:
            tag = draw.choice(("span", "div"))
            open_tags.append(tag)
            out.append(f"<{tag} class='{draw.choice(('x', 'y', 'x y', 'z'))}'>")
    return "".join(out)


def plain_matches(tree, steps, node, floor=0):
    """Whether the steps end at the node, by trying every ancestor."""
    def fits(step, i):
        classes = dict(tree.attrs[i]).get("class", "").split()
        return tree.tag[i][0] != "#" and (step.tag in (None, tree.tag[i])) and all(c in classes for c in step.classes)

    if not fits(steps[-1], node) or tree.depth[node] < floor:
        return False
    if len(steps) == 1:
        return True
    up = tree.parent[node]
    while up >= 0:
        if plain_matches(tree, steps[:-1], up, floor):
            return True
        if steps[-1].child:
            break
        up = tree.parent[up]
    return False


def random_steps(draw):
    def step(first):
        kind = draw.choice(({"tag": "div"}, {"tag": "span"}, {"classes": ("x",)}, {"classes": ("y",)}, {"tag": "div", "classes": ("x",)}))
        return Step(**kind, child=not first and draw.random() < 0.4)
    return tuple(step(i == 0) for i in range(draw.randrange(1, 5)))


def test_selectors_on_random_trees(spark):
    draw = random.Random(5)
    html = [random_page(draw, n) for n in (3, 20, 60, 120)]
    trees = [parse_page(h) for h in html]
    chains = [random_steps(draw) for _ in range(9)]
    pages = parsed(spark, *html)
    whole = [F.transform(select(F.col("nodes"), descend(*c)), lambda x: x["pre"]).alias(f"w{i}") for i, c in enumerate(chains)]
    for r in pages.select("page_id", *whole).collect():
        tree = trees[r.page_id]
        for i, c in enumerate(chains):
            assert r[f"w{i}"] == [n for n in range(len(tree.pre)) if plain_matches(tree, c, n)], c
    data = rule_table(spark, [Rule("h", "c", str(i), "u", (html_field(descend(*c)),)) for i, c in enumerate(chains)])
    rows = pages.join(F.broadcast(data.select("rule_id", "fields")), F.lit(True)).select(
        "page_id", "rule_id", F.transform(chosen(F.col("nodes"), F.get("fields", F.lit(0))["steps"]), lambda x: x["pre"]).alias("pre"))
    for r in rows.collect():
        tree = trees[r.page_id]
        assert r.pre == [n for n in range(len(tree.pre)) if plain_matches(tree, chains[r.rule_id], n)], chains[r.rule_id]


@pytest.mark.parametrize("reach", ["inside", "self"])
def test_scoped_selectors_on_random_trees(spark, reach):
    """Earlier steps may lie above the scope, or none may."""
    draw = random.Random(6)
    html = [random_page(draw, n) for n in (20, 70)]
    trees = [parse_page(h) for h in html]
    chains = [c for c in (random_steps(draw) for _ in range(12)) if len(c) > 1][:5]
    scope = descend(Step("div"))

    def within(chain):
        return F.transform(select(F.col("nodes"), scope), lambda s: F.struct(s["pre"].alias("scope"), F.transform(
            select(F.col("nodes"), descend(*chain, reach=reach), s), lambda x: x["pre"]).alias("pre")))

    for r in parsed(spark, *html).select("page_id", *(within(c).alias(f"w{i}") for i, c in enumerate(chains))).collect():
        tree = trees[r.page_id]
        for i, c in enumerate(chains):
            for scope_pre, got in r[f"w{i}"]:
                begin, floor = (scope_pre, tree.depth[scope_pre]) if reach == "self" else (scope_pre + 1, 0)
                assert got == [n for n in range(begin, tree.last[scope_pre] + 1) if plain_matches(tree, c, n, floor)], (c, scope_pre)


def test_a_deep_page_costs_its_nodes(spark):
    """Unclosed elements below a nav lie one in the other."""
    pages = parsed(spark, "<nav>" + "<i>x" * 40_000)
    begin = time.time()
    found = pages.select(F.size(select(F.col("nodes"), descend(Step("nav"), Step("i")))).alias("a"),
                         F.size(select(F.col("nodes"), descend(Step("nav"), Step("i"), Step("i"), Step("i", child=True)))).alias("b")).first()
    assert found == (40_000, 39_998)
    data = rule_table(spark, [Rule("h", "c", "s", "u", (html_field(descend(Step("nav"), Step("i"), Step("i"))),))]).select("fields")
    rows = pages.join(F.broadcast(data), F.lit(True)).select(F.size(chosen(F.col("nodes"), F.get("fields", F.lit(0))["steps"])).alias("n"))
    assert rows.first().n == 39_999
    assert time.time() - begin < 90


A = descend(Step("ul", classes=("list",)), Step("li"), Step("a"))
FIELDS = [attr_text_field("href", A), attr_field("href", A, many=False), text_field(descend(Step("ul", classes=("list",)), Step("b"))),
          text_field(descend(Step("h1")), many=False), html_field(find_all("p"), family="tree"), text_field(find_all("a", string=re.compile("t[12]"))),
          attr_field("href", descend(Step("ul", classes=("list",)), Step("li"), Step("a", child=True))), text_field(descend(Step("blink")), default="none")]
HTML = ["<h1>one</h1><ul class='list a'><li><a href=1>t1</a><li><b>x</b><a href=2>t2</a></ul><p>p<p>q", "<ul><li><a href=3>t3</a></ul>", "", None]


def many_rules(spark, count):
    return rule_table(spark, [Rule(("a.com", "b.com")[i % 2], "c", str(i), f"http://x/{i}", (FIELDS[i % len(FIELDS)],)) for i in range(count)])


def site_pages(spark):
    rows = [(i * 10 + j, f"http://{site}/p/{i}", h) for i, h in enumerate(HTML) for j, site in enumerate(("a.com", "b.com", "none.com"))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def values(df):
    return sorted(((r.page_id, r.rule_id, r.text, r.attr) for r in df.collect()), key=repr)


def test_rules_in_one_pass_give_what_each_gives(spark):
    rules, pages = many_rules(spark, 20), site_pages(spark)
    one_pass = extract_rules(pages, rules, 0)
    each = extract_by_rule(parse_nodes(rule_page_join(pages, rules).select("page_id", "rule_id", "fields", "html")), 0)
    assert values(one_pass) == values(each) and len(values(each)) > 30
    assert "category" in one_pass.columns and "html" not in one_pass.columns
    assert extract_rules(pages, rules, 1).count() == 0 and extract_rules(pages.limit(0), rules, 0).count() == 0


def test_selectors_share_what_they_begin_with(spark):
    programs = {r.site: r for r in site_programs(many_rules(spark, 40), 0).collect()}
    assert {s: len(r.rules) for s, r in programs.items()} == {"a.com": 20, "b.com": 20}
    trie = programs["a.com"].program.trie
    assert len(programs["a.com"].program.fields) == 4  # every second of eight fields
    assert all(spot.parent < i for i, spot in enumerate(trie))
    assert len(trie) < sum(len(f.field.steps) for f in programs["a.com"].program.fields)


def test_a_pattern_of_the_rule_chooses_urls(spark):
    rules = many_rules(spark, 4).withColumn("pattern", F.when(F.col("rule_id") == 0, F.lit("/p/[1-9]$")))
    got = {(r.page_id, r.rule_id) for r in extract_rules(site_pages(spark), rules, 0).collect()}
    assert got == {(0, 2), (1, 1), (1, 3)}  # rule 0 is for other pages than that with the links


def test_a_thousand_rules_cost_little_more_than_ten(spark):
    """Of one host, with the fields that the host's pages have; one parse for all."""
    html = "<h1>t</h1>" + "".join(f"<ul class=list><li><a href={i}>t{i}</a></ul>" for i in range(60))
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.com/"), "id").alias("url"), F.lit(html).alias("html"))

    def seconds(count):
        rules = rule_table(spark, [Rule("a.com", "c", str(i), "u", (attr_field("href", A, many=False) if i % 10 else FIELDS[3],)) for i in range(count)])
        job = extract_rules(pages, rules, 0)
        assert str(job._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
        job.count()
        begin = time.time()
        assert job.count() == 40 * count
        return time.time() - begin

    few, many = seconds(10), seconds(1000)
    assert many < 3 * few + 1
