"""Nodes in nodes, crawls that take no page twice, arriving pages, URL patterns, JSON files, growing stores."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions.common import java_pattern
from pagemill.operators import json_items, sinks
from pagemill.operators.links import follow_links, staged_crawl
from pagemill.sources.nodes import contained, node_table, parse_nodes, register_sql, structural_pairs
from pagemill.sources.rules import pages_by_pattern, pattern_table, required_word
from pagemill.sources.shared import shared_dir
from pagemill.streaming import ingest
from tests.test_rules import random_page


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_nodes_in_nodes_are_those_of_the_interval_join(spark):
    draw = random.Random(8)
    pages = spark.createDataFrame([(i, random_page(draw, n)) for i, n in enumerate((0, 1, 30, 90, 200))] + [(9, None)], "page_id long, html string")
    nodes = node_table(pages).cache()
    some = nodes.where("tag = 'div'")
    outer = nodes.where("tag in ('span', 'body')").select("page_id", "pre", "last", "tag")
    want = some.alias("a").join(outer.alias("b"), F.expr("a.page_id = b.page_id and a.pre > b.pre and a.pre <= b.last"))
    found = contained(some.select("page_id", "pre", "attrs"), outer)
    assert rows(found, "page_id", "pre", "outer_pre", "outer_tag") == rows(want, "a.page_id", "a.pre", "b.pre", "b.tag")
    assert found.columns == ["page_id", "pre", "attrs", "outer_pre", "outer_last", "outer_tag"]
    parsed = parse_nodes(pages)
    pairs = structural_pairs(F.filter("nodes", lambda x: x["tag"] == "span"), F.filter("nodes", lambda x: x["tag"] == "div"))
    in_row = parsed.select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.inner.pre", F.col("p.outer.pre").alias("outer_pre"))
    assert rows(in_row) == rows(found.where("outer_tag = 'span'"), "page_id", "pre", "outer_pre")
    nodes.unpersist()


def test_nodes_in_sql_over_many_tasks(spark):
    register_sql(spark)
    pages = spark.range(200).repartition(7).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>a<p class=x>b"), "id").alias("html"))
    found = spark.sql("SELECT page_id, inline(nodes) FROM page_nodes(TABLE(SELECT page_id, html FROM {pages}))", pages=pages)
    assert rows(found.drop("attrs"), "page_id", "pre", "tag", "text") == rows(node_table(pages), "page_id", "pre", "tag", "text")


RING = [(0, [1, 2]), (1, [0, 2, 2]), (2, [3, 2]), (3, [0, 1]), (4, [0])]


def ring(spark):
    html = lambda to: "".join(f"<a href=/p/{q}>x</a>" for q in to)
    return spark.createDataFrame([(p, f"http://h/p/{p}", html(to)) for p, to in RING], "page_id long, url string, html string")


def ring_links(pages):
    refs = F.regexp_extract_all("html", F.lit("href=([^>]*)>"), F.lit(1))
    return pages.select("page_id", F.explode(F.transform(refs, lambda r: F.concat(F.lit("http://h"), r))).alias("link"))


def test_a_crawl_that_takes_no_page_twice(spark):
    pages = ring(spark)
    seeds = pages.where("page_id in (0, 4)").select(F.col("page_id").alias("seed"), F.col("url").alias("link"))
    last = lambda p: p.select("page_id", F.col("page_id").alias("at"))

    def hop(number, **options):
        return rows(staged_crawl(seeds, pages, [ring_links] * number + [last], ["seed"], **options), "seed", "at")

    assert [hop(n, dedupe_frontier=True) for n in range(4)] == [[(0, 0), (4, 4)], [(0, 1), (0, 2)], [(0, 3)], []]
    assert hop(1) == [(0, 1), (0, 2), (4, 0)] and (0, 2) in hop(3)  # as before pages repeat
    assert len(hop(2)) > 3


def test_links_of_arriving_pages(spark):
    """In any order of arrival the hops are those of all pages; a replayed batch changes nothing."""
    pages, base = ring(spark), shared_dir(spark, "arrive")
    links_of = lambda p: ring_links(p).withColumnRenamed("page_id", "src")
    want = rows(follow_links(links_of(pages), pages), "src", "link", "page_id")
    kind = "src long, link string, page_id long, page_url string"
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 3, 1]):
        out = f"{base}/{'-'.join(map(str, order))}"
        write = ingest.hop_writer(out, links_of, "s")
        for batch, page in enumerate(order):
            for _ in range(2):
                write(pages.where(F.col("page_id") == page), batch)
        assert rows(spark.read.schema(kind).parquet(f"{out}/hops"), "src", "link", "page_id") == want


def test_a_batch_reads_the_parts_of_its_keys(spark):
    out = f"{shared_dir(spark, 'parts')}/out"
    schema = "k long, o long, v string"
    frame = lambda keys: spark.createDataFrame([(k, k, "x" * 50) for k in keys], schema)
    kind = frame([]).schema
    write = ingest.absent_writer(out, "k", "o", kind, "s", buckets=32)
    for batch in range(4):
        write(frame(range(batch * 500, batch * 500 + 500)), batch)
    write(frame([7, 5000]), 4)
    write(frame([7, 5000]), 4)
    assert rows(ingest.stored_rows(spark, out, kind), "k") == [(k,) for k in [*range(2000), 5000]] or len(rows(ingest.stored_rows(spark, out, kind))) == 2001
    some = ingest.stored_rows(spark, out, kind, [3])
    assert 0 < some.count() < 200
    assert all("part=3" in f for f in some.inputFiles()) or "PartitionFilters" in some._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pattern,word", [
    (r"/news/\d+", "news"), (r"https?://www\.", "www"), (r"^https://blog.+/x", "https"), (r"(?:/news/)?", None), (r"/news|/old/", None),
    (r"[?&]utm_source=", "source"), (r"/a/(b)/archive/$", "archive"), (r"news", None), (r"/é1/xy/", "xy"), (r"(?i)/NEWS/", None), (r"(?i)/ABC/", "abc"), (r"/x{2}/", None), ("", None)])
def test_words_that_a_pattern_needs(pattern, word):
    assert required_word(pattern) == word


def test_pages_by_pattern(spark):
    urls = ["http://www.a.com/news/12", "https://blog.b.com/en/3?x=1", "http://c.org/News/5#top", None, "", "http://news.d.com/x", "/news/1/news/2"]
    patterns = [(0, r"/news/\d+"), (1, r"(?i)/news/"), (2, r"\d$"), (3, r"^https?://www\."), (4, r"/nothing/"), (5, r"/news/\d+")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = pages_by_pattern(pages, pattern_table(spark, patterns))
    assert rows(found, "page_id", "rule_id") == sorted((i, k) for i, u in enumerate(urls) if u is not None for k, p in patterns if re.search(p, u))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert rows(pages_by_pattern(pages, pattern_table(spark, patterns[:1])), "rule_id") == [(0,), (0,)]
    assert java_pattern(r"\d")


def test_json_files(spark):
    base = shared_dir(spark, "json-files")
    docs = ['{"a": 1}', '[{"a": 2},\n {"a": 3}]', '{"a": ', "  ", "null", '"text"']
    frame = spark.createDataFrame([(d,) for d in docs], "doc string")
    json_items.write_documents(frame, "doc", f"{base}/lines")
    lines = json_items.read_documents(spark, f"{base}/lines", lines=True)
    assert rows(lines.select("error").where("error is not null")) == [('no JSON: {"a": ',)]
    found = json_items.records(lines.drop("error"), "doc", {"a": json_items.JsonField("a")})
    assert [r for r in rows(found, "a", "pos") if r[0]] == [("1", 0), ("2", 0), ("3", 1)]
    frame.where("doc like '[%'").coalesce(1).write.text(f"{base}/whole", lineSep=" ")
    whole = json_items.read_documents(spark, f"{base}/whole")
    assert rows(json_items.records(whole.drop("error", "file"), "doc", {"a": json_items.JsonField("a")}), "a") == [("2",), ("3",)]
    assert whole.first().file.startswith("file:")


def test_an_insert_adds_rows_and_leaves_what_is_stored(spark):
    path = f"{shared_dir(spark, 'append')}/t"
    schema = spark.createDataFrame([], "k long, v string").schema
    store = sinks.KeyedStore(spark, path, schema, "k", buckets=2, most_versions=4)
    give = lambda *pairs: spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "k long, v string, o long")

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file:") + "/data") for f in names if f.endswith(".parquet")}

    store.insert(give(*((k, "a") for k in range(20))), "o")
    before = files()
    for k in range(20, 23):
        store.insert(give((k, "b"), (1, "late"), (k, "second")), "o")
    assert before <= files() and rows(store.rows()) == sorted([(k, "a") for k in range(20)] + [(k, "b") for k in range(20, 23)], key=repr)
    assert sum(spark.read.parquet(f).count() for f in files() - before) == 3
    store.upsert(give((1, "c"), (40, "d")), "o")
    for k in range(50, 60):  # a bucket of many versions becomes whole again
        store.insert(give((k, "e")), "o")
    assert max(len(v) for v in store._current().values()) <= 4
    want = [(k, "c" if k == 1 else "a") for k in range(20)] + [(k, "b") for k in range(20, 23)] + [(40, "d")] + [(k, "e") for k in range(50, 60)]
    assert rows(store.rows()) == sorted(want, key=repr)
