"""Sinks, joins, attempts, incremental runs and their plans."""

from __future__ import annotations

import io
import os
import random
import re
import time
import uuid
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import urls
from pagemill.functions.common import broadcast_if_small, squeeze_ws, strip
from pagemill.operators import attempts, sinks
from pagemill.operators.content import main_content
from pagemill.operators.links import (ANCHOR, absolute_attrs, absolute_style, base_url, follow_links, indexed_batch, page_links,
                                      request_batch, save_site, staged_crawl, with_canonical)
from pagemill.plans import all_queries
from pagemill.sources.nodes import PARSE_PARTITIONS, contained, node_table, parse_nodes
from pagemill.sources.rules import host_rules, rule_page_join
from pagemill.sources.shared import shared_dir
from pagemill.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# -- sinks ----------------------------------------------------------------------------------------------

def test_insert_twice_adds_once(spark):
    stored = spark.createDataFrame([("a", "old", 0)], "k string, v string, o long")
    incoming = spark.createDataFrame([("a", "x", 1), ("b", "late", 5), ("b", "first", 2), ("c", None, 3)], stored.schema)
    new = sinks.insert_if_absent(stored, incoming, "k", "o")
    assert rows(new) == [("b", "first", 2), ("c", None, 3)]
    assert sinks.insert_if_absent(stored.unionByName(new), incoming, "k", "o").count() == 0
    assert rows(sinks.existing_keys(incoming, stored, "k")) == [("a", "x", 1)]
    assert sinks.missing_keys(incoming, stored, "k").count() == 3


def test_upsert_overwrites_with_nulls_and_keeps_other_fields(spark):
    stored = spark.createDataFrame([("a", 1, "keep"), ("b", 2, "keep")], "k string, v int, other string")
    incoming = spark.createDataFrame([("a", 7, 1), ("a", None, 2), ("c", 3, 1), ("c", 4, 9)], "k string, v int, o long")
    once = sinks.upsert(stored, incoming, "k", "o")
    assert rows(once, "k") == [("a", None, "keep", False), ("b", 2, "keep", False), ("c", 4, None, True)]
    twice = sinks.upsert(once.drop("inserted"), incoming, "k", "o")
    assert rows(twice.drop("inserted"), "k") == rows(once.drop("inserted"), "k")
    assert twice.where("inserted").count() == 0


def test_documents(spark):
    words = spark.createDataFrame([("pear", "梨", None, "v", None), ("fig", "果", "p", None, "done")],
                                  "name_english string, name_chinese string, phonetic string, voice string, status string")
    docs = rows(sinks.dump(sinks.vocabulary_documents(words)), "_id")
    assert docs[1] == ("pear", '{"_id":"pear","name_chinese":"梨","name_english":"pear","phonetic":null,"status":"undo","voice":"v"}')
    assert '"status":"done"' in docs[0][1]
    assert sinks.vocabulary_documents(words.drop("status")).where("status = 'undo'").count() == 2


def test_outputs_by_kind(spark):
    got = {}
    sinks.write_outputs({"a": spark.range(2)}, {"a": lambda df: got.update(a=df.count()), "b": lambda df: got.update(b=1)})
    assert got == {"a": 2}
    with pytest.raises(ValueError):
        sinks.write_outputs({"c": spark.range(1)}, {})


def test_null_keys_and_null_orders(spark):
    stored = spark.createDataFrame([], "k string, v string, o long")
    incoming = spark.createDataFrame([(None, "n2", 7), (None, "n1", 3), ("a", "y", None), ("b", "late", None), ("b", "x", 5)], stored.schema)
    new = sinks.insert_if_absent(stored, incoming, "k", "o")
    assert sorted(map(tuple, new.collect()), key=repr) == sorted([(None, "n1", 3), ("a", "y", None), ("b", "x", 5)], key=repr)
    assert sinks.insert_if_absent(new, incoming, "k", "o").count() == 0
    assert sinks.existing_keys(incoming, new, "k").count() == 5 and sinks.missing_keys(incoming, new, "k").count() == 0
    once = sinks.upsert(new.drop("o"), incoming, "k", "o")
    assert sorted(map(tuple, once.collect()), key=repr) == sorted([(None, "n2", False), ("a", "y", False), ("b", "x", False)], key=repr)


def test_store_rewrites_touched_buckets_only(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("w", T.LongType())])
    store = sinks.KeyedStore(spark, shared_dir(spark, "store"), schema, "k", buckets=8)
    assert store.rows().count() == 0
    first = spark.createDataFrame([("a", 1, 1, 5), ("a", 2, 2, 4), ("b", 3, 3, 1), (None, 4, 4, None)], "k string, v long, w long, o long")
    touched = store.insert(first, "o")
    assert rows(store.rows(), F.col("k").asc_nulls_first()) == [(None, 4, 4), ("a", 2, 2), ("b", 3, 3)]
    assert store.insert(first, "o") == touched and store.rows().count() == 3
    again = store.upsert(spark.createDataFrame([("b", None, 1), ("b", 9, 0)], "k string, v long, o long"), "o")
    assert len(again) == 1 and rows(store.rows(), F.col("k").asc_nulls_first()) == [(None, 4, 4), ("a", 2, 2), ("b", None, 3)]
    versions = {(r.bucket, r.version) for r in spark.read.parquet(f"{store.path}/data").select("bucket", "version").distinct().collect()}
    assert sum(v == max(x for _, x in versions) for _, v in versions) == 1  # the last write made one bucket anew
    assert store.insert(first.limit(0), "o") == []


def test_a_write_that_breaks_off_is_not_read(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    store = sinks.KeyedStore(spark, shared_dir(spark, "store"), schema, "k", buckets=2)
    incoming = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v long, o long")
    store.insert(incoming, "o")
    left = spark.createDataFrame([("a", 77, b, 1) for b in range(2)], "k string, v long, bucket int, version long")
    left.write.mode("append").partitionBy("bucket", "version").parquet(f"{store.path}/data")  # never switched to
    assert rows(store.rows()) == [("a", 1), ("b", 2)]
    store.upsert(incoming.withColumn("v", F.col("v") + 10), "o")
    assert rows(store.rows()) == [("a", 11), ("b", 12)]


# -- attempts -------------------------------------------------------------------------------------------

def test_attempts(spark):
    log = spark.createDataFrame(
        [("late", i, s, f"b{i}") for i, s in enumerate([500, 404, 300, -1, 200], 1)]
        + [("second", 1, 500, "x"), ("second", 2, 299, "y"), ("second", 3, 200, "z"), ("zero", 1, 0, "n"), ("null", 1, None, "n")],
        "u string, attempt_no int, status int, body string")
    assert rows(attempts.resolve_attempts(log, "u"), "u") == [
        ("late", -1, False, 4, ""), ("null", -1, False, 1, ""), ("second", 299, True, 2, "y"), ("zero", 0, True, 1, "n")]
    assert rows(attempts.resolve_attempts(log, "u", retries=4).where("u = 'late'")) == [("late", 200, True, 5, "b5")]
    worse = attempts.resolve_attempts(log, "u", valid=lambda r: r.withColumn(
        "status", F.when(F.col("body") == "y", 500).otherwise(F.col("status"))))
    assert rows(worse.where("u = 'second'")) == [("second", 200, True, 3, "z")]
    assert rows(attempts.crawl_counts(log, "u"), "u") == [("late", 1, 4), ("null", 0, 1), ("second", 2, 1), ("zero", 1, 0)]
    good, bad = attempts.split_responses(log)
    assert good.count() + bad.count() == log.count() and good.count() == 4


def test_cookie_header(spark):
    jar = spark.createDataFrame([(1, " TSPD_101 ", "a "), (1, "TSPD_101", "a"), (1, "Hm_lvt_9", "z"), (1, "other", "n"),
                                 (2, "XHm_lvt_", "n")], "g int, name string, value string")
    assert rows(attempts.cookie_header(jar, "g")) == [(1, "Hm_lvt_9=z;TSPD_101=a;")]


def test_rows_up_to_the_marker(spark):
    df = spark.createDataFrame([("a", i, i in (3, 5)) for i in range(6)] + [("b", i, False) for i in range(3)],
                               "g string, o int, m boolean")
    assert rows(attempts.before_marker(df, ["g"], "o", F.col("m")).select("g", "o")) == [
        ("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2)]


# -- joins ----------------------------------------------------------------------------------------------

PAGES = [(1, "http://h/a", "<a href='/b?utm_x=1'>b</a><a href='/c#t'>c</a><a href='/none'>n</a>"),
         (2, "http://h/b?utm_y=2", "<a href='/c'>c</a><a href='/a'>a</a>"), (3, "http://h/c", "<a href='/a'>a</a>")]


def site(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_hops_keep_repeats_unless_visited(spark):
    pages = site(spark)
    seeds = spark.createDataFrame([("s", "http://h/a#x")], "seed string, link string")
    two = staged_crawl(seeds, pages, [page_links, page_links], ["seed"], canonical=True)
    assert sorted(r.link for r in two.collect()) == ["http://h/a", "http://h/a", "http://h/c"]
    seen = spark.createDataFrame([("http://h/b",)], "canonical string")
    rest = staged_crawl(seeds, pages, [page_links, page_links], ["seed"], seen, canonical=True)
    assert sorted(r.link for r in rest.collect()) == ["http://h/a"]
    # by request URL the cleaned link to /b finds no page
    assert sorted(r.link for r in staged_crawl(seeds, pages, [page_links, page_links], ["seed"]).collect()) == ["http://h/a"]


def test_each_page_told_by_its_query_is_reached_once(spark):
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/view.html?id="), "id").alias("url"))
    links = pages.select(F.col("page_id").alias("src"), F.concat("url", F.lit("#f")).alias("link"))
    hop = follow_links(links, pages)
    assert hop.count() == 100 and hop.where("src <> page_id").count() == 0
    assert follow_links(links, pages, canonical=True).where("page_id = 0").count() == 100
    files = spark.createDataFrame([(7, "http://h/a.pdf"), (8, "http://h/a.pdf#2")], "page_id long, url string")
    assert rows(follow_links(spark.createDataFrame([("http://h/a.pdf",)], "link string"), files)) == [("http://h/a.pdf", 7, "http://h/a.pdf")]


def test_pages_are_parsed_once_and_not_shuffled_per_link(spark):
    pages = site(spark)
    counted = spark.sparkContext.accumulator(0)

    def stage(reached):
        def look(batches):
            for b in batches:
                counted.add(b.num_rows)
                yield b
        return page_links(reached.mapInArrow(look, reached.schema))

    seeds = spark.createDataFrame([(str(i), "http://h/c") for i in range(50)], "seed string, link string")
    out = staged_crawl(seeds, pages, [stage], ["seed"])
    assert out.count() == 50 and counted.value == 1


def test_request_batches(spark):
    pages = site(spark).select("page_id", "url")
    asked = spark.createDataFrame([(9, ["http://h/c", "http://x/y", "http://h/a", "http://h/c#1", None], ["f1", "f2"])],
                                  "b int, urls array<string>, forms array<string>")
    got = indexed_batch(asked, request_batch(F.col("urls")), pages).select("b", "index", "method", "response_page", "status")
    assert rows(got, "index") == [(9, 0, "GET", 3, 200), (9, 1, "GET", None, -1), (9, 2, "GET", 1, 200), (9, 3, "GET", 3, 200), (9, 4, "GET", None, -1)]
    posts = indexed_batch(asked, request_batch(F.col("urls"), F.col("forms")), pages.withColumn("status", F.lit(404)))
    assert rows(posts.select("index", "method", "form_data", "response_page", "status"), "index") == [
        (0, "POST", "f1", 3, 404), (1, "POST", "f2", 3, 404)]


def test_all_kinds_of_references(spark):
    def attrs(tag, **values):
        m = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
        m = F.transform_keys(m, lambda k, v: F.replace(k, F.lit("_"), F.lit("-")))
        return spark.range(1).select(absolute_attrs(F.lit("http://h/d/e"), m, F.lit(tag)).alias("m")).first().m
    assert attrs("object", data="x", classid="y", codebase="/z", archive="p  q") == {
        "data": "http://h/d/x", "classid": "http://h/d/y", "codebase": "http://h/z", "archive": "http://h/d/p http://h/d/q"}
    assert attrs("meta", http_equiv="Refresh", content="3; URL='n'")["content"] == "3; URL=http://h/d/n"
    assert attrs("meta", name="x", content="3; URL=n")["content"] == "3; URL=n"
    assert attrs("button", formaction="?a")["formaction"] == "http://h/d/e?a"
    assert attrs("p", style="a:url( 'b.png' ) c")["style"] == "a:url( 'http://h/d/b.png' ) c"
    css = spark.range(1).select(absolute_style(F.lit("http://h/d/"), F.lit('@import "x.css"; b{c:url(y)}')).alias("c")).first().c
    assert css == '@import "http://h/d/x.css"; b{c:url(http://h/d/y)}'
    nodes = parse_nodes(spark.createDataFrame([("http://h/a/b", "<head><base href='../x/'><base href=/n></head>"), ("http://h/a", "<p>")], "url string, html string"))
    assert rows(nodes.select(base_url(F.col("url"), F.col("nodes")).alias("b")), "b") == [("http://h/a",), ("http://h/x/",)]


def test_absolute_attributes(spark):
    attrs = F.create_map(F.lit("href"), F.lit(" ../x "), F.lit("class"), F.lit("a/b"), F.lit("src"), F.lit("//i/j"))
    got = spark.range(1).select(absolute_attrs(F.lit("http://h/d/e/f"), attrs).alias("m")).first().m
    assert got == {"href": "http://h/d/x", "class": "a/b", "src": "http://i/j"}


def test_containment_two_ways(spark):
    nodes = node_table(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")).cache()
    outer = nodes.where("tag in ('nav', 'article', 'li')").select("page_id", "pre", "last")
    by_key = contained(nodes, outer).select("page_id", "outer_pre", "pre")
    spans = outer.select("page_id", F.col("pre").alias("outer_pre"), F.col("last").alias("z"))
    by_span = nodes.select("page_id", "pre").join(spans, "page_id").where("pre > outer_pre and pre <= z")
    assert rows(by_key) == rows(by_span.select("page_id", "outer_pre", "pre"))
    nodes.unpersist()


def test_links_two_ways(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = page_links(pages)
    tags = node_table(pages.select("page_id", "url", "html")).where("tag = 'a'")
    linked = with_canonical(tags.select("page_id", urls.url_resolve(F.col("url"), F.col("attrs")["href"]).alias("h")), "h", "link")
    assert rows(raw.select("page_id", F.regexp_replace("link", "&amp;", "&").alias("link"))) == rows(
        linked.select("page_id", "link").distinct())


# -- incremental runs -------------------------------------------------------------------------------------

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("o", T.LongType())])


def write(spark, where, values):
    spark.createDataFrame(values, SCHEMA).coalesce(1).write.mode("append").parquet(where)


def test_runs_take_new_files_only(spark):
    base = ingest.shared_dir(spark, "test")
    source, out, check = f"{base}/in", f"{base}/out", f"{base}/check"

    def run():
        stream = ingest.read_new(spark, source, SCHEMA, files_per_batch=1)
        ingest.insert_stream(stream, out, check, "k", "o").awaitTermination()
        return rows(ingest.stored_rows(spark, out, SCHEMA).select("k", "o"))

    write(spark, source, [("a", 1), ("b", 4), ("b", 2)])
    assert run() == [("a", 1), ("b", 2)]
    write(spark, source, [("a", 0), ("c", 5)])
    write(spark, source, [("c", 6), ("d", 7)])
    final = run()
    assert [k for k, _ in final] == ["a", "b", "c", "d"] and ("a", 1) in final
    assert run() == final


def test_replayed_batch_changes_nothing(spark):
    out = ingest.shared_dir(spark, "replay")
    put = ingest.absent_writer(out, "k", "o", SCHEMA, "s")
    first = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    second = spark.createDataFrame([("b", 9), ("c", 3)], SCHEMA)
    put(first, 0)
    put(second, 1)
    before = rows(ingest.stored_rows(spark, out, SCHEMA))
    put(second, 1)
    assert rows(ingest.stored_rows(spark, out, SCHEMA)) == before == [("a", 1, "s", 0), ("b", 2, "s", 0), ("c", 3, "s", 1)]


def test_a_new_checkpoint_loses_nothing(spark):
    base = ingest.shared_dir(spark, "test")
    write(spark, f"{base}/in", [("a", 1), ("b", 2)])
    write(spark, f"{base}/more", [("c", 3), ("a", 0)])
    for source, check in (("in", "one"), ("more", "two"), ("in", "three")):
        ingest.insert_stream(ingest.read_new(spark, f"{base}/{source}", SCHEMA), f"{base}/out", f"{base}/{check}", "k", "o").awaitTermination()
    assert rows(ingest.stored_rows(spark, f"{base}/out", SCHEMA).select("k", "o")) == [("a", 1), ("b", 2), ("c", 3)]


def test_first_seen_keeps_whole_rows(spark):
    base = ingest.shared_dir(spark, "seen")
    write(spark, f"{base}/in", [("a", 1), ("a", 1), ("b", 2)])
    ingest.run(ingest.first_seen(ingest.read_new(spark, f"{base}/in", SCHEMA), "k"), f"{base}/out", f"{base}/check").awaitTermination()
    assert rows(spark.read.parquet(f"{base}/out")) == [("a", 1), ("b", 2)]


def test_repeated_runs(spark):
    base = ingest.shared_dir(spark, "paced")
    write(spark, f"{base}/in", [("a", 1)])
    query = ingest.run(ingest.read_new(spark, f"{base}/in", SCHEMA), f"{base}/out", f"{base}/check", every="1 second")
    query.processAllAvailable()
    query.stop()
    assert rows(spark.read.parquet(f"{base}/out")) == [("a", 1)]


def test_bounded_state(spark):
    schema = T.StructType([*SCHEMA.fields, T.StructField("t", T.TimestampType())])
    base = ingest.shared_dir(spark, "bounded")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], SCHEMA).withColumn("t", F.timestamp_seconds(F.col("o")))
    df.coalesce(1).write.parquet(f"{base}/in")
    stream = ingest.first_seen(ingest.read_new(spark, f"{base}/in", schema), "k", "t", "1 hour")
    ingest.run(stream, f"{base}/out", f"{base}/check").awaitTermination()
    assert rows(spark.read.parquet(f"{base}/out").select("k")) == [("a",), ("b",)]


# -- plans ------------------------------------------------------------------------------------------------

def test_main_content_has_no_shuffle_on_large_input(spark, monkeypatch):
    monkeypatch.setattr("pagemill.sources.nodes.spread", lambda df, parts: df)
    text = plan(main_content(spark.read.parquet(f"{SF}/pages.parquet")))
    assert "Exchange" not in text and text.count("MapInArrow") == 2  # once in the tree, once in the details
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_hot_link_target_of_a_stored_site_is_split(spark):
    """The same through save_site: hops join ids by keys, so the buckets of the texts don't bind them."""
    name = "site_" + uuid.uuid4().hex
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.lit("x").alias("html"))
    stored = save_site(pages, name, ingest.shared_dir(spark, "site"), buckets=8)
    try:
        hot_target(spark, stored)
    finally:
        spark.sql(f"drop table {name}")


@pytest.mark.parametrize("name", ["page_links", "clean_url", "url_resolve", "headline_filter", "date_extract", "clean_title",
                                  "regex_single", "regex_many", "json_path", "json_items", "percent_encode", "cookie_map"])
def test_column_functions_stay_in_the_jvm_and_do_not_shuffle(spark, name):
    text = plan(all_queries()[name](spark, SF))
    assert not any(word in text for word in ("Exchange", "MapInArrow", "BatchEvalPython", "ArrowEvalPython"))


def test_attempts_are_limited_before_the_shuffle(spark):
    text = plan(all_queries()["resolve_attempts"](spark, SF))
    assert text.count("WindowGroupLimit") >= 4 and "Partial" in text


def test_inserts_combine_before_the_shuffle(spark):
    assert "partial_min_by" in plan(all_queries()["insert_if_absent"](spark, SF))


def test_stored_site_is_not_shuffled_again(spark):
    pages = site(spark)
    name = "site_" + uuid.uuid4().hex
    stored = save_site(pages, name, ingest.shared_dir(spark, "site"), buckets=8)
    seeds = spark.createDataFrame([("s", "http://h/a")], "seed string, link string")
    plans = []

    def stage(reached):
        plans.append(plan(reached))
        return page_links(reached)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hop = rows(staged_crawl(seeds, stored, [stage], ["seed"]))
        # ids are dealt out, texts stay in their buckets
        assert "SortMergeJoin" in plans[0] and not any("html" in x for x in re.findall(r"Exchange\n.*?\n\n", plans[0], re.S))
        assert hop == rows(staged_crawl(seeds, pages, [page_links], ["seed"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table {name}")


def hot_target(spark, pages):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    n = 60_000
    to = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000)
    links = spark.range(0, n, 1, 8).select(F.col("id").alias("src"), F.concat(F.lit("http://h/"), to, F.lit("#f")).alias("link"))
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hop = follow_links(links, pages).select("src", "page_id")
        hop.collect()
        assert "skew=true" in hop._jdf.queryExecution().executedPlan().toString()
        assert hop.count() == n and hop.where("page_id = 0").count() == links.where(F.col("link") == "http://h/0#f").count()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_hot_link_target_is_split(spark):
    """A third of the links lead to one page: AQE splits that partition, the result stays whole."""
    hot_target(spark, spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url")))


def test_small_rule_sets_are_broadcast(spark):
    from pagemill.sources.rules import Rule, rule_table
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    hosts = [r.site for r in host_rules(pages).collect()]
    joined = rule_page_join(pages, rule_table(spark, [Rule(h, "c", "s", f"http://{h}/") for h in hosts]))
    assert "BroadcastHashJoin" in plan(joined) and joined.count() == pages.count()


def test_several_rules_on_one_url_and_patterns_on_hosts(spark):
    from pagemill.sources.rules import Rule, rule_table
    pages = spark.createDataFrame([(1, "http://h/a?x=1"), (2, "http://h/b"), (3, "http://i/a")], "page_id long, url string")
    rules = rule_table(spark, [Rule("h", "one", "s", "http://h/a?x=1#top"), Rule("h", "two", "s", "http://h/a?x=1"), Rule("h", "three", "s", "http://h/")])
    assert rows(rule_page_join(pages, rules, by="url").select("page_id", "category")) == [(1, "one"), (1, "two")]
    assert rule_page_join(pages, rules).count() == 6
    some = rules.withColumn("pattern", F.when(F.col("category") == "one", "[?]x="))
    assert rows(rule_page_join(pages, some).select("page_id", "category").where("category = 'one'")) == [(1, "one")]


def test_tables_beyond_the_limit_are_not_broadcast(spark):
    rules = spark.range(100).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100).alias("v"))
    left = spark.range(1000).select((F.col("id") % 100).alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = (left.join(broadcast_if_small(rules, limit), "k") for limit in (1 << 20, 1000))
        assert "BroadcastHashJoin" in plan(small) and "BroadcastHashJoin" not in plan(large)
        assert small.count() == large.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_are_spread_as_the_caller_says(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    setting = spark.conf.get(PARSE_PARTITIONS)
    assert parse_nodes(pages).rdd.getNumPartitions() == int(setting)
    assert parse_nodes(pages, parts=3).rdd.getNumPartitions() == 3
    spark.conf.unset(PARSE_PARTITIONS)
    try:
        for size in ("1000", "128m"):  # whatever the size of the table
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert "Exchange" not in plan(parse_nodes(pages))
        assert parse_nodes(pages).count() == parse_nodes(pages, parts=3).count() == pages.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set(PARSE_PARTITIONS, setting)


def test_unclosed_anchors_take_no_more_time(spark):
    html = "<a href='/x'>" + "y" * 70 + "</a>" + "".join(f"<a href=/p{i}>" + "z" * 70 for i in range(4000))
    pages = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    page_links(pages.limit(0)).collect()
    begin = time.perf_counter()
    assert rows(page_links(pages).select("link")) == [("http://h/x",)]
    assert time.perf_counter() - begin < 5


def test_links_are_those_of_the_pattern_on_the_whole_page(spark):
    rnd = random.Random(8)
    parts = ["<a href=x", "<a ", "href='/y'", 'href="z"', ">", "</a>", "</A>", "t", "<A HREF=q>", "\n", "</a", "<b>"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 14))) for _ in range(3000)]
    pages = spark.createDataFrame([(i, "http://h/d/", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    found = {}
    for r in page_links(pages).collect():
        found.setdefault(r.page_id, set()).add(r.link)
    whole = {}
    refs = F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)))
    resolved = pages.select("page_id", "url", refs.alias("r")).select("page_id", urls.url_resolve(F.col("url"), strip(F.col("r"))).alias("l"))
    for r in with_canonical(resolved, "l", "link").collect():
        whole.setdefault(r.page_id, set()).add(r.link)
    assert found == whole


def test_queries_need_no_session_to_be_listed():
    assert len(all_queries()) > 70 and os.path.exists(SF)


def test_whitespace(spark):
    df = spark.createDataFrame([(" a\tb c　d\n",), (None,), ("",)], "t string")
    assert [r.t for r in df.select(squeeze_ws("t").alias("t")).collect()] == ["abcd", None, ""]
