"""Extraction rules as data: registry, seeds and the join to pages."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.common import java_pattern, let
from pagemill.functions.urls import dated_url, url_host
from pagemill.operators.fields import Field
from pagemill.operators.links import request_url
from pagemill.operators.rule_fields import FIELD_TYPE, PROGRAM_TYPE, field_row, field_values, program_values, runs_of
from pagemill.sources.nodes import parse_nodes

RULE_TYPE = T.StructType([
    T.StructField("rule_id", T.LongType()),
    T.StructField("site", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("fields", T.ArrayType(FIELD_TYPE)),  # one per stage
])


@dataclass(frozen=True)
class Rule:
    """Where to start and which fields to take, in stage order."""

    site: str
    category: str
    subcategory: str
    url: str
    selectors: tuple[Field, ...] = field(default=(), compare=False)

    def dump(self) -> dict:
        return {name: getattr(self, name) for name in ("category", "selectors", "site", "subcategory", "url")}


def rule_table(spark: SparkSession, rules: Iterable[Rule], run_date: dt.date | None = None) -> DataFrame:
    """Rules as a table, their fields and selectors in it, numbered in the order given; equal rules stay separate.

    With a run date, ``%s`` in a URL becomes its year (F7).
    """
    rows = [(i, r.site, r.category, r.subcategory, r.url, [field_row(f) for f in r.selectors]) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, RULE_TYPE)
    if run_date is not None:
        table = table.withColumn("url", dated_url(F.col("url"), run_date))
    return table


def host_rules(pages: DataFrame) -> DataFrame:
    """A registry derived from a page table: one rule per host, named after its first page."""
    host = url_host(F.col("url"))
    sites = pages.groupBy(host.alias("site")).agg(F.min("page_id").alias("rule_id"))
    kind = F.regexp_extract("site", r"\.([a-z]+)$", 1)
    return sites.select(
        "rule_id", "site",
        F.when(kind == "com", "news").when(kind == "org", "notice").otherwise("words").alias("category"),
        F.when(F.col("site").startswith("blog."), "blog").when(F.col("site").startswith("m."), "mobile")
        .when(F.col("site").startswith("www."), "main").otherwise("other").alias("subcategory"),
        F.concat(F.lit("http://"), "site", F.lit("/archive/%s/index.html")).alias("url"))


def seed_frontier(rules: DataFrame, default_url: str) -> DataFrame:
    """One request per rule carrying the rule; a default request when there are no rules."""
    request = [F.lit("GET").alias("method"), F.lit("parse").alias("stage")]
    seeds = rules.select("url", *request, "rule_id", "site", "category", "subcategory")
    empty = rules.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit(default_url).alias("url"), *request, F.lit(None).cast("long").alias("rule_id"),
        *(F.lit(None).cast("string").alias(c) for c in ("site", "category", "subcategory")))
    return seeds.unionByName(empty)


def rule_page_join(pages: DataFrame, rules: DataFrame, by: str = "host") -> DataFrame:
    """Pages with each of their rules; rules without a page and pages without a rule drop out.

    by="url": a rule is for the page it names, whatever the fragment.
    by="host": a rule is for the pages of its site, or those of them whose URL
    its ``pattern`` is found in, where the table has such a column.

    A registry is a stored table of known size, so Spark sends it to the pages
    when it is small; nothing runs while the query is built.
    """
    of_rule = rules.withColumnRenamed("url", "rule_url")
    if by == "url":
        keyed, key = pages.withColumn("_key", request_url(F.col("url"))), request_url(F.col("rule_url"))
    else:
        keyed, key = pages.withColumn("_key", url_host(F.col("url"))), F.col("site")
    on = F.col("_key") == key
    if by == "host" and "pattern" in rules.columns:
        on = on & (F.col("pattern").isNull() | (F.regexp_instr(F.col("url"), F.col("pattern")) > 0))
    return keyed.join(of_rule, on).drop("_key")


def required_word(pattern: str | re.Pattern) -> str | None:
    """The longest whole word, in lower case, that every URL with a match of the pattern has; None if it names none.

    Words are runs of ASCII letters and digits. What a pattern says outside
    brackets and choices is looked at; a word counts if what stands on both its
    sides there is a character of no word, or the URL's end.
    """
    compiled = re.compile(pattern) if isinstance(pattern, str) else pattern
    pieces, here = [], ""
    for op, value in parser.parse(compiled.pattern, compiled.flags & ~re.U):
        name = str(op)
        if name == "LITERAL":
            here += chr(value)
        elif name == "AT" and str(value) in ("AT_BEGINNING_STRING", "AT_END_STRING") or (name == "AT" and str(value) == "AT_BEGINNING" and not compiled.flags & re.M):
            here += "\0"
        else:
            pieces, here = [*pieces, here], ""
    words = [w for p in [*pieces, here] for w in re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", p) 
             # without regard to case these two letters also stand for others than a-z
             if not (compiled.flags & re.I and set("ksKS") & set(w))]
    return max(words, key=len, default=None) and max(words, key=len).lower()


def pattern_table(spark: SparkSession, patterns: Iterable[tuple[int, str]]) -> DataFrame:
    """rule_id, pattern (in the JVM's notation) and required word of each rule's URL pattern."""
    rows = [(k, java_pattern(p), required_word(p)) for k, p in patterns]
    return spark.createDataFrame(rows, "rule_id long, pattern string, word string")


def pages_by_pattern(pages: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """Each page with the rules whose pattern is found in its URL (C3, H1), the page's columns and rule_id.

    A page meets the patterns of the words of its URL by an equi-join, and only
    those run. Patterns without such a word are run on every URL; they travel as
    one array that each page looks through.
    """
    words = F.array_distinct(F.regexp_extract_all(
        F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), F.lit(0)))
    hit = lambda pattern: F.regexp_instr(F.col(url), pattern) > 0
    keyed = pages.withColumn("_word", F.explode(words))
    named = patterns.where("word is not null").select("rule_id", F.col("pattern").alias("_pattern"), F.col("word").alias("_of"))
    found = keyed.join(named, F.col("_word") == F.col("_of")).where(hit(F.col("_pattern"))).select(*pages.columns, "rule_id")
    free = patterns.where("word is null").agg(F.collect_list(F.struct("rule_id", F.col("pattern").alias("_pattern")))).scalar()
    anywhere = pages.withColumn("_free", free).select(*pages.columns, F.explode(F.transform(
        F.filter("_free", lambda r: hit(r["_pattern"])), lambda r: r["rule_id"])).alias("rule_id"))
    return found.unionByName(anywhere)


def extract_by_rule(ruled: DataFrame, stage: int) -> DataFrame:
    """The stage's field of each row's own rule, one row per value (text, attr).

    ``ruled`` has nodes and the rule's ``fields``.  The selectors are data of
    the row, so one expression serves any number of rules.  Rows whose rule
    has no such stage give no rows.
    """
    field = F.get("fields", F.lit(stage))
    values = let(field, lambda f: F.when(f.isNotNull(), field_values(F.col("nodes"), f)))
    keep = [c for c in ruled.columns if c not in ("nodes", "fields")]
    return ruled.select(*keep, F.inline(values))


def _program(fields: Column) -> Column:
    """Different fields as one program: the beginnings of all their selectors, each before what goes on from it."""
    def beginnings(f: Column) -> Column:
        return let(runs_of(f["steps"]), lambda runs: F.transform(runs, lambda _, k: F.slice(runs, F.lit(1), k + 1)))

    def build(paths: Column) -> Column:
        trie = F.transform(paths, lambda p: F.struct(
            (F.array_position(paths, F.slice(p, F.lit(1), F.size(p) - 1)) - 1).cast("int").alias("parent"), F.element_at(p, -1).alias("run")))
        ends = F.transform(fields, lambda f: F.struct(
            (F.array_position(paths, runs_of(f["steps"])) - 1).cast("int").alias("end"), f.alias("field")))
        return F.struct(trie.alias("trie"), ends.alias("fields")).cast(PROGRAM_TYPE)

    return let(F.array_distinct(F.flatten(F.transform(fields, beginnings))), build)


def site_programs(rules: DataFrame, stage: int) -> DataFrame:
    """One row per site: ``rules`` (columns of each rule and the place of its field) and the ``program`` of all their fields."""
    field = F.get("fields", F.lit(stage))
    names = [c for c in rules.columns if c not in ("fields", "site")]
    sites = rules.where(field.isNotNull()).groupBy("site").agg(F.collect_list(F.struct(*names, field.alias("_field"))).alias("given"))
    sites = sites.withColumn("different", F.array_distinct(F.transform("given", lambda r: r["_field"])))
    ruled = F.transform("given", lambda r: F.struct(
        *(r[n].alias(n) for n in names), (F.array_position("different", r["_field"]) - 1).cast("int").alias("_place")))
    return sites.select("site", ruled.alias("rules"), _program(F.col("different")).alias("program"))


def extract_rules(pages: DataFrame, rules: DataFrame, stage: int) -> DataFrame:
    """The stage's field of every rule of a page's host, one row per value (text, attr), with the rule's and the page's columns.

    A page is parsed once whatever its rules; what selectors have in common is
    looked for once, and a field that several rules have is taken once. A rule
    with a ``pattern`` is for the URLs it is found in. A rule without the stage,
    or whose field finds nothing and has no fallback, gives no rows.
    """
    programs = site_programs(rules, stage)
    keep = [c for c in pages.columns if c != "html"]
    names = [c for c in rules.columns if c not in ("fields", "site", "url", *keep)]
    keyed = pages.withColumn("_site", url_host(F.col("url")))
    # the rules meet the nodes: they needn't go through the parser
    wanted = keyed.join(rules.where(F.get("fields", F.lit(stage)).isNotNull()).select("site"), F.col("_site") == F.col("site"), "left_semi")
    parsed = parse_nodes(wanted).join(programs, F.col("_site") == F.col("site"))

    def rows(values: Column) -> Column:
        ruled = F.col("rules")
        if "pattern" in rules.columns:
            ruled = F.filter(ruled, lambda r: r["pattern"].isNull() | (F.regexp_instr(F.col("url"), r["pattern"]) > 0))
        return F.flatten(F.transform(ruled, lambda r: F.transform(
            F.coalesce(F.get(values, r["_place"]), F.array()), lambda v: F.struct(
                *(r[n].alias(n) for n in names), v["text"].alias("text"), v["attr"].alias("attr")))))

    return parsed.select(*keep, "site", F.inline(let(program_values(F.col("nodes"), F.col("program")), rows)))
