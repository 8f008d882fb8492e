"""Sinks, joins, attempts and incremental runs (B, H, I, J, K, L, M)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagemill.functions.common import squeeze_ws
from pagemill.functions.urls import last_param, numbered_urls, url_host, url_resolve
from pagemill.operators import attempts as a
from pagemill.operators import sinks
from pagemill.operators.fields import attr_field, text_field
from pagemill.operators.items import ItemSpec, scope_items
from pagemill.operators.links import follow_links, indexed_batch, page_links, request_batch, request_url, staged_crawl
from pagemill.operators.select import Step, descend, find_all, select
from pagemill.plans.catalog import SQL_NAV, SQL_PAGE_LINKS, SQL_ROOT, query, sql_clean_url, sql_part, sql_squeeze
from pagemill.plans.scans import SQL_RULES, SQL_STATUS, event_status, site_rules
from pagemill.sources.nodes import parse_nodes
from pagemill.sources.pages import table
from pagemill.sources.rules import rule_page_join
from pagemill.sources.shared import shared_dir, written
from pagemill.streaming import ingest

# -- sinks: documents keyed by their text; the labelled ones are already stored --------------------

SQL_DOCS = "(select md5(text) as key, doc_id, lang, source from documents)"
SQL_STORED = "(select key from (select md5(text) as key, doc_id from documents) where doc_id in (select doc_id from labels))"


def keyed_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "doc_id", "lang", "source")


def stored_documents(spark, sf_dir):
    return keyed_documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("insert_if_absent", f"""
  select key, doc_id, lang, source from (
    select *, row_number() over (partition by key order by doc_id) as rn from {SQL_DOCS}) where rn = 1
  and key not in {SQL_STORED}""")
def insert_if_absent(spark, sf_dir):
    return sinks.insert_if_absent(stored_documents(spark, sf_dir), keyed_documents(spark, sf_dir), "key", "doc_id")


# NULL keys and NULL orders: customers keyed by a key that some lack, offered twice with orders that some lack
SQL_LOOSE = """
  select case when c_custkey % 7 = 0 then null else c_custkey % 50 end as key,
         case when c_custkey % 3 = 0 then null else c_custkey end as seq, c_name as name from customer"""


def loose_rows(spark, sf_dir):
    key = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 50)
    return table(spark, sf_dir, "customer").select(
        key.alias("key"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("seq"), F.col("c_name").alias("name"))


@query("insert_null_keys", f"""
  select key, seq, name from (select *, row_number() over (partition by key order by seq nulls last, name) as rn from ({SQL_LOOSE}))
  where rn = 1 and (key is null or key >= 10)""")
def insert_null_keys(spark, sf_dir):
    rows = loose_rows(spark, sf_dir)
    stored = rows.where("key < 10")
    new = sinks.insert_if_absent(stored, rows, "key", "seq")
    return new.unionByName(sinks.insert_if_absent(stored.unionByName(new), rows, "key", "seq"))  # again: adds nothing


@query("upsert_null_keys", f"""
  select key, first_name, name, false as inserted from (
    select *, row_number() over (partition by key order by seq nulls first, name) as up, row_number() over (partition by key order by seq desc nulls last, name desc) as down,
           first_value(name) over (partition by key order by seq nulls last, name) as first_name from ({SQL_LOOSE})) where down = 1""")
def upsert_null_keys(spark, sf_dir):
    rows = loose_rows(spark, sf_dir)
    stored = sinks.insert_if_absent(rows.limit(0), rows, "key", "seq").select("key", F.col("name").alias("first_name"))
    once = sinks.upsert(stored, rows, "key", "seq").drop("inserted")
    return sinks.upsert(once, rows, "key", "seq")


@query("keyed_store", f"""
  with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as up,
                    row_number() over (partition by o_custkey order by o_orderkey desc) as down from orders)
  select o_custkey as key, max(case when up = 1 then o_orderkey end) as first_order, max(case when down = 1 then o_totalprice end) as price
  from o group by o_custkey""")
def keyed_store(spark, sf_dir):
    """Orders written to a store by customer: the first one inserted, twice, then the last one's price written over it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("first_order"),
                                                   F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    store = sinks.KeyedStore(spark, shared_dir(spark, "store"), orders.drop("seq").schema, "key", buckets=16)
    for rows in (orders.where("key % 2 = 0"), orders):
        store.insert(rows, "seq")
    store.upsert(orders.select("key", "price", "seq"), "seq")
    return store.rows()


@query("existing_keys", f"select key, doc_id, lang, source from {SQL_DOCS} where key in {SQL_STORED}")
def existing_keys(spark, sf_dir):
    return sinks.existing_keys(keyed_documents(spark, sf_dir), stored_documents(spark, sf_dir), "key")


@query("upsert_merge", """
  select coalesce(c_custkey, o_custkey) as c_custkey, c_name, c_nationkey,
         case when o_custkey is null then c_acctbal when o_orderstatus = 'F' then null else o_totalprice end as c_acctbal,
         c_mktsegment, o_orderkey as last_order, c_custkey is null as inserted
  from customer full outer join (
    select * from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) where rn = 1)
  on c_custkey = o_custkey""")
def upsert_merge(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("c_acctbal"),
        F.col("o_orderkey").alias("last_order"), F.col("o_orderkey").alias("seq"))
    return sinks.upsert(table(spark, sf_dir, "customer"), changes, "c_custkey", "seq")


@query("doc_dump", """
  select c_name as _id, '{"_id":"' || c_name || '","name_chinese":"' || c_mktsegment || '","name_english":"' || c_name
    || '","phonetic":"' || c_nationkey || '","status":"' || case when c_acctbal < 0 then 'done' else 'undo' end || '","voice":null}' as document
  from customer""")
def doc_dump(spark, sf_dir):
    words = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name_english"), F.col("c_mktsegment").alias("name_chinese"),
        F.col("c_nationkey").cast("string").alias("phonetic"), F.lit(None).cast("string").alias("voice"),
        F.when(F.col("c_acctbal") < 0, "done").alias("status"))
    return sinks.dump(sinks.vocabulary_documents(words))


# -- joins ------------------------------------------------------------------------------------------

@query("rule_page_join", f"""
  select page_id, rule_id, site, category, subcategory from
    (select page_id, {sql_part('url', 2)} as host from pages) join ({SQL_RULES}) on host = site""")
def rule_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return rule_page_join(pages, site_rules(spark, sf_dir)).select("page_id", "rule_id", "site", "category", "subcategory")


@query("rules_per_url", """
  select page_id, kind, case when kind = 'mobile' then contains(url, '//m.') else true end as fits
  from pages, (select unnest(['all', 'mobile', 'other']) as kind) where kind <> 'mobile' or regexp_matches(url, '//m[.]')""")
def rules_per_url(spark, sf_dir):
    """Two rules for each URL, and one for the mobile pages of each host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    asked = pages.select(request_url(F.col("url")).alias("url")).distinct()
    exact = asked.select(F.concat("url", F.lit("#rule")).alias("url"), F.explode(F.array(F.lit("all"), F.lit("other"))).alias("kind"))
    mobile = pages.select(url_host(F.col("url")).alias("site")).distinct().select(
        "site", F.lit("http://any/").alias("url"), F.lit("mobile").alias("kind"), F.lit("//m[.]").alias("pattern"))
    both = rule_page_join(pages, exact, by="url").select("page_id", "kind", F.lit(True).alias("fits")).unionByName(
        rule_page_join(pages, mobile).select("page_id", "kind", F.col("url").contains("//m.").alias("fits")))
    return both


# The stored pages, and for each a view of it told by its query only, a file, and a tracked address of the same page.
SQL_SITE = f"""
  select page_id, url from pages
  union all select 1000000 + page_id, {SQL_ROOT} || '/view.html?id=' || page_id from pages
  union all select 2000000 + page_id, {SQL_ROOT} || '/file' || page_id || '.pdf' from pages
  union all select 3000000 + page_id, split_part(url, '#', 1) || case when contains(url, '?') then '&' else '?' end || 'utm_x=1' from pages"""
# Every page links to the page with half its number, once tracked, once untracked and once with a fragment, to its host's
# first page, to its own view and file, and to nothing.
SQL_EDGES = f"""
  with site as (select page_id, url, {sql_part('url', 2)} as host, {SQL_ROOT} as root from pages)
  select p.page_id as src_page, unnest([split_part(t.url, '#', 1) || case when contains(t.url, '?') then '&' else '?' end || 'utm_x=1',
      split_part(t.url, '#', 1) || case when contains(t.url, '?') then '&' else '?' end || 'utm_x=2',
      split_part(t.url, '#', 1) || '#end', h.url, p.root || '/view.html?id=' || p.page_id, p.root || '/file' || p.page_id || '.pdf',
      'http://missing.example.org/']) as link
  from site p join site t on t.page_id = p.page_id // 2
  join (select host, arg_min(url, page_id) as url from site group by host) h on h.host = p.host"""


def site_root():
    return F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)


def tracked(url, value):
    bare = F.substring_index(url, "#", 1)
    return F.concat(bare, F.when(F.col(url).contains("?"), "&").otherwise("?"), F.lit(f"utm_x={value}"))


def hop_site(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    more = [(1_000_000, F.concat(site_root(), F.lit("/view.html?id="), "page_id")),
            (2_000_000, F.concat(site_root(), F.lit("/file"), "page_id", F.lit(".pdf"))), (3_000_000, tracked("url", 1))]
    every = F.array(F.struct("page_id", "url"), *(F.struct((F.col("page_id") + n).alias("page_id"), u.alias("url")) for n, u in more))
    return pages.select(F.inline(every))


def edges(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    to = pages.select(F.col("page_id").alias("to_page"), F.col("url").alias("to_url"))
    half = pages.select(F.col("page_id").alias("src_page"), site_root().alias("root"), F.expr("page_id div 2").alias("to_page")).join(to, "to_page")
    halves = half.select("src_page", F.explode(F.array(
        tracked("to_url", 1), tracked("to_url", 2), F.concat(F.substring_index("to_url", "#", 1), F.lit("#end")),
        F.concat("root", F.lit("/view.html?id="), "src_page"), F.concat("root", F.lit("/file"), "src_page", F.lit(".pdf")),
        F.lit("http://missing.example.org/"))).alias("link"))
    on_host = pages.withColumn("host", url_host(F.col("url")))
    first = on_host.groupBy("host").agg(F.min_by("url", "page_id").alias("link"))
    return halves.unionByName(on_host.join(first, "host").select(F.col("page_id").alias("src_page"), "link"))


@query("follow_links", f"""
  select src_page, link, dst_page from (select src_page, link, split_part(link, '#', 1) as to_url from ({SQL_EDGES}))
    join (select split_part(url, '#', 1) as key, min(page_id) as dst_page from ({SQL_SITE}) group by key) on to_url = key""")
def follow(spark, sf_dir):
    hops = follow_links(edges(spark, sf_dir), hop_site(spark, sf_dir))
    return hops.select("src_page", "link", F.col("page_id").alias("dst_page"))


@query("follow_canonical", f"""
  select src_page, link, dst_page from (select src_page, link, {sql_clean_url('link')} as to_url from ({SQL_EDGES}))
    join (select key, min(page_id) as dst_page from (select {sql_clean_url('url')} as key, page_id from ({SQL_SITE})) group by key) on to_url = key""")
def follow_canonical(spark, sf_dir):
    hops = follow_links(edges(spark, sf_dir), hop_site(spark, sf_dir), canonical=True)
    return hops.select("src_page", "link", F.col("page_id").alias("dst_page"))


@query("follow_stream", """
  select a.page_id as src_page, b.url as link, b.page_id as dst_page from pages a join pages b
  on b.page_id in (a.page_id // 2, (5 * a.page_id + 3) % (select count(*) from pages))""")
def follow_stream(spark, sf_dir):
    """Pages that arrive in three drops, their links followed as they come: links of old pages to new ones too."""
    base = shared_dir(spark, "follow-stream")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    counted = pages.withColumn("n", F.expr("count(*) over ()"))
    spread = counted.select("page_id", "url", F.explode(F.array_distinct(F.array(F.expr("page_id div 2"), (5 * F.col("page_id") + 3) % F.col("n")))).alias("to"))
    to = pages.select(F.col("page_id").alias("to"), F.col("url").alias("to_url"))
    anchors = F.array_join(F.transform(F.sort_array(F.collect_set("to_url")), lambda u: F.concat(
        F.lit('<a href="'), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit('">x</a>'))), "")
    made = written(spread.join(to, "to").groupBy("page_id", "url").agg(anchors.alias("html")), f"{base}/pages")
    for number in range(3):
        made.where(F.col("page_id") % 3 == number).coalesce(1).write.mode("append").parquet(f"{base}/drops")

    def links_of(batch):
        refs = attr_field("href", find_all("a")).extract(F.col("nodes"))["value"]
        return parse_nodes(batch).select(F.col("page_id").alias("src_page"), F.explode(refs).alias("link"))

    stream = ingest.read_new(spark, f"{base}/drops", ingest.PAGE_TYPE, files_per_batch=1)
    ingest.follow_stream(stream, links_of, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    hops = spark.read.schema("src_page long, link string, page_id long, page_url string").parquet(f"{base}/out/hops")
    return hops.select("src_page", "link", F.col("page_id").alias("dst_page"))


def word_site(spark, sf_dir):
    """A three-level site derived from the pages: start page, chapter list, one word list per chapter."""
    pages = table(spark, sf_dir, "pages")
    root = F.concat(F.lit("http://"), url_host(F.col("url")), F.lit("/"))
    start = pages.select((F.col("page_id") * 1000).alias("page_id"), F.concat(root, F.lit("start?id="), "page_id").alias("url"), F.concat(
        F.lit('<p><a href="/?action=courses&amp;classid='), "page_id", F.lit('">go</a><a href="/x">x</a>')).alias("html"))
    chapters = pages.select((F.col("page_id") * 1000 + 1).alias("page_id"),
                            F.concat(root, F.lit("?action=courses&classid="), "page_id").alias("url"), "html")
    words = F.transform(F.regexp_extract_all("html", F.lit("<a href=[^>]*>([^<]*)</a>"), F.lit(1)), lambda w, i: F.struct(
        (F.col("page_id") * 1000 + 2 + i).alias("page_id"), F.concat(root, F.lit("?action=words&class="), F.col("page_id"), F.lit("&course="), i + 1).alias("url"),
        F.concat(F.lit('<ul class="words"><li><b title="'), w, F.lit('"></b><i>'), i + 1,
                 F.lit('</i></li><li>no title</li><li><b title="late"></b><i>9</i></li></ul>')).alias("html")))
    lists = pages.select(F.inline(words))
    return start, start.unionByName(chapters).unionByName(lists)


# Links of a site with circles: page p of n leads to 3p + 1, 7p + 2, p / 2 (modulo n) and itself, each twice.
_RING = "select page_id as p, unnest([(3 * page_id + 1) % n, (7 * page_id + 2) % n, page_id // 2, page_id]) as q from pages, (select count(*) as n from pages)"


@query("crawl_once", f"""
  with e as ({_RING}), l0 as (select page_id as p, page_id as seed from pages where page_id % 25 = 0),
  l1 as (select q as p, min(seed) as seed from l0 join e using (p) where q not in (select p from l0) group by q),
  l2 as (select q as p, min(seed) as seed from l1 join e using (p) where q not in (select p from l0 union all select p from l1) group by q),
  l3 as (select q as p, min(seed) as seed from l2 join e using (p)
         where q not in (select p from l0 union all select p from l1 union all select p from l2) group by q)
  select p as page_id, seed from l3""")
def crawl_once(spark, sf_dir):
    """The pages first reached at the third hop of a crawl that takes no page twice, with the least seed that leads there."""
    ids = table(spark, sf_dir, "pages").select("page_id").withColumn("n", F.expr("count(*) over ()"))
    to = F.array((3 * F.col("page_id") + 1) % F.col("n"), (7 * F.col("page_id") + 2) % F.col("n"), F.expr("page_id div 2"), F.col("page_id"))
    anchors = F.array_join(F.transform(F.concat(to, to), lambda q: F.concat(F.lit('<a href="/p/'), q.cast("string"), F.lit('">x</a>'))), "")
    pages = written(ids.select("page_id", F.concat(F.lit("http://ring/p/"), "page_id").alias("url"), anchors.alias("html")), f"{shared_dir(spark, 'ring')}/pages")

    def links(reached):
        refs = attr_field("href", find_all("a")).extract(F.col("nodes"))["value"]
        return parse_nodes(reached).select("page_id", F.explode(F.transform(refs, lambda r: url_resolve(F.col("url"), r))).alias("link"))

    seeds = pages.where("page_id % 25 = 0").select(F.col("page_id").alias("seed"), F.col("url").alias("link"))
    last = lambda reached: reached.select("page_id", F.col("page_id").alias("found"))
    hops = staged_crawl(seeds, pages, [links, links, links, last], ["seed"], dedupe_frontier=True)
    return hops.select(F.col("found").alias("page_id"), "seed")


@query("three_stage", f"select page_id as seed, pos::varchar as course, {sql_squeeze('txt')} as word from ({SQL_NAV})")
def three_stage(spark, sf_dir):
    start, site = word_site(spark, sf_dir)
    nodes = F.col("nodes")

    def chapter_links(pages):
        refs = attr_field("href", find_all("a", {"href": re.compile("action=courses&classid=")})).extract(nodes)["value"]
        return parse_nodes(pages).select("page_id", F.explode(F.transform(
            refs, lambda r: url_resolve(F.col("url"), r))).alias("link"))

    def word_links(pages):
        count = F.size(select(nodes, descend(Step("nav"), Step("li"))))
        host = url_host(F.col("url"))
        urls = numbered_urls("?action=words&class=%s&course=%s", last_param(F.col("url")), count)
        return parse_nodes(pages).select("page_id", F.explode(F.transform(
            urls, lambda u: F.concat(F.lit("http://"), host, F.lit("/"), u))).alias("link"))

    def records(pages):
        spec = ItemSpec(scope=descend(Step(classes=("words",)), Step("li")), fields={
            "word": attr_field("title", find_all("b"), many=False),
            "course": text_field(find_all("i"), many=False)}, clean={"word": squeeze_ws})
        return scope_items(parse_nodes(pages.drop("url")), spec, strict=True).select("page_id", "course", "word")

    seeds = start.select(F.expr("page_id div 1000").alias("seed"), F.col("url").alias("link"))
    return staged_crawl(seeds, site, [chapter_links, word_links, records], ["seed"])


@query("indexed_batch", f"""
  select src_page, idx, dst_page, case when dst_page is null then -1 else 200 end as status from (
    select page_id as src_page, u.i::int as idx, [url, 'http://missing.example.org/' || page_id, split_part(url, '#', 1) || '#x',
             {SQL_ROOT} || '/file' || page_id || '.pdf', {SQL_ROOT} || '/view.html?id=' || page_id][u.i + 1] as link
    from pages, (select unnest([0, 1, 2, 3, 4]) as i) u)
    left join (select split_part(url, '#', 1) as key, min(page_id) as dst_page from ({SQL_SITE}) group by key) on split_part(link, '#', 1) = key""")
def batches(spark, sf_dir):
    asked = table(spark, sf_dir, "pages").select(F.col("page_id").alias("src_page"), F.array(
        "url", F.concat(F.lit("http://missing.example.org/"), "page_id"), F.concat(request_url(F.col("url")), F.lit("#x")),
        F.concat(site_root(), F.lit("/file"), "page_id", F.lit(".pdf")),
        F.concat(site_root(), F.lit("/view.html?id="), "page_id")).alias("urls"))
    rows = indexed_batch(asked, request_batch(F.col("urls")), hop_site(spark, sf_dir))
    return rows.select("src_page", F.col("index").alias("idx"), F.col("response_page").alias("dst_page"), "status")


@query("form_requests", """
  select conv_id, turn, 'POST' as method, 'http://forms.example.org/' || conv_id as url, md5(text) as form from conversations""")
def form_requests(spark, sf_dir):
    forms = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array(F.concat(F.lit("http://forms.example.org/"), "conv_id")).alias("urls"),
        F.array("text").alias("forms"))
    rows = forms.select("conv_id", "turn", F.inline(request_batch(F.col("urls"), F.col("forms"))))
    return rows.select("conv_id", "turn", "method", "url", F.md5("form_data").alias("form"))


# -- attempts: each event is one fetch of its user's page ---------------------------------------------

SQL_ATTEMPTS = f"""
  select * from (select user_id, {SQL_STATUS} as status, props as body,
                        row_number() over (partition by user_id order by ts, event_id) as attempt_no from events)
  where attempt_no <= 4"""
_OK = "(status = 0 or status between 200 and 299)"


def sql_resolved(source):
    return f"""
  select user_id, coalesce(arg_min(status, attempt_no) filter ({_OK}), -1)::int as status, count(*) filter ({_OK}) > 0 as ok,
         coalesce(min(attempt_no) filter ({_OK}), count(*)) as attempts,
         coalesce(arg_min(body, attempt_no) filter ({_OK}), '') as body from ({source}) group by user_id"""


def attempt_log(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", event_status().alias("status"),
                                                F.col("props").alias("body"))
    return a.numbered_attempts(log, "user_id", ["ts", "event_id"])


@query("resolve_attempts", sql_resolved(SQL_ATTEMPTS))
def resolve_attempts(spark, sf_dir):
    return a.resolve_attempts(attempt_log(spark, sf_dir), "user_id")


_TOO_HIGH = "regexp_extract(body, '[0-9]+', 0)::int >= 20"


@query("validated_attempts", sql_resolved(
    f"select * replace (case when {_TOO_HIGH} then 502 else status end as status) from ({SQL_ATTEMPTS})"))
def validated_attempts(spark, sf_dir):
    def valid(responses):
        k = F.get_json_object("body", "$.k").cast("int")
        return responses.withColumn("status", F.when(k >= 20, 502).otherwise(F.col("status")))

    return a.resolve_attempts(attempt_log(spark, sf_dir), "user_id", valid=valid)


@query("crawl_counts", f"""
  select user_id, count(*) filter ({_OK}) as succeeded, count(*) filter (not {_OK}) as failed
  from (select user_id, {SQL_STATUS} as status from events) group by user_id""")
def crawl_counts(spark, sf_dir):
    return a.crawl_counts(table(spark, sf_dir, "events").select("user_id", event_status().alias("status")), "user_id")


@query("split_responses", f"""
  select event_id, status, case when {_OK} then 'succeeded' else 'failed' end as outcome
  from (select event_id, {SQL_STATUS} as status from events)""")
def split_responses(spark, sf_dir):
    good, bad = a.split_responses(table(spark, sf_dir, "events").select("event_id", event_status().alias("status")))
    return good.withColumn("outcome", F.lit("succeeded")).unionByName(bad.withColumn("outcome", F.lit("failed")))


_COOKIE = """case event_type when 'view' then 'TSPD_101' when 'click' then 'Hm_lvt_' || (user_id % 3)
  when 'signup' then ' WASSESSION ' when 'error' then 'TSPD_1011' else 'Hm_lpvt_x' end"""


@query("kv_listagg", f"""
  select user_id, string_agg(part, '' order by part) as header from (
    select distinct user_id, trim(name) || '=' || value || ';' as part
    from (select user_id, {_COOKIE} as name, regexp_extract(props, '[0-9]+', 0) as value from events)
    where trim(name) in ('TSPD_101', 'TS01d02f4c', 'WASSESSION') or starts_with(trim(name), 'Hm_lvt_') or starts_with(trim(name), 'Hm_lpvt_'))
  group by user_id""")
def kv_listagg(spark, sf_dir):
    jar = table(spark, sf_dir, "events").selectExpr(
        "user_id", f"{_COOKIE} as name", "get_json_object(props, '$.k') as value")
    return a.cookie_header(jar, "user_id")


@query("drop_after_marker", """
  select conv_id, turn, role from (
    select conv_id, turn, role, min(case when contains(text, ',') then turn end) over (partition by conv_id) as stop from conversations)
  where stop is null or turn <= stop""")
def drop_after_marker(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return a.before_marker(rows, ["conv_id"], "turn", F.col("text").contains(",")).select("conv_id", "turn", "role")


# -- incremental runs ---------------------------------------------------------------------------------

@query("stream_ingest", SQL_PAGE_LINKS)
def stream_ingest(spark, sf_dir):
    base = ingest.shared_dir(spark, "links")
    stream = page_links(ingest.read_new(spark, f"{sf_dir}/pages.parquet", ingest.PAGE_TYPE))
    ingest.run(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("stream_insert_if_absent", f"""
  select key, doc_id, lang, source from (
    select *, row_number() over (partition by key order by doc_id) as rn from {SQL_DOCS}) where rn = 1""")
def stream_insert(spark, sf_dir):
    base = ingest.shared_dir(spark, "documents")
    path = f"{sf_dir}/documents.parquet"
    stream = ingest.read_new(spark, path, spark.read.parquet(path).schema).select(
        F.md5("text").alias("key"), "doc_id", "lang", "source")
    ingest.insert_stream(stream, f"{base}/out", f"{base}/checkpoint", "key", "doc_id").awaitTermination()
    return ingest.stored_rows(spark, f"{base}/out", stream.schema).drop("stream", "batch")


@query("stream_two_writers", "select doc_id, lang from documents")
def stream_two_writers(spark, sf_dir):
    """Two streams with checkpoints of their own into one store, the first of half the rows; nothing stored is lost."""
    base = ingest.shared_dir(spark, "writers")
    path = f"{sf_dir}/documents.parquet"
    rows = ingest.read_new(spark, path, spark.read.parquet(path).schema).select("doc_id", "lang")
    for name, stream in (("a", rows.where("doc_id % 2 = 0")), ("b", rows)):
        ingest.insert_stream(stream, f"{base}/out", f"{base}/checkpoint-{name}", "doc_id", "lang").awaitTermination()
    return ingest.stored_rows(spark, f"{base}/out", rows.schema).drop("stream", "batch")


@query("stream_dedupe", "select user_id, 1::bigint as n from events group by user_id")
def stream_dedupe(spark, sf_dir):
    """Whole first rows per user; counted are those that are stored events, column by column."""
    base = ingest.shared_dir(spark, "users")
    path = f"{sf_dir}/events.parquet"
    stream = ingest.first_seen(ingest.read_new(spark, path, spark.read.parquet(path).schema), "user_id")
    ingest.run(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    seen = spark.read.schema(stream.schema).parquet(f"{base}/out")
    return seen.join(spark.read.parquet(path), seen.columns, "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))
