"""Scans, predicates, scalar functions, regex and JSON (A, C, E, F)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from pagemill.functions import jsonpath, text, urls
from pagemill.functions.common import squeeze_ws
from pagemill.operators import json_items
from pagemill.operators.attempts import is_ok
from pagemill.operators.fields import attr_field, attr_text_field, text_field
from pagemill.operators.links import extract_links, page_links
from pagemill.operators.select import Step, descend, find_all
from pagemill.plans.catalog import (SQL_PAGE_LINKS, query, sql_binary, sql_clean_url, sql_part, sql_squeeze)
from pagemill.sources.pages import cookie_map, page_records, table
from pagemill.sources.rules import Rule, host_rules, pages_by_pattern, pattern_table, rule_table, seed_frontier
from pagemill.sources.shared import shared_dir, written

SQL_RULES = f"""
  select min(page_id) as rule_id, site,
         case regexp_extract(site, '\\.([a-z]+)$', 1) when 'com' then 'news' when 'org' then 'notice'
              else 'words' end as category,
         case when starts_with(site, 'blog.') then 'blog' when starts_with(site, 'm.') then 'mobile'
              when starts_with(site, 'www.') then 'main' else 'other' end as subcategory,
         'http://' || site || '/archive/%s/index.html' as url
  from (select page_id, {sql_part('url', 2)} as site from pages) group by site"""


@query("page_scan", "select page_id, url, 'GET' as method, -1 as status, length(html)::bigint as n_chars from pages")
def page_scan(spark, sf_dir):
    return page_records(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "method", "status", F.length("html").cast("bigint").alias("n_chars"))


# the field of each category of sites
SITE_FIELDS = {
    "news": attr_text_field("href", descend(Step("nav"), Step("li"), Step("a"))),
    "words": attr_field("href", find_all("a"), many=False),
    "notice": text_field(find_all(["h1", "h2"])),
}


def site_rules(spark, sf_dir):
    """One rule per host with its category's field, stored as a registry is."""
    kinds = rule_table(spark, [Rule("any", name, "", "", (field,)) for name, field in SITE_FIELDS.items()])
    rules = host_rules(table(spark, sf_dir, "pages").select("page_id", "url"))
    return written(rules.join(F.broadcast(kinds.select("category", "fields")), "category"), shared_dir(spark, "rules"))


@query("rule_registry", f"""
  select rule_id, site, category, subcategory, url,
         case category when 'news' then 'attr_text' when 'words' then 'attr' else 'text' end as kind from ({SQL_RULES})""")
def rule_registry(spark, sf_dir):
    return site_rules(spark, sf_dir).select("rule_id", "site", "category", "subcategory", "url", F.get("fields", F.lit(0))["kind"].alias("kind"))


@query("seed_frontier", f"select url, 'GET' as method, 'parse' as stage, rule_id, site, category, subcategory "
                        f"from ({SQL_RULES})")
def seeds(spark, sf_dir):
    return seed_frontier(host_rules(table(spark, sf_dir, "pages")), "http://localhost/")


@query("dated_seed", f"select rule_id, replace(url, '%s', '2024') as url from ({SQL_RULES})")
def dated_seed(spark, sf_dir):
    rules = host_rules(table(spark, sf_dir, "pages"))
    return rules.select("rule_id", urls.dated_url(F.col("url"), dt.date(2024, 6, 30)).alias("url"))


_K = "regexp_extract(props, '[0-9]+', 0)::bigint"


@query("json_records", f"""
  select event_id, {_K} as k from events where event_type <> 'click'
  union all select event_id, unnest([{_K}, event_id]) from events where event_type = 'click'""")
def json_records(spark, sf_dir):
    pair = F.concat(F.lit("["), "props", F.lit(', {"k": '), "event_id", F.lit("}]"))
    doc = F.when(F.col("event_type") == "click", pair).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    records = json_items.records(rows, "doc", {"k": json_items.JsonField("k")})
    return records.select("event_id", F.col("k").cast("bigint").alias("k"))


@query("json_files", f"""
  select event_id, {_K} as k, null as error from events where event_type not in ('view', 'click')
  union all select event_id, {_K}, 'user: no key user' from events where event_type = 'click'
  union all select null, null, 'no JSON' from events where event_type = 'view'""")
def json_files(spark, sf_dir):
    """Documents written to files, one per line, and read back: broken ones are kept with what is wrong (A4)."""
    body = F.concat(F.lit('{"id": '), "event_id", F.lit(', "p": '), "props")
    doc = F.when(F.col("event_type") == "view", body).when(F.col("event_type") == "click", F.concat(body, F.lit("}"))).otherwise(
        F.concat(body, F.lit(',\n "user": '), "user_id", F.lit("}")))
    path = f"{shared_dir(spark, 'json')}/documents"
    json_items.write_documents(table(spark, sf_dir, "events").select(doc.alias("doc")), "doc", path)
    read = json_items.read_documents(spark, path, lines=True)
    fields = {"id": json_items.JsonField("id"), "k": json_items.JsonField("p>k"), "user": json_items.JsonField("user")}
    good = json_items.records(read.where("error is null").drop("error"), "doc", fields)
    broken = read.where("error is not null")
    return good.select(F.col("id").cast("bigint").alias("event_id"), F.col("k").cast("bigint").alias("k"), "error").unionByName(
        broken.select(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("k"), F.lit("no JSON").alias("error")))


@query("json_path", f"""
  select event_id, {_K} as k, case when event_type in ('view', 'click') then null else user_id end as user_id,
         case when event_type = 'view' then 'no key a>user' end as error from events""")
def json_path(spark, sf_dir):
    user = (F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", ', "user": null')
            .otherwise(F.concat(F.lit(', "user": '), "user_id")))
    doc = F.concat(F.lit('{"a": {"b": '), "props", user, F.lit("}}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(doc).alias("doc"))
    return rows.select(
        "event_id", jsonpath.json_path(F.col("doc"), "a>b>k").cast("bigint").alias("k"),
        jsonpath.json_path(F.col("doc"), "a>user").cast("bigint").alias("user_id"),
        jsonpath.json_error(F.col("doc"), "a>user").alias("error"))


@query("json_items", f"""
  select event_id, u.pos::int as pos, case u.pos when 0 then {_K} else user_id end as k, u.pos = 1 and user_id < 10 as ignored
  from events, (select unnest([0, 1]) as pos) u""")
def json_expand(spark, sf_dir):
    doc = F.concat(F.lit('{"data": {"items": ['), "props", F.lit(', {"k": "u'), "user_id", F.lit('"}]}}'))
    rows = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    records = json_items.records(
        rows, "doc", {"k": json_items.JsonField("k")}, target="data>items",
        clean={"k": lambda v: F.ltrim(v, F.lit("u"))}, ignore={"k": lambda v: v.rlike("^u[0-9]$")})
    return records.select("event_id", "pos", F.ltrim("k", F.lit("u")).cast("bigint").alias("k"), "ignored")


@query("json_errors", """
  select event_id, case event_type when 'view' then 'no records in items' else 'k: no key k' end as error
  from events where event_type in ('view', 'click')""")
def json_errors(spark, sf_dir):
    kind = F.col("event_type")
    items = F.when(kind == "view", "[]").when(kind == "click", '[{"other": 1}]').otherwise('[{"k": 1}]')
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"items": '), items, F.lit("}")).alias("doc"))
    return json_items.record_errors(rows, "doc", {"k": json_items.JsonField("k")}, target="items").select("event_id", "error")


@query("cookie_map", """
  select event_id, 'sid' as name, event_id::varchar as value from events
  union all select event_id, 'kind', event_type from events
  union all select event_id, 'pair', 'a=' || user_id from events""")
def cookies(spark, sf_dir):
    header = F.concat(F.lit("sid="), "user_id", F.lit("; kind="), "event_type", F.lit(" ;pair=a="), "user_id",
                      F.lit("; flag; sid="), "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.explode(cookie_map(header)).alias("name", "value"))


# status of an event taken as a response
STATUS = {"view": 200, "click": 299, "purchase": 0, "signup": 300, "error": 500}
SQL_STATUS = "case event_type " + " ".join(f"when '{k}' then {v}" for k, v in STATUS.items()) + " else -1 end"


def event_status():
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)),
                                   F.col("event_type")), F.lit(-1))


@query("ok_filter", f"select event_id, {SQL_STATUS} as status from events where event_type not in ('signup', 'error')")
def ok_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", event_status().alias("status"))
    return rows.where(is_ok(F.col("status")))


_HEADLINE = """case o_orderpriority when '1-URGENT' then 'order 更多 ' when '2-HIGH' then '【详情】'
   when '3-MEDIUM' then 'x【详细】y' when '5-LOW' then 'two' || chr(10) || 'lines' else 'plain ' end || o_orderkey"""


@query("headline_filter", f"""
  select o_orderkey, headline from (select o_orderkey, {_HEADLINE} as headline from orders)
  where not regexp_matches(headline, '{"|".join(text.HEADLINE_MARKERS)}') and not contains(headline, chr(10))""")
def headline_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_HEADLINE} as headline")
    return orders.where(text.is_headline(F.col("headline")))


@query("article_url_filter", r"""
  select page_id, url from pages where regexp_matches(url, 'https://blog.+/.+[0-9]+.(shtml|shtm|html|htm)')""")
def article_url_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").where(
        F.col("url").rlike(r"https://blog.+/.+[0-9]+.(shtml|shtm|html|htm)"))


# Patterns as a registry has them: some name a word that a URL must have, some don't.
URL_PATTERNS = [(0, r"https://blog.+/.+[0-9]+.(shtml|shtm|html|htm)"), (1, r"^https?://www\."), (2, r"/en/[0-9]+"), (3, r"/de/.*[02468]$"),
                (4, r"[?&]utm_source=feed"), (5, r"#top$"), (6, r"/(en|fr)/[0-9]*7"), (7, r"[?]page=[0-9]&ref="), (8, r"/nowhere/[0-9]+")]


@query("url_patterns", f"""
  select page_id, rule_id from pages, (values {', '.join(f"({k}::bigint, '{p}')" for k, p in URL_PATTERNS)}) t(rule_id, pattern)
  where regexp_matches(url, pattern)""")
def url_patterns(spark, sf_dir):
    """Which rules are for which pages, by the patterns of a stored table."""
    patterns = written(pattern_table(spark, URL_PATTERNS), f"{shared_dir(spark, 'patterns')}/table")
    return pages_by_pattern(table(spark, sf_dir, "pages").select("page_id", "url"), patterns).select("page_id", "rule_id")


_DATED = """'posted ' || case event_type when 'view' then strftime(ts, '%Y-%m-%d') when 'click' then strftime(ts, '%Y/%-m/%-d')
  when 'purchase' then strftime(ts, '%Y年%-m月%-d日') when 'signup' then '19' || strftime(ts, '%y-%m-%d') else '2024-99-31' end || ' by ' || user_id"""


@query("date_extract", f"""
  select event_id, written, case when event_type in ('view', 'click', 'purchase') then day end as day from (
    select event_id, event_type, nullif(regexp_extract({_DATED}, '{text.DATE_PATTERN}', 0), '')
             as written, strftime(ts, '%Y-%m-%d') as day from events)""")
def date_extract(spark, sf_dir):
    kind = F.col("event_type")
    day = (F.when(kind == "view", F.date_format("ts", "yyyy-MM-dd")).when(kind == "click", F.date_format("ts", "yyyy/M/d"))
           .when(kind == "purchase", F.date_format("ts", "yyyy年M月d日"))
           .when(kind == "signup", F.concat(F.lit("19"), F.date_format("ts", "yy-MM-dd"))).otherwise("2024-99-31"))
    note = F.concat(F.lit("posted "), day, F.lit(" by "), "user_id")
    rows = table(spark, sf_dir, "events").select("event_id", note.alias("note"))
    return rows.select("event_id", text.date_text(F.col("note")).alias("written"),
                       F.date_format(text.date_value(F.col("note")), "yyyy-MM-dd").alias("day"))


@query("char_profile", r"""
  select doc_id, len(regexp_extract_all(text, '[一-龥]'))::bigint as chinese,
         len(regexp_extract_all(text, '\p{Nd}'))::bigint as digit,
         len(regexp_extract_all(text, '[a-zA-Z]'))::bigint as letter from documents""")
def char_profile(spark, sf_dir):
    counts = text.char_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", *(c.cast("bigint").alias(n) for n, c in counts.items()))


# a download link per document, in the shapes that matter for suffix tests
_FILE_URL = """'http://files.example.org/' || source || '/' || doc_id || case lang when 'en' then '.PDF;v=1'
  when 'fr' then '.html?utm_source=x&k=2' when 'de' then '.tar.gz' when 'es' then '?f=a.zip' else '.shtml#end' end"""


@query("binary_link_filter", f"""
  select doc_id, url from (select doc_id, {_FILE_URL} as url from documents) where not {sql_binary('url')}""")
def binary_link_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_FILE_URL} as url").where(
        ~urls.is_binary_url(F.col("url")))


@query("suffix_class", f"""
  select doc_id, case when regexp_matches(lower(url), '({"|".join(x.replace(".", "[.]") for x in urls.FILE_SUFFIXES)})$') then 'file'
         when regexp_matches(lower(url), '\\.(html|htm|shtml|shtm)$') then 'page' else 'none' end as kind
  from (select doc_id, {_FILE_URL} as url from documents)""")
def suffix_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_FILE_URL} as url").select(
        "doc_id", urls.suffix_class(F.col("url")).alias("kind"))


@query("clean_url", f"""
  select page_id, raw, {sql_clean_url('raw')} as canonical from (
    select page_id, unnest([url, url || '&spm=9&a=1', replace(url, '#top', '?utm_x=1&b&c=2#top'), 'ftp://x/' || page_id,
                            'HTTP' || substr(url, 5), url || '/f.ZIP', regexp_extract(url, '^[a-z]+://[^/]*', 0)]) as raw from pages)""")
def clean_url(spark, sf_dir):
    u = F.col("url")
    raws = F.array(u, F.concat(u, F.lit("&spm=9&a=1")), F.replace(u, F.lit("#top"), F.lit("?utm_x=1&b&c=2#top")),
                   F.concat(F.lit("ftp://x/"), "page_id"), F.concat(F.lit("HTTP"), F.substr(u, F.lit(5))),
                   F.concat(u, F.lit("/f.ZIP")), F.regexp_extract(u, "^[a-z]+://[^/]*", 0))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(raws).alias("raw"))
    return rows.select("page_id", "raw", urls.clean_url(F.col("raw")).alias("canonical"))


REFS = ["/p", "?q=1", "#f", "//h/p", "javascript:void(0)", "../x", "./y", "z", "", "https://Other/a/../b?c#d"]


@query("url_resolve", f"""
  select page_id, ref, case ref when '/p' then root || '/p' when '?q=1' then root || path || '?q=1'
      when '#f' then root || path || query || '#f' when '//h/p' then scheme || '://h/p'
      when 'javascript:void(0)' then ref when '../x' then root || regexp_replace(dir, '[^/]+/$', '') || 'x'
      when './y' then root || dir || 'y' when 'z' then root || dir || 'z' when '' then url
      else ref end as resolved
  from (select page_id, url, unnest({REFS}) as ref, {sql_part('url', 1)} as scheme,
          {sql_part('url', 1)} || '://' || {sql_part('url', 2)} as root, {sql_part('url', 3)} as path,
          regexp_replace({sql_part('url', 3)}, '[^/]*$', '') as dir,
          case when {sql_part('url', 4)} = '' then '' else '?' || {sql_part('url', 4)} end as query from pages)""")
def url_resolve(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.explode(F.array(*(F.lit(r) for r in REFS))).alias("ref"))
    return rows.select("page_id", "ref", urls.url_resolve(F.col("url"), F.col("ref")).alias("resolved"))


@query("page_links", SQL_PAGE_LINKS)
def links(spark, sf_dir):
    return page_links(table(spark, sf_dir, "pages"))


@query("link_counts", f"select page_id, count(*) as n from ({SQL_PAGE_LINKS}) group by page_id "
                      "union all select page_id, 0 from pages where not contains(html, '<a ')")
def link_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.size(extract_links(F.col("url"), F.col("html"))).cast("bigint").alias("n"))


@query("url_host", f"select page_id, {sql_part('url', 2)} as host from pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.url_host(F.col("url")).alias("host"))


@query("last_param", "select page_id, string_split(string_split(url, '&')[-1], '=')[-1] as param from pages")
def last_param(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.last_param(F.col("url")).alias("param"))


@query("templated_urls", """
  select conv_id, 'http://words.example.org/?action=words&class=' || conv_id || '&course=' || i as url
  from (select conv_id, count(*) as n from conversations group by conv_id), lateral (select unnest(range(1, n + 1)) as i)""")
def templated_urls(spark, sf_dir):
    chapters = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    template = "http://words.example.org/?action=words&class=%s&course=%s"
    return urls.numbered_rows(chapters, template, "conv_id", "n").select("conv_id", "url")


@query("percent_encode", "select doc_id, replace(url_encode(text), '%2F', '/') as encoded from documents")
def percent_encode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", urls.percent_encode(F.col("text")).alias("encoded"))


@query("squeeze_ws", f"select doc_id, {sql_squeeze('text')} as squeezed from documents")
def squeezed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", squeeze_ws(F.col("text")).alias("squeezed"))


_TITLE = """p_name || case p_size when 1 then ' - ' when 2 then '–' when 3 then '—' when 4 then '-' when 5 then '|'
  when 6 then '::' when 7 then '|a - ' when 8 then '::b—' else ' ' end || p_brand"""


@query("clean_title", f"""
  select p_partkey, case when contains(t, ' - ') then split_part(t, ' - ', 1) when contains(t, '–') then split_part(t, '–', 1)
      when contains(t, '—') then split_part(t, '—', 1) when contains(t, '-') then split_part(t, '-', 1)
      when contains(t, '|') then split_part(t, '|', 1) when contains(t, '::') then split_part(t, '::', 1) else t end as title
  from (select p_partkey, {_TITLE} as t from part)""")
def clean_title(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_TITLE} as t").select(
        "p_partkey", text.clean_title(F.col("t")).alias("title"))


@query("regex_single", r"""
  select doc_id, nullif(regexp_extract(text, '([a-z]+)ing', 1), '') as one_group,
         nullif(regexp_extract(text, '[0-9]{4}', 0), '') as whole,
         coalesce(nullif(regexp_extract(text, '[0-9]{7}', 0), ''), 'none') as or_default,
         nullif(regexp_extract(text, '([a-z]+) (the|of)', 1), '') as first_word,
         nullif(regexp_extract(text, '([a-z]+) (the|of)', 2), '') as second_word,
         nullif(regexp_extract(text, '([a-z]+)@([a-z.]+)', 2), '') as host from documents""")
def regex_single(spark, sf_dir):
    t = F.col("text")
    two = text.regex_single(t, r"([a-z]+) (the|of)")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.regex_single(t, r"([a-z]+)ing").alias("one_group"),
        text.regex_single(t, r"[0-9]{4}").alias("whole"),
        text.regex_single(t, r"[0-9]{7}", default="none").alias("or_default"),
        F.get(two, F.lit(0)).alias("first_word"), F.get(two, F.lit(1)).alias("second_word"),
        text.regex_single(t, re.compile(r"(?P<user>[a-z]+)@(?P<host>[a-z.]+)"))["host"].alias("host"))


@query("regex_many", r"""
  select page_id, a.i::int as pos, regexp_extract_all(html, '<(p|a|li)( href="[^"]*")?>', 1)[a.i + 1] as tag,
         regexp_extract_all(html, '<(p|a|li)( href="[^"]*")?>', 2)[a.i + 1] as attr
  from pages, lateral (select unnest(range(0, len(regexp_extract_all(html, '<(p|a|li)( href="[^"]*")?>')))) as i) a""")
def regex_many(spark, sf_dir):
    found = text.regex_many(F.col("html"), r'<(p|a|li)( href="[^"]*")?>')
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "m")).select(
        "page_id", "pos", F.get("m", F.lit(0)).alias("tag"), F.get("m", F.lit(1)).alias("attr"))
