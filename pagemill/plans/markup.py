"""Element selection, fields, records and main content of the stored pages (D, E3, G, H5, I3, J)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagemill.functions.common import let
from pagemill.functions.text import regex_single
from pagemill.operators import content as c
from pagemill.operators.fields import (Field, ascii_markup, attr_field, attr_text_field, html_field, markup,
                                       pretty_markup, subtree, text_content, text_field)
from pagemill.operators.items import ItemSpec, page_items, scope_errors, scope_items
from pagemill.operators.links import absolute_attrs, base_url
from pagemill.operators.select import Step, descend, find_all, select
from pagemill.plans.catalog import SQL_NAV, SQL_ROOT, query, sql_ascii, sql_decode, sql_part, sql_squeeze, sql_strip
from pagemill.plans.scans import SQL_RULES, site_rules
from pagemill.sources.nodes import contained, is_element, node_table, parse_nodes, register_sql, structural_pairs
from pagemill.sources.pages import table
from pagemill.sources.rules import extract_rules
from pagemill.sources.shared import shared_dir, written
from pagemill.streaming import ingest


def nodes():
    return F.col("nodes")


def parsed(spark, sf_dir, *extra):
    return parse_nodes(table(spark, sf_dir, "pages").select("page_id", *extra, "html"))


def whole(spark, sf_dir):
    return c.parse_whole(table(spark, sf_dir, "pages").select("page_id", "html"))


SQL_TAGS = "(select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages)"


@query("nodes_tag_counts", f"select tag, count(*) as n from {SQL_TAGS} group by tag")
def nodes_tag_counts(spark, sf_dir):
    rows = node_table(table(spark, sf_dir, "pages").select("html"), ["tag"])
    return rows.where(~F.col("tag").isin("#text", "#comment")).groupBy("tag").agg(F.count("*").alias("n"))


@query("nodes_in_sql", f"select tag, count(*) as n from {SQL_TAGS} group by tag")
def nodes_in_sql(spark, sf_dir):
    register_sql(spark)
    return spark.sql("""
        SELECT tag, count(*) AS n FROM (SELECT inline(nodes) FROM page_nodes(TABLE(SELECT page_id, html FROM {pages})))
        WHERE tag NOT IN ('#text', '#comment') GROUP BY tag""", pages=table(spark, sf_dir, "pages"))


@query("find_all", f"select page_id, href, txt from ({SQL_NAV}) where regexp_matches(href, '[aeiou]n$')")
def find_links(spark, sf_dir):
    found = select(nodes(), find_all("a", {"href": re.compile("[aeiou]n$")}))
    rows = parsed(spark, sf_dir).select("page_id", F.explode(F.transform(found, lambda x: F.struct(
        x["attrs"]["href"].alias("href"), text_content(nodes(), x).alias("txt")))).alias("a"))
    return rows.select("page_id", "a.*")


@query("child_axis", r"""
  select page_id, 'p' as tag, len(regexp_extract_all(html, '<p>'))::bigint as n from pages
  union all select page_id, 'h1', len(regexp_extract_all(html, '<h1>'))::bigint from pages""")
def child_axis(spark, sf_dir):
    article = F.get(select(nodes(), descend(Step("article"))), F.lit(0))

    def children(tag):
        found = let(article, lambda a: F.size(select(nodes(), find_all(tag, recursive=False), scope=a)))
        return F.struct(F.lit(tag).alias("tag"), found.cast("bigint").alias("n"))

    return parsed(spark, sf_dir).select("page_id", F.inline(F.array(children("p"), children("h1"))))


@query("string_match", f"select page_id, href, txt from ({SQL_NAV}) where regexp_matches(txt, '^[A-Z].*[.,]$')")
def string_match(spark, sf_dir):
    found = select(nodes(), find_all("li", string=re.compile(r"^[A-Z].*[.,]$")))
    rows = parsed(spark, sf_dir).select("page_id", F.explode(F.transform(found, lambda x: F.struct(
        F.get(nodes(), x["pre"] + 1)["attrs"]["href"].alias("href"), text_content(nodes(), x).alias("txt")))).alias("a"))
    return rows.select("page_id", "a.*")


@query("string_nodes", f"select page_id, txt from ({SQL_NAV}) where regexp_matches(txt, '^[a-z]{{2,3}}$')")
def string_nodes(spark, sf_dir):
    names = Field("string", find_all(string=re.compile(r"^[a-z]{2,3}$")))
    return parsed(spark, sf_dir).select("page_id", F.explode(names.extract(nodes())["value"]).alias("txt"))


@query("css_select", f"select page_id, href from ({SQL_NAV}) where pos = 2")
def css_select(spark, sf_dir):
    found = select(nodes(), descend(Step("nav"), Step("li", nth=2), Step("a", attrs=(("href", "prefix", "/"),))))
    return parsed(spark, sf_dir).select("page_id", F.explode(
        F.transform(found, lambda x: x["attrs"]["href"])).alias("href"))


@query("xpath_select", f"""
  select page_id, 'ad' as part, {sql_decode("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} as txt from pages
  union all select page_id, 'link', txt from ({SQL_NAV})""")
def xpath_select(spark, sf_dir):
    ad = select(nodes(), descend(Step(attrs=(("class", "contains", "ad"),)), reach="page"))
    links = select(nodes(), descend(Step("li"), Step("a", child=True), reach="page"))

    def part(name, found):
        return F.transform(found, lambda x: F.struct(F.lit(name).alias("part"), text_content(nodes(), x).alias("txt")))

    return parsed(spark, sf_dir).select("page_id", F.inline(F.concat(part("ad", ad), part("link", links))))


@query("attr_field", """
  select page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, 'utf-8' as charset, 'none' as missing from pages""")
def attr_fields(spark, sf_dir):
    one = dict(many=False, family="tree")
    fields = {"lang": attr_field("lang", descend(Step("html")), **one),
              "charset": attr_field("charset", descend(Step("head"), Step("meta")), **one),
              "missing": attr_field("id", descend(Step("body")), default="none", **one)}
    return parsed(spark, sf_dir).select("page_id", *(f.extract(nodes())["value"].alias(n) for n, f in fields.items()))


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"


@query("text_compact", f"""
  select page_id, {sql_squeeze(sql_decode(f"regexp_replace({_ARTICLE}, '<[^>]*>', '', 'g')"))} as txt from pages""")
def text_compact(spark, sf_dir):
    body = text_field(find_all("article"), many=False)
    return parsed(spark, sf_dir).select("page_id", body.extract(nodes())["value"].alias("txt"))


@query("text_strip", f"""
  select page_id, array_to_string(list_transform(string_split_regex({_ARTICLE}, '<[^>]*>'),
      lambda t: {sql_strip(sql_decode('t'))}), '') as txt from pages""")
def text_strip(spark, sf_dir):
    body = text_field(descend(Step("article")), family="tree")
    return parsed(spark, sf_dir).select("page_id", body.extract(nodes())["value"].alias("txt"))


@query("anchor_pairs", f"select page_id, (pos - 1)::int as pos, {sql_squeeze('txt')} as txt, href as attr from ({SQL_NAV})")
def anchor_pairs(spark, sf_dir):
    pairs = attr_text_field("href", descend(Step("li"), Step("a")))
    rows = parsed(spark, sf_dir).select("page_id", F.posexplode(pairs.extract(nodes())["value"]).alias("pos", "pair"))
    return rows.select("page_id", "pos", F.col("pair.text").alias("txt"), "pair.attr")


@query("html_fragment", """
  select page_id, regexp_extract(html, '(?s)<nav>.*</nav>', 0) as nav,
         regexp_extract(html, '<li>.*?</li>', 0) as first_item from pages""")
def html_fragment(spark, sf_dir):
    nav = html_field(descend(Step("nav")), family="tree")
    item = html_field(find_all("li"), many=False)
    return parsed(spark, sf_dir).select("page_id", nav.extract(nodes())["value"].alias("nav"),
                                        item.extract(nodes())["value"].alias("first_item"))


@query("regex_subtree", """
  select page_id, regexp_extract(html, '<li><a href="([^"]*)">', 1) as first_href from pages""")
def regex_subtree(spark, sf_dir):
    nav = F.get(select(nodes(), descend(Step("nav"))), F.lit(0))
    source = let(nav, lambda n: markup(nodes(), n, tail=False))
    return parsed(spark, sf_dir).select("page_id", source.alias("nav")).select(
        "page_id", regex_single(F.col("nav"), r'<a href="([^"]*)">').alias("first_href"))


@query("regex_subtree_forms", f"""
  select page_id, regexp_extract(form, '</h1>(.*)$', 1) as tail, regexp_extract(form, '^<h1>([^<]*)</h1>', 1) as heading,
         pretty from (select page_id, {sql_ascii("regexp_extract(html, '(?s)<h1>[^<]*</h1>', 0)")} as form,
    '<li>' || chr(10) || ' <a href="' || regexp_extract(html, '<li><a href="([^"]*)">', 1) || '">' || chr(10) || '  '
      || {sql_strip("regexp_extract(html, '<li><a href=[^>]*>([^<]*)<', 1)")} || chr(10) || ' </a>' || chr(10) || '</li>' || chr(10) as pretty from pages)""")
def regex_subtree_forms(spark, sf_dir):
    """An element with its tail, characters beyond ASCII as references; and an element on indented lines."""
    def first(tag, take):
        return let(F.get(select(nodes(), find_all(tag)), F.lit(0)), take)

    form = ascii_markup(first("h1", lambda x: markup(nodes(), x)))
    rows = parsed(spark, sf_dir).select("page_id", form.alias("form"), first("li", lambda x: pretty_markup(nodes(), x)).alias("pretty"))
    return rows.select("page_id", regex_single(F.col("form"), "</h1>(.*)$").alias("tail"),
                       regex_single(F.col("form"), "^<h1>([^<]*)</h1>").alias("heading"), "pretty")


# pages whose attributes hold stray quotes
@query("stray_quotes", f"""
  select page_id, href, 'it''s' as title, {sql_squeeze('txt')} as txt from ({SQL_NAV})""")
def stray_quotes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    odd = F.regexp_replace("html", '<a href="([^"]*)">', "<a href=\"$1\"\" title=it's>")
    spec = ItemSpec(scope=descend(Step("nav"), Step("li")), fields={
        "href": attr_field("href", descend(Step("a")), many=False), "title": attr_field("title", descend(Step("a")), many=False),
        "txt": text_field(find_all("a"), many=False)})
    return scope_items(parse_nodes(pages.select("page_id", odd.alias("html"))), spec).select("page_id", "href", "title", "txt")


@query("field_modes", f"""
  select page_id, max(href) filter (pos = 1) as first, count(*) as n, 'none' as soup_default,
         '' as tree_default, 'nothing matched for text' as soup_error, 'nothing matched for text' as tree_error,
         1::bigint as many_default
  from ({SQL_NAV}) group by page_id""")
def field_modes(spark, sf_dir):
    a, no = descend(Step("li"), Step("a")), descend(Step("blink"))
    first = attr_field("href", a, many=False).extract(nodes())["value"]
    return parsed(spark, sf_dir).select(
        "page_id", first.alias("first"), F.size(attr_field("href", a).extract(nodes())["value"]).cast("bigint").alias("n"),
        text_field(no, many=False, default="none").extract(nodes())["value"].alias("soup_default"),
        attr_field("href", no, family="tree").extract(nodes())["value"].alias("tree_default"),
        text_field(no, many=False, default="").extract(nodes())["error"].alias("soup_error"),
        text_field(no, family="tree").extract(nodes())["error"].alias("tree_error"),
        F.size(text_field(no, default="x").extract(nodes())["value"]).cast("bigint").alias("many_default"))


def nav_spec(**hooks):
    return ItemSpec(scope=descend(Step("nav"), Step("li")), fields={
        "href": attr_field("href", descend(Step("a")), many=False),
        "txt": text_field(find_all("a"), many=False)}, **hooks)


@query("scoped_items", f"select page_id, href, {sql_squeeze('txt')} as txt from ({SQL_NAV})")
def scoped_items(spark, sf_dir):
    return scope_items(parsed(spark, sf_dir), nav_spec()).select("page_id", "href", "txt")


_LANG = """regexp_extract(html, '<html lang="([a-z]+)"', 1)"""
_TITLE = sql_strip(sql_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))


@query("item_table", f"""
  select page_id, {_LANG} as lang, {_TITLE} as title, len(regexp_extract_all(html, '<li>'))::bigint as n_links,
         {sql_decode("regexp_extract(html, '<a href=.([^>]*).>', 1)")} as first_link from pages""")
def item_table(spark, sf_dir):
    spec = ItemSpec(fields={
        "lang": attr_field("lang", descend(Step("html")), family="tree"),
        "title": text_field(descend(Step("title")), family="tree"),
        "links": attr_field("href", find_all("a", {"href": True})),
        "first_link": attr_field("href", find_all("a"), many=False)})
    rows = page_items(parsed(spark, sf_dir), spec)
    return rows.select("page_id", "lang", "title", F.size("links").cast("bigint").alias("n_links"), "first_link")


@query("clean_fields", f"""
  select page_id, regexp_replace({sql_squeeze('txt')}, '[.,]+$', '') as txt, {SQL_ROOT} || href as href from ({SQL_NAV})""")
def clean_fields(spark, sf_dir):
    spec = nav_spec(clean={"txt": lambda v: F.regexp_replace(v, "[.,]+$", "")})
    rows = scope_items(parsed(spark, sf_dir, "url"), spec)
    return rows.select("page_id", "txt", F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*", 0), "href").alias("href"))


@query("item_ignore", f"""
  select page_id, href, lower({sql_squeeze('txt')}) as txt from ({SQL_NAV}) where not regexp_matches(txt, '[.,]$')""")
def item_ignore(spark, sf_dir):
    spec = nav_spec(clean={"txt": F.lower}, ignore={"txt": lambda v: v.rlike("[.,]$")})
    return scope_items(parsed(spark, sf_dir), spec).select("page_id", "href", "txt")


_PLAIN = "regexp_matches(txt, '[^.,]$')"


@query("rows_before_error", f"""
  select page_id, href, txt from (
    select page_id, href, {sql_squeeze('txt')} as txt, pos,
           min(case when not {_PLAIN} then pos end) over (partition by page_id) as stop from ({SQL_NAV}))
  where stop is null or pos < stop""")
def rows_before_error(spark, sf_dir):
    spec = ItemSpec(scope=descend(Step("li")), fields={
        "href": attr_field("href", find_all("a"), many=False),
        "txt": text_field(find_all("a", string=re.compile("[^.,]$")), many=False)})
    return scope_items(parsed(spark, sf_dir), spec, strict=True).select("page_id", "href", "txt")


@query("extraction_errors", f"""
  select page_id, 'txt: nothing matched for text' as error, count(*) as n from ({SQL_NAV}) where not {_PLAIN} group by page_id""")
def extraction_errors(spark, sf_dir):
    spec = ItemSpec(scope=descend(Step("li")), fields={
        "txt": text_field(find_all("a", string=re.compile("[^.,]$")), many=False)})
    return scope_errors(parsed(spark, sf_dir), spec).groupBy("page_id", "error").agg(F.count("*").alias("n"))


def _text_length(field, nodes, x):
    return F.length(text_content(nodes, x)).cast("string")


@query("custom_field", f"""
  select page_id, {sql_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}.length()::varchar as n from pages""")
def custom_field(spark, sf_dir):
    heading = Field(_text_length, find_all("h1"), many=False)
    return parsed(spark, sf_dir).select("page_id", heading.extract(nodes())["value"].alias("n"))


@query("containment_join", f"""
  select page_id, 'ul' as outer_tag, 'li' as inner_tag, count(*) as n from ({SQL_NAV}) group by page_id
  union all select page_id, 'nav', 'a', count(*) from ({SQL_NAV}) group by page_id
  union all select page_id, 'article', 'p', len(regexp_extract_all(html, '<p>')) from pages
  union all select page_id, 'p', 'b', len(regexp_extract_all(html, '<b>')) from pages where contains(html, '<b>')""")
def containment(spark, sf_dir):
    pages = parse_nodes(table(spark, sf_dir, "pages").select("page_id", "html"), ["pre", "last", "tag"])
    outer = F.filter(nodes(), lambda x: x["tag"].isin("ul", "nav", "article", "p") & (x["last"] > x["pre"]))
    inner = F.filter(nodes(), lambda x: x["tag"].isin("li", "a", "p", "b"))
    pairs = F.transform(structural_pairs(outer, inner), lambda p: F.struct(p["outer"]["tag"].alias("outer_tag"), p["inner"]["tag"].alias("inner_tag")))
    wanted = F.concat_ws(" ", "outer_tag", "inner_tag").isin("ul li", "nav a", "article p", "p b")
    return pages.select("page_id", F.inline(pairs)).where(wanted).groupBy("page_id", "outer_tag", "inner_tag").agg(F.count("*").alias("n"))


@query("containment_rows", f"""
  select page_id, pos as item, href from ({SQL_NAV})""")
def containment_rows(spark, sf_dir):
    """Stored node rows joined to those that enclose them: the links of each list item, the items numbered."""
    rows = written(node_table(table(spark, sf_dir, "pages").select("page_id", "html")), f"{shared_dir(spark, 'node-rows')}/rows")
    items = rows.where("tag = 'li'").select("page_id", "pre", "last", F.col("nth").cast("long").alias("item"))
    links = rows.where("tag = 'a'").select("page_id", "pre", F.col("attrs")["href"].alias("href"))
    return contained(links, items).select("page_id", F.col("outer_item").alias("item"), "href")


@query("first_match", f"select page_id, href from ({SQL_NAV}) where pos = 1")
def first_match(spark, sf_dir):
    found = F.transform(F.slice(F.filter(nodes(), lambda x: x["tag"] == "a"), 1, 1), lambda x: x["attrs"]["href"])
    return parsed(spark, sf_dir).select("page_id", F.explode(found).alias("href"))


@query("nth_of_type", f"""
  select page_id, 'li' as tag, pos::int as nth from ({SQL_NAV})
  union all select page_id, 'p', i::int from pages, lateral (select unnest(range(1, len(regexp_extract_all(html, '<p>')) + 1)) as i)""")
def nth_of_type(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    wanted = F.filter(nodes(), lambda x: x["tag"].isin("li", "p"))
    return parse_nodes(pages, ["tag", "nth"]).select("page_id", F.inline(wanted))


@query("page_title", f"select page_id, {_TITLE} as title from pages")
def page_title(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", c.page_title(nodes()).alias("title"))


@query("node_weight", f"""
  select tag, case when tag in ('div', 'p', 'table') then 3 else 1 end as weight, count(*) as n from {SQL_TAGS} group by tag""")
def node_weight(spark, sf_dir):
    weights = F.transform(F.filter(nodes(), is_element), lambda x: F.struct(x["tag"].alias("tag"), c.node_weight(x).alias("weight")))
    return parsed(spark, sf_dir).select(F.inline(weights)).groupBy("tag", "weight").agg(F.count("*").alias("n"))


# -- the stored pages' blocks said in SQL ---------------------------------------------------------
# article > h1, p*; a <b> left open in a p ends with that p; body > nav, comment, div.ad, article, footer.
def _strip_len(x):
    return f"length({sql_strip(sql_decode(x))})"


SQL_PARTS = f"""
  select page_id, html, regexp_extract(art, '(?s)<h1>([^<]*)</h1>', 1) as h1,
         list_transform(segs[2:], lambda s: regexp_extract(s, '(?s)^[^<]*', 0)) as p_texts,
         list_transform(segs[2:], lambda s: regexp_extract(s, '(?s)^<b>([^<]*)', 1)) as b_texts
  from (select page_id, html, {_ARTICLE} as art, string_split({_ARTICLE}, '<p>') as segs from pages)"""
SQL_SCORES = f"""
  select page_id, 'article' as tag, {_strip_len('h1')} + list_sum(list_transform(p_texts, lambda t: 3 * {_strip_len('t')})) as text_len,
         1 as weight, 0 as front from ({SQL_PARTS})
  union all
  select page_id, 'p', {_strip_len('b_texts[i]')}, 3, i from ({SQL_PARTS}), lateral (select unnest(range(1, len(b_texts) + 1)) as i)
  where {_strip_len('b_texts[i]')} >= 10"""
SQL_BEST = f"""
  select page_id, arg_max(tag, rank) as tag, arg_max(text_len, rank)::bigint as text_len, max(score)::bigint as score
  from (select *, (text_len * weight)::bigint as score, row_number() over (
          partition by page_id order by text_len * weight, case tag when 'article' then 1 else 0 end, front desc) as rank
        from ({SQL_SCORES}) where text_len >= 10) group by page_id"""


def _link_len(texts):
    return f"list_transform({texts}, lambda t: length({sql_squeeze(sql_decode('t'))}))"


def _long_sum(lens):
    return f"coalesce(list_sum(list_filter({lens}, lambda n: n > 5)), 0)"


# what pruning looks at: links, texts and whether the body or the list is mostly links
SQL_FACTS = f"""
  nav as (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as links,
       {sql_strip(sql_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} as full_title,
       regexp_extract(html, '(?s)<div class=.ad.>([^<]*)</div>', 1) as ad,
       regexp_extract(html, '(?s)<footer>([^<]*)', 1) as foot,
       length({sql_squeeze(sql_decode("regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '<[^>]*>', '', 'g')"))}) as body_len from pages),
  lens as (select *, {_link_len('links')} as ls from nav),
  facts as (select *, {_long_sum('ls')} as long_links, coalesce(list_sum(ls), 0) as all_links from lens)"""

SQL_MAIN = f"""
  with parts as ({SQL_PARTS}), best as ({SQL_BEST}), {SQL_FACTS},
  txt as (select p.page_id, full_title,
       case when best.tag is null or (best.tag = 'p' and long_links > body_len * 0.4) then ''
         else case when best.tag = 'p' then
                case when long_links > all_links * 0.4 then ''
                     else array_to_string(list_filter(links, lambda t: length({sql_squeeze(sql_decode('t'))}) <= 5), '') end || ad || chr(10)
              else '' end
           || h1 || chr(10) || array_to_string(list_transform(range(1, len(p_texts) + 1),
                lambda i: chr(10) || case when p_texts[i] <> '' then p_texts[i] else b_texts[i] end), '')
           || case when best.tag = 'p' then chr(10) || foot else '' end end as raw
    from parts p join facts using (page_id) left join best using (page_id))
  select page_id, case when contains(t, ' - ') then split_part(t, ' - ', 1) when contains(t, '–') then split_part(t, '–', 1)
      when contains(t, '—') then split_part(t, '—', 1) when contains(t, '-') then split_part(t, '-', 1)
      when contains(t, '|') then split_part(t, '|', 1) when contains(t, '::') then split_part(t, '::', 1) else t end as title,
    array_to_string(list_filter(list_transform(string_split({sql_decode('raw')}, chr(10)), lambda l: {sql_strip('l')}),
                                lambda l: l <> ''), chr(10)) as content
  from (select page_id, raw, full_title as t from txt)"""


@query("block_scores", f"""
  select page_id, tag, text_len::bigint as text_len, (text_len * weight)::bigint as score from ({SQL_SCORES}) where text_len >= 10""")
def block_scores(spark, sf_dir):
    scores = let(c.block_scores(nodes(), F.col("whole")), lambda s: F.transform(s, lambda b: F.struct(
        F.get(nodes(), b["pre"])["tag"].alias("tag"), b["text_len"].cast("bigint").alias("text_len"),
        b["score"].cast("bigint").alias("score"))))
    return whole(spark, sf_dir).select("page_id", F.inline(scores))


@query("best_block", SQL_BEST)
def best_block(spark, sf_dir):
    def best(scores):
        chosen = let(c.best_block(scores), lambda pre: F.filter(scores, lambda s: s["pre"] == pre))
        return F.transform(chosen, lambda s: F.struct(
            F.get(nodes(), s["pre"])["tag"].alias("tag"), s["text_len"].cast("bigint").alias("text_len"),
            s["score"].cast("bigint").alias("score")))

    return whole(spark, sf_dir).select("page_id", F.inline(let(c.block_scores(nodes(), F.col("whole")), best)))


@query("block_climb", f"select page_id, case tag when 'p' then 'html' else tag end as tag from ({SQL_BEST})")
def block_climb(spark, sf_dir):
    tag = let(c.block_of(nodes(), F.col("whole")), lambda pre: F.get(nodes(), pre)["tag"])
    return whole(spark, sf_dir).select("page_id", F.explode(F.array_compact(F.array(tag))).alias("tag"))


@query("link_density", f"""
  select page_id, sum(length({sql_squeeze('txt')}))::bigint as text_len,
         sum(case when length({sql_squeeze('txt')}) > 5 then length({sql_squeeze('txt')}) else 0 end)::bigint as link_len
  from ({SQL_NAV}) group by page_id""")
def link_density(spark, sf_dir):
    nav = F.get(select(nodes(), descend(Step("nav"))), F.lit(0))
    share = let(nav, lambda n: F.get(c.link_shares(nodes(), n), n["pre"]))
    rows = parsed(spark, sf_dir).select("page_id", F.explode(F.array_compact(F.array(share))).alias("s"))
    return rows.select("page_id", F.col("s.text").cast("bigint").alias("text_len"),
                       F.col("s.links").cast("bigint").alias("link_len"))


# only blocks that climbed to the root have parts to drop
SQL_PRUNED = f"""
  with best as ({SQL_BEST}), {SQL_FACTS},
  page as (select page_id, len(links) as k, len(list_filter(ls, lambda n: n > 5)) as long_k, long_links > body_len * 0.4 as no_body,
                  long_links > body_len * 0.4 or long_links > all_links * 0.4 as no_nav
           from facts join best using (page_id) where tag = 'p'),
  counts as (select page_id, unnest(regexp_extract_all(html, '<(body|div|article|h1|p|b|br|footer)[ >]', 1)) as tag
             from pages where page_id in (select page_id from page where no_body))
  select page_id, unnest(['head', 'meta', 'title', 'style', 'script', '#comment']) as tag, 1 as n from page
  union all select page_id, unnest(['nav', 'ul']), 1 from page where no_nav
  union all select page_id, unnest(['li', 'a']), case when no_nav then k else long_k end from page where no_nav or long_k > 0
  union all select page_id, tag, count(*) from counts group by page_id, tag"""


@query("pruned_nodes", SQL_PRUNED)
def pruned_nodes(spark, sf_dir):
    def dropped(pre):
        def tags(block):
            below = let(c.pruned(nodes(), block), lambda d: F.filter(
                subtree(nodes(), block), lambda x, i: F.get(d, i) & (x["tag"] != "#text")))
            return F.transform(below, lambda x: x["tag"])
        return let(F.get(nodes(), pre), tags)

    rows = whole(spark, sf_dir).select("page_id", F.explode(
        let(c.block_of(nodes(), F.col("whole")), dropped)).alias("tag"))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("render_text", f"""
  select page_id, array_to_string(list_filter(list_transform(string_split({sql_decode("h1 || chr(10) || array_to_string(list_transform(range(1, len(p_texts) + 1), lambda i: chr(10) || case when p_texts[i] <> '' then p_texts[i] else b_texts[i] end), '')")}, chr(10)),
      lambda l: {sql_strip('l')}), lambda l: l <> ''), chr(10)) as txt from ({SQL_PARTS})""")
def render_text(spark, sf_dir):
    article = F.get(select(nodes(), descend(Step("article"))), F.lit(0))
    text = let(article, lambda a: let(F.transform(subtree(nodes(), a), lambda x: F.lit(False)),
                                      lambda nothing: c.render(nodes(), a, nothing)))
    return parsed(spark, sf_dir).select("page_id", text.alias("txt"))


@query("main_content", SQL_MAIN)
def main_content(spark, sf_dir):
    return c.main_content(table(spark, sf_dir, "pages"))


@query("absolute_links", f"select page_id, {SQL_ROOT} || href as href from ({SQL_NAV})")
def absolute_links(spark, sf_dir):
    found = F.transform(select(nodes(), find_all("a", {"href": True})),
                        lambda x: absolute_attrs(F.col("url"), x["attrs"])["href"])
    return parsed(spark, sf_dir, "url").select("page_id", F.explode(found).alias("href"))


@query("absolute_all_links", f"""
  select page_id, 'a' as tag, 'href' as name, {SQL_ROOT} || '/sub/' || href[2:] as value from ({SQL_NAV})
  union all select page_id, 'div', 'style', 'background:url(' || {SQL_ROOT} || '/sub/i.png) red' from pages
  union all select page_id, 'div', 'archive', {SQL_ROOT} || '/sub/a ' || {SQL_ROOT} || '/b' from pages
  union all select page_id, 'meta', 'content', '5; url=' || {SQL_ROOT} || '/sub/next' from pages""")
def absolute_all_links(spark, sf_dir):
    """All kinds of references, relative to the page's base."""
    extra = F.concat(F.lit("<head><base href='/sub/'><meta http-equiv='Refresh' content='5; url=next'></head>"),
                     F.lit("<body><div style='background:url(i.png) red' archive='a /b'></div>"))
    links = F.array_join(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), F.lit(1)), '">x</a><a href="')
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(extra, F.lit('<a href="'), links, F.lit('">x</a>')).alias("html"))

    def found(base):
        elements = F.filter(nodes(), lambda x: x["tag"].isin("a", "div", "meta") & (F.size(x["attrs"]) > 0))
        entries = F.flatten(F.transform(elements, lambda x: F.transform(
            F.map_entries(absolute_attrs(base, x["attrs"], x["tag"])), lambda e: F.struct(
                x["tag"].alias("tag"), e["key"].alias("name"), e["value"].alias("value")))))
        return F.filter(entries, lambda e: e["name"].isin("href", "style", "archive", "content"))

    return parse_nodes(pages).select("page_id", F.inline(let(base_url(F.col("url"), nodes()), found)))


@query("stage_outputs", f"""
  select page_id, 'record' as kind, {_TITLE} as value from pages
  union all select page_id, 'link', {SQL_ROOT} || href from ({SQL_NAV})""")
def stage_outputs(spark, sf_dir):
    """One parse yields records and links, told apart by kind (M2u)."""
    record = F.array(F.struct(F.lit("record").alias("kind"), c.page_title(nodes()).alias("value")))
    links = F.transform(select(nodes(), find_all("a", {"href": True})), lambda x: F.struct(
        F.lit("link").alias("kind"), absolute_attrs(F.col("url"), x["attrs"])["href"].alias("value")))
    return parsed(spark, sf_dir, "url").select("page_id", F.inline(F.concat(record, links)))


@query("rule_extract", f"""
  with ruled as (select page_id, category from (select page_id, {sql_part('url', 2)} as host from pages) join ({SQL_RULES}) on host = site)
  select page_id, category, {sql_squeeze('txt')} as text, href as attr from ({SQL_NAV}) join ruled using (page_id) where category = 'news'
  union all select page_id, category, null, href from ({SQL_NAV}) join ruled using (page_id) where category = 'words' and pos = 1
  union all select page_id, category, {sql_squeeze(sql_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))}, null
    from pages join ruled using (page_id) where category = 'notice'""")
def rule_extract(spark, sf_dir):
    """Each category of sites has its own selectors, which are data of the registry."""
    return extract_rules(table(spark, sf_dir, "pages"), site_rules(spark, sf_dir), stage=0).select("page_id", "category", "text", "attr")


@query("stream_main_content", SQL_MAIN)
def stream_main_content(spark, sf_dir):
    """The same extraction over files that no run has taken yet."""
    base = ingest.shared_dir(spark, "content")
    stream = c.main_content(ingest.read_new(spark, f"{sf_dir}/pages.parquet", ingest.PAGE_TYPE))
    ingest.run(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
