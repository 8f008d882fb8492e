"""Registry of queries: a Spark job per name and, where it can be said in SQL, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.functions.urls import BINARY_SUFFIXES, STATIC_PAGE_QUERIES
from pagemill.operators.links import ANCHOR

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register


# -- SQL fragments ------------------------------------------------------------------------------

def sql_decode(x: str) -> str:
    """The entities that occur in the stored pages."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '[\s\p{{Z}}]+', '', 'g')"


def sql_ascii(x: str) -> str:
    """Characters beyond ASCII as numeric references."""
    return (f"list_aggregate(list_transform(string_split({x}, ''), lambda c: case when unicode(c) > 127 "
            "then '&#' || unicode(c) || ';' else c end), 'string_agg', '')")


_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def sql_part(url: str, i: int) -> str:
    """1 scheme, 2 host, 3 path, 4 query."""
    return f"regexp_extract({url}, '{_URL}', {i})"


def sql_list(values: list[str]) -> str:
    return ",".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_binary(url: str) -> str:
    path = f"split_part({sql_part(url, 3)}, ';', 1)"
    return f"(list_last(string_split(lower({path}), '.')) in ({sql_list(BINARY_SUFFIXES)}))"


def sql_clean_url(url: str) -> str:
    kept = (f"array_to_string(list_filter(string_split({sql_part(url, 4)}, '&'), lambda q: contains(q, '=') "
            "and not starts_with(q, 'spm') and not starts_with(q, 'utm_')), '&')")
    marks = " or ".join(f"contains({url}, '{m}')" for m in STATIC_PAGE_QUERIES)
    return f"""case when not starts_with({url}, 'http') then null
        when {marks} then split_part({url}, '?', 1)
        when {sql_binary(url)} then null
        else lower({sql_part(url, 1)}) || '://' || {sql_part(url, 2)}
          || case when {sql_part(url, 3)} = '' then '/' else {sql_part(url, 3)} end
          || case when {kept} = '' then '' else '?' || {kept} end end"""


# Root of a stored page's URL; all references in the stored pages start with /.
SQL_ROOT = r"regexp_extract(url, '^[a-z]+://[^/?#]*', 0)"
SQL_ANCHOR = "'" + ANCHOR.replace("'", "''") + "'"
SQL_PAGE_LINKS = f"""
  select distinct page_id, link from (
    select page_id, {sql_clean_url('ref')} as link from (
      select page_id, {SQL_ROOT} || unnest(regexp_extract_all(html, {SQL_ANCHOR}, 1)) as ref from pages))
  where link is not null"""
# One row per link in the navigation list, in order: position, raw and decoded parts.
SQL_NAV = f"""
  select page_id, url, i as pos, {sql_decode('hrefs[i]')} as href, {sql_decode('texts[i]')} as txt,
         hrefs[i] as raw_href, texts[i] as raw_txt
  from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hrefs,
               regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as texts from pages),
       lateral (select unnest(range(1, len(hrefs) + 1)) as i)"""
