"""Links out of pages and joins along them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.common import let, strip
from pagemill.functions.urls import clean_url, url_resolve, url_resolve_all
from pagemill.sources.shared import shared_dir, written

# Fixed value: anchors in raw markup, the reference in the first group.
ANCHOR = r"""(?is)<a[^>]*?href=['"]?([^> '"]+)[^>]*?>(.*?)</a>"""
# Attributes that hold one URL, and the one that holds several.
URL_ATTRIBUTES = ["action", "background", "cite", "classid", "codebase", "data", "formaction", "href", "longdesc", "profile",
                  "src", "usemap", "dynsrc", "lowsrc"]
URL_LIST_ATTRIBUTE = "archive"
# The URL of a refresh, and URLs in style sheets.
REFRESH = r"(?is)^([^;=]*;\s*(?:url\s*=\s*)?)(['\"]?)(.*?)\2\s*$"
STYLE_URL = r"(?i)(url\(\s*['\"]?|@import\s+['\"])([^'\")]+)"


def extract_links(url: Column, html: Column) -> Column:
    """Distinct canonical links of one page, from its raw markup.

    The set is built inside the page's row, so no shuffle is needed.  A match
    ends at an end tag, so what follows the last one is cut off first: every
    anchor tried then finds an end, and a page of unclosed anchors takes no
    more time than others.
    """
    closed = F.regexp_extract(html, "(?is)^.*</a>", 0)
    refs = F.filter(F.transform(F.regexp_extract_all(closed, F.lit(ANCHOR), F.lit(1)), strip), lambda r: r != "")
    links = F.transform(url_resolve_all(url, F.array_distinct(refs)), clean_url)
    return F.array_distinct(F.filter(links, lambda l: l.isNotNull()))


def page_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(extract_links(F.col("url"), F.col("html"))).alias("link"))


# -- absolute links -----------------------------------------------------------------------------------

def base_url(url: Column, nodes: Column) -> Column:
    """What a page's references are relative to: its first <base href>, else its URL."""
    bases = F.filter(nodes, lambda x: (x["tag"] == "base") & x["attrs"]["href"].isNotNull())
    return let(F.get(bases, F.lit(0)), lambda b: F.when(
        b.isNotNull(), url_resolve(url, strip(b["attrs"]["href"]))).otherwise(url))


def absolute_style(url: Column, css: Column) -> Column:
    """A style sheet with its references made absolute."""
    def rebuilt(refs: Column) -> Column:
        fixed = url_resolve_all(url, F.transform(refs, strip))
        parts = F.arrays_zip(F.split(css, STYLE_URL, -1).alias("gap"), F.regexp_extract_all(css, F.lit(STYLE_URL), F.lit(1)).alias("lead"),
                             fixed.alias("ref"))
        return F.array_join(F.transform(parts, lambda p: F.concat(
            p["gap"], F.coalesce(p["lead"], F.lit("")), F.coalesce(p["ref"], F.lit("")))), "")

    return F.when(css.rlike(STYLE_URL), let(F.regexp_extract_all(css, F.lit(STYLE_URL), F.lit(2)), rebuilt)).otherwise(css)


def absolute_attrs(url: Column, attrs: Column, tag: Column | None = None) -> Column:
    """An element's attributes with its references made absolute.

    ``tag`` tells meta elements, whose refresh is a reference as well.
    """
    refresh = F.lit(False) if tag is None else (tag == "meta") & (F.lower(attrs["http-equiv"]) == "refresh")
    several = lambda v: F.array_join(url_resolve_all(url, F.split(strip(v), r"\s+")), " ")

    def one(k: Column, v: Column) -> Column:
        return (F.when(k.isin(URL_ATTRIBUTES), url_resolve(url, strip(v)))
                .when(k == URL_LIST_ATTRIBUTE, several(v))
                .when(k == "style", absolute_style(url, v))
                .when((k == "content") & refresh & v.rlike(REFRESH), F.concat(
                    F.regexp_extract(v, REFRESH, 1), url_resolve(url, F.regexp_extract(v, REFRESH, 3))))
                .otherwise(v))

    return F.transform_values(attrs, one)


# -- hops ---------------------------------------------------------------------------------------------

def request_url(url: Column) -> Column:
    """A URL as it is asked for: all of it but the fragment."""
    return F.substring_index(url, "#", 1)


def page_keys(pages: DataFrame, canonical: bool = False) -> DataFrame:
    """_to, page_id, page_url: one page per key, that with the smallest id; pages without a key drop out.

    The key is the request URL, so different pages keep different keys; with
    ``canonical`` it is the cleaned URL, which folds tracked and cut ones.
    """
    key = clean_url(F.col("url")) if canonical else request_url(F.col("url"))
    rows = pages.select(F.explode(F.array_compact(F.array(key))).alias("_to"), "page_id", F.col("url").alias("page_url"))
    return rows.groupBy("_to").agg(F.min(F.struct("page_id", "page_url")).alias("p")).select("_to", "p.*")


def with_canonical(rows: DataFrame, url: str, name: str) -> DataFrame:
    """Add the canonical form of a URL column; rows not to be followed drop out.

    Exploding an array of at most one keeps the URL work to one evaluation per
    row; a filter on the column would repeat it.
    """
    return rows.withColumn(name, F.explode(F.array_compact(F.array(clean_url(F.col(url))))))


def follow_links(links: DataFrame, pages: DataFrame, link: str = "link", canonical: bool = False, how: str = "inner") -> DataFrame:
    """One hop: every link row with page_id and page_url of the page it leads to (H2).

    A link finds one page at most, so the result has no more rows than the
    links.  Repeated links are followed again, as there is no visited set.
    Only keys and ids are shuffled, never page texts, and both sides by the
    join itself: a target named by a large share of the rows is split at run
    time by AQE's skew join, whatever the way the pages are stored.
    """
    key = clean_url(F.col(link)) if canonical else request_url(F.col(link))
    # a key of its own, so that the pages' side is dealt out for the join as well: AQE splits joins between two shuffles only
    marked = lambda c: F.concat(F.lit("="), c)
    keyed = links.withColumn("_from", marked(key))
    return keyed.join(page_keys(pages, canonical).withColumn("_to", marked("_to")), F.col("_from") == F.col("_to"), how).drop("_from", "_to")


def save_site(pages: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store pages bucketed by their id, so that crawls look pages up without shuffling their texts."""
    (pages.write.mode("overwrite").option("path", path).bucketBy(buckets, "page_id").sortBy("page_id").saveAsTable(table))
    return pages.sparkSession.table(table)


Stage = Callable[[DataFrame], DataFrame]


def staged_crawl(seeds: DataFrame, pages: DataFrame, stages: list[Stage], carry: list[str],
                 visited: DataFrame | None = None, canonical: bool = False, folder: str | None = None,
                 dedupe_frontier: bool = False) -> DataFrame:
    """Fixed-depth crawl over stored pages (H3).

    Each stage turns pages (page_id, url, html) into rows with their page_id
    and a ``link`` column (the last stage into records); ``carry`` columns
    travel from hop to hop.  A page is handed to the stage once, however many
    links lead to it, and what it gives is joined back to all of them.  Each
    hop's rows are written below ``folder`` (the shared one by default), so
    later hops don't compute them again.
    Links in ``visited`` (canonical URLs) are left out when it is given.  With
    ``dedupe_frontier`` a page is reached once in the whole crawl, at the first
    hop that leads to it and with the least values of ``carry`` among that hop's
    links: the ids of each hop are stored, and the next ones leave them out.
    """
    folder = folder or shared_dir(seeds.sparkSession, "crawl")
    frontier, reached_before = seeds, []
    for number, stage in enumerate(stages):
        if visited is not None:
            seen = visited.select(F.col("canonical").alias("_to"))
            frontier = frontier.withColumn("_to", clean_url(F.col("link"))).join(seen, "_to", "left_anti").drop("_to")
        found = follow_links(frontier, pages, canonical=canonical).select(*carry, "page_id")
        if dedupe_frontier:
            found = found.groupBy("page_id").agg(F.min(F.struct(*carry, F.lit(0).alias("_any"))).alias("_first")).select(
                *(F.col(f"_first.{c}").alias(c) for c in carry), "page_id")
            for ids in reached_before:
                found = found.join(ids, "page_id", "left_anti")
        hops = written(found, f"{folder}/hop-{number}")
        reached_before.append(hops.select("page_id"))
        reached = pages.select("page_id", "url", "html").join(hops.select("page_id").distinct(), "page_id", "left_semi")
        frontier = hops.join(stage(reached), "page_id").drop("page_id")
    return frontier


# -- request batches ----------------------------------------------------------------------------------

def request_batch(urls: Column, form_datas: Column | None = None) -> Column:
    """Array of struct(index, url, method, form_data).

    Form data all go to the first URL by POST; otherwise one GET per URL.
    """
    if form_datas is None:
        return F.transform(urls, lambda u, i: F.struct(
            i.alias("index"), u.alias("url"), F.lit("GET").alias("method"),
            F.lit(None).cast("string").alias("form_data")))
    return F.transform(form_datas, lambda d, i: F.struct(
        i.alias("index"), F.get(urls, F.lit(0)).alias("url"), F.lit("POST").alias("method"),
        d.alias("form_data")))


# Fixed value: the status of a request that got no response.
FAILED = -1


def indexed_batch(batches: DataFrame, requests: Column, pages: DataFrame) -> DataFrame:
    """Responses of request batches at their position (H6): response_page and status.

    A request without a stored page stays, with status -1 and no page; pages
    without a status column answer 200.
    """
    rows = batches.withColumn("_request", F.explode(requests)).select(
        *batches.columns, "_request.*").withColumnRenamed("url", "request_url")
    answers = follow_links(rows, pages, "request_url", how="left").drop("page_url").withColumnRenamed("page_id", "response_page")
    if "status" not in pages.columns:
        return answers.withColumn("status", F.when(F.col("response_page").isNull(), FAILED).otherwise(200))
    states = pages.groupBy(F.col("page_id").alias("_page")).agg(F.min("status").alias("status"))
    return (answers.join(states, F.col("response_page") == F.col("_page"), "left").drop("_page")
            .withColumn("status", F.coalesce("status", F.lit(FAILED))))
