"""URL functions as Column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.common import let

# Suffixes of binary downloads.
BINARY_SUFFIXES = [
    "exe", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "pdf",
    "jpg", "png", "bmp", "jpeg", "gif",
    "zip", "rar", "tar", "bz2", "7z", "gz",
    "flv", "mp4", "avi", "wmv", "mkv",
    "apk",
]

# Static page suffixes followed by a query.
STATIC_PAGE_QUERIES = [".html?", ".htm?", ".shtml?", ".shtm?"]

# Suffixes checked on links, and those of them that are files.
CHECKED_SUFFIXES = [".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".pdf", ".html", ".htm", ".shtml", ".shtm",
                    ".zip", ".rar", ".tar", ".bz2", ".7z", ".gz"]
FILE_SUFFIXES = [".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".pdf", ".zip", ".rar", ".tar", ".bz2", ".7z", ".gz"]

_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:(.*)))?$"
_LAST_SEGMENT = r"^((?:.*/)?[^/;]*)(?:;([^/]*))?$"


def _parts(url: Column) -> Column:
    """scheme, host, path, params, query, fragment; a missing part is ''."""
    names = ("scheme", "host", "path", "query", "fragment")
    cut = F.struct(*(F.regexp_extract(url, _URL, i).alias(n) for i, n in enumerate(names, 1)))
    return let(cut, lambda u: F.struct(
        F.lower(u["scheme"]).alias("scheme"), u["host"],
        F.regexp_extract(u["path"], _LAST_SEGMENT, 1).alias("path"),
        F.regexp_extract(u["path"], _LAST_SEGMENT, 2).alias("params"),
        u["query"], u["fragment"]))


def _assemble(scheme: Column, host: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    def after(mark: str, part: Column) -> Column:
        return F.when(part != "", F.concat(F.lit(mark), part)).otherwise("")

    has_host = (host != "") | scheme.isin("http", "https", "ftp", "file")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(has_host, F.concat(F.lit("//"), host)).otherwise(""),
        F.when(has_host & (path != "") & ~path.startswith("/"), F.lit("/")).otherwise(""),
        path, after(";", params), after("?", query), after("#", fragment),
    )


def _fold_dots(segments: Column) -> Column:
    """Resolve . and .. segments; a trailing one leaves a directory."""
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))))
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)


def url_resolve_all(base: Column, refs: Column) -> Column:
    """Absolute URLs of the references found on the page ``base``; the base is taken apart once (F1)."""

    def relative(b: Column, r: Column) -> Column:
        base_dir = F.regexp_replace(b["path"], r"[^/]+$", "")
        merged = F.when(r["path"].startswith("/"), F.split(r["path"], "/")).otherwise(
            let(F.split(F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir), r["path"]), "/"),
                # doubled slashes collapse, but not at the two ends
                lambda s: F.filter(s, lambda v, i: (v != "") | (i == 0) | (i == F.size(s) - 1))))
        plain = F.when(~r["path"].contains("./") & ~r["path"].endswith(".") & r["path"].startswith("/"), r["path"])
        path = F.coalesce(plain, let(F.array_join(_fold_dots(merged), "/"),
                                     lambda p: F.when(p == "", F.lit("/")).otherwise(p)))
        return (
            F.when(r["host"] != "",
                   _assemble(r["scheme"], r["host"], r["path"], r["params"], r["query"], r["fragment"]))
            .when((r["path"] == "") & (r["params"] == ""),
                  _assemble(b["scheme"], b["host"], b["path"], b["params"],
                            F.when(r["query"] == "", b["query"]).otherwise(r["query"]), r["fragment"]))
            .otherwise(_assemble(b["scheme"], b["host"], path, r["params"], r["query"], r["fragment"])))

    def resolve(b: Column, ref: Column) -> Column:
        def known(r: Column) -> Column:
            scheme = F.when(r["scheme"] == "", b["scheme"]).otherwise(r["scheme"])
            return F.when(scheme != b["scheme"], ref).otherwise(
                let(r.withField("scheme", scheme), lambda v: relative(b, v)))
        return F.when(ref == "", base).otherwise(let(_parts(ref), known))

    return let(_parts(base), lambda b: F.transform(refs, lambda r: resolve(b, r)))


def url_resolve(base: Column, ref: Column) -> Column:
    """Absolute URL of one reference found on the page ``base`` (F1)."""
    return F.get(url_resolve_all(base, F.array(ref)), F.lit(0))


def suffix_of(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def is_binary_url(url: Column) -> Column:
    """Whether the path ends in a binary suffix; ;params, query and fragment do not count."""
    return suffix_of(F.regexp_extract(F.regexp_extract(url, _URL, 3), _LAST_SEGMENT, 1)).isin(BINARY_SUFFIXES)


def clean_url(url: Column) -> Column:
    """Canonical URL, or NULL when the URL is not to be followed (F2)."""
    static_page = F.lit(False)
    for mark in STATIC_PAGE_QUERIES:
        static_page = static_page | url.contains(mark)

    def rebuild(p: Column) -> Column:
        path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
        kept = F.filter(
            F.split(p["query"], "&"),
            lambda q: q.contains("=") & ~q.startswith("spm") & ~q.startswith("utm_"))
        return F.when(~suffix_of(path).isin(BINARY_SUFFIXES), _assemble(
            p["scheme"], p["host"], path, p["params"], F.array_join(kept, "&"), F.lit("")))

    return (F.when(~url.startswith("http"), F.lit(None).cast("string"))
            .when(static_page, F.substring_index(url, "?", 1))
            .otherwise(let(_parts(url), rebuild)))


def url_host(url: Column) -> Column:
    """Host with user and port, '' when the URL has none."""
    return F.regexp_extract(url, _URL, 2)


def last_param(url: Column) -> Column:
    """Value of the last query parameter."""
    return F.element_at(F.split(F.element_at(F.split(url, "&"), -1), "="), -1)


def suffix_class(url: Column) -> Column:
    """'file', 'page' or 'none' by the suffix a URL ends in."""
    def ends(suffixes: list[str]) -> Column:
        return F.lower(url).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")

    return F.when(ends(FILE_SUFFIXES), "file").when(ends(CHECKED_SUFFIXES), "page").otherwise("none")


def numbers_to(n: Column) -> Column:
    """1..n as an array, empty when n is 0."""
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<long>"))


def numbered_urls(template: str, key: Column, n: Column) -> Column:
    """One URL per number 1..n, none when n is 0, for counts taken within one page."""
    return F.transform(numbers_to(n), lambda i: F.format_string(template, key, i))


def numbered_rows(counts: DataFrame, template: str, key: str, n: str, name: str = "url",
                  chunk: int = 10_000) -> DataFrame:
    """One row per number 1..n and key, for counts over whole groups.

    Numbers are made in chunks of chunks, spread over the cluster at each
    step, so a key with a huge count is no single array and no single task.
    """
    def cut(rows: DataFrame, total: Column, size: int, part: str) -> DataFrame:
        return rows.select("*", F.explode(numbers_to(F.ceil(total / size))).alias(part)).repartition(key, part)

    large = chunk * chunk
    outer = cut(counts, F.col(n), large, "_outer")
    left = F.least(F.col(n) - (F.col("_outer") - 1) * large, F.lit(large))
    inner = cut(outer, left, chunk, "_inner")
    begin = (F.col("_outer") - 1) * large + (F.col("_inner") - 1) * chunk
    size = F.least(F.col(n) - begin, F.lit(chunk))
    numbers = F.transform(numbers_to(size), lambda i: F.format_string(template, F.col(key), i + begin))
    return inner.select(*counts.columns, F.explode(numbers).alias(name))


def dated_url(template: Column, run_date: dt.date) -> Column:
    """Put the year of the run into a seed URL."""
    return F.replace(template, F.lit("%s"), F.lit(f"{run_date:%Y}"))


def percent_encode(col: Column) -> Column:
    """Percent-encoding that keeps letters, digits, ``_.-~`` and ``/`` (F8)."""
    encoded = F.url_encode(col)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return encoded
