from __future__ import annotations

import datetime as dt
import random
from urllib.parse import quote, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators.links import extract_links, page_links

BASES = ["http://h.com/a/b", "http://h.com", "https://u@h.com:80/a/b/?x=1#f", "http://h.com/a/;k", "http://h.com/a//b/c?q"]
REFS = ["http://x/y", "//h/p", "/p", "?q", "#f", "", "../../c", "./c", "javascript:void(0)", "c/d", "..", ".", "/a/../b",
        "HTTP://Q/z", "a//b", "x;p=1", "/", "../../../z?k#l", "mailto:x@y", "http:rel", "b/./c/../d/", "?", "x#", ";y"]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_resolve_like_the_standard_library(spark):
    cases = [(b, r, urljoin(b, r)) for b in BASES for r in REFS]
    rows = spark.createDataFrame(cases, "b string, r string, want string")
    got = rows.select("b", "r", "want", urls.url_resolve(F.col("b"), F.col("r")).alias("got"))
    assert got.where("got is distinct from want").collect() == []


@pytest.mark.parametrize("url,want", [
    ("ftp://a/b", None), ("HTTP://a/b", None), ("http://a", "http://a/"), ("http://a/x.PDF", None),
    ("http://a/x.pdf;v=1", None), ("http://a/x.html?utm_a=1#f", "http://a/x.html"),
    ("http://a/x?spm=1&k=2&flag#f", "http://a/x?k=2"), ("http://a/?q=x.html?y", "http://a/"),
    ("javascript:void(0)", None), ("mailto:x@y", None), ("http://A/x;p?b=1&a=2&spmx=3", "http://A/x;p?b=1&a=2"),
    ("https://a/pdf", "https://a/pdf"), ("http://a/x.tar.gz?k=1", None), ("http://a/x.shtm?#", "http://a/x.shtm"),
])
def test_clean_url(spark, url, want):
    assert column(spark, [url], urls.clean_url) == [want]


def test_clean_url_is_stable(spark):
    cleaned = column(spark, ["http://a/x?spm=1&k=2&flag#f", "http://a", "http://a/b;c?d=1&utm_e=2"], urls.clean_url)
    assert column(spark, cleaned, urls.clean_url) == cleaned


def test_host_suffix_and_params(spark):
    assert column(spark, ["http://u@h:8/p?x", "mailto:a@b", "//h2/x", "nothing"], urls.url_host) == ["u@h:8", "", "h2", ""]
    assert column(spark, ["a.PDF", "a.shtml", "a.7z", "a.php", "pdf"], urls.suffix_class) == [
        "file", "page", "file", "none", "none"]
    assert column(spark, ["h?a=1&b=2", "h?classid=13", "plain"], urls.last_param) == ["2", "13", "plain"]


def test_encode_like_the_standard_library(spark):
    texts = ["word", "a b", "~x*", "a/b?c=d&e", "工行", "(1)!'\"", "+%"]
    assert column(spark, texts, urls.percent_encode) == [quote(t) for t in texts]


def test_numbered_urls(spark):
    counts = spark.createDataFrame([("a", 0), ("b", 2), ("c", 25)], "k string, n long")
    rows = urls.numbered_rows(counts, "http://h/?class=%s&course=%s", "k", "n", chunk=10)
    got = sorted(r.url for r in rows.collect())
    want = sorted(f"http://h/?class={k}&course={i}" for k, n in (("b", 2), ("c", 25)) for i in range(1, n + 1))
    assert got == want
    small = counts.select(urls.numbered_urls("%s-%s", F.col("k"), F.col("n")).alias("u")).where("size(u) < 3")
    assert sorted(r.u for r in small.collect()) == [[], ["b-1", "b-2"]]


def test_dated_url(spark):
    assert column(spark, ["http://h/%s/x"], lambda c: urls.dated_url(c, dt.date(2031, 5, 1))) == ["http://h/2031/x"]


def test_links_of_raw_markup(spark):
    html = ("<a href='/x?utm_a=1'>1</a><A class=c HREF=/y>2</A><a href=\"/x\">again</a><!-- <a href='/in-comment'>c</a> -->"
            "<a href='/z.zip'>file</a><a href='javascript:go()'>js</a><a href='/open'>runs on <p><a href='/inner'>to here</a>"
            "<a name=n>none</a><a href=\" /blank \">b</a>")
    rows = spark.createDataFrame([("http://h/d/e", html)], "url string, html string")
    got = rows.select(extract_links(F.col("url"), F.col("html")).alias("l")).first().l
    assert got == ["http://h/x", "http://h/y", "http://h/in-comment", "http://h/open"]


# -- random URLs against the standard library -----------------------------------------------------------

def random_url(rng, absolute):
    def word():
        return rng.choice(["a", "b.html", "c.PDF", "x.tar.gz", "..", ".", "", "d;p=1", "é", "e f", "g%20h", "index.shtml", "7z", "v.7Z"])

    path = "/".join(word() for _ in range(rng.randint(0, 4)))
    query = "&".join(rng.choice(["k=1", "utm_source=x", "spm=a.b", "flag", "=v", "q=x.html?y", "spmx=1", "a=b=c", ""])
                     for _ in range(rng.randint(0, 4)))
    url = path + rng.choice(["", "?" + query]) + rng.choice(["", "", "#top", "#a?b"])
    if absolute or rng.random() < 0.3:
        return rng.choice(["http://h.com", "https://H.com:8", "http://u@h", "https://h.org"]) + rng.choice(["", "/"]) + url
    return rng.choice(["", "/", "./", "../", "//x.y/", "ftp://f/", "data:", "HTTP://Up/"]) + url


def cleaned(url):
    """The rules for canonical URLs, on the standard library's parts."""
    if not url.startswith("http"):
        return None
    if any(mark in url for mark in urls.STATIC_PAGE_QUERIES):
        return url.partition("?")[0]
    parts = urlparse(url)
    path = parts.path or "/"
    if path.rpartition(".")[2].lower() in urls.BINARY_SUFFIXES:
        return None
    kept = [q for q in parts.query.split("&") if "=" in q and not q.startswith(("spm", "utm_"))]
    return parts._replace(path=path, query="&".join(kept), fragment="").geturl()


def test_random_urls(spark):
    rng = random.Random(11)
    many = [random_url(rng, True) for _ in range(3000)] + [random_url(rng, False) for _ in range(1000)]
    got = column(spark, many, urls.clean_url)
    wrong = [(u, cleaned(u), g) for u, g in zip(many, got) if cleaned(u) != g]
    assert not wrong, (len(wrong), wrong[:5])
    for link in filter(None, got):
        assert link.startswith("http") and "#" not in link


def test_random_references(spark):
    rng = random.Random(12)
    cases = [(random_url(rng, True), random_url(rng, False)) for _ in range(3000)]
    rows = spark.createDataFrame([(b, r, urljoin(b, r)) for b, r in cases], "b string, r string, want string")
    got = rows.select("b", "r", "want", urls.url_resolve(F.col("b"), F.col("r")).alias("got"))
    wrong = got.where("got is distinct from want").collect()
    assert not wrong, (len(wrong), wrong[:5])


def test_links_are_distinct_per_page(spark):
    links = page_links(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert links.count() == links.distinct().count() > 0
