from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from weblake.functions import urls as U
from weblake.operators.links import canonicalize, filter_links, page_kind, scope_test


def column(spark, expression, rows, names):
    return [r[0] for r in spark.createDataFrame(rows, names).select(expression).collect()]


def test_domain(spark):
    cases = {
        "www.shop.example": "www.shop.example",
        "a.b.c.example": "a.b.c.example",
        "www.shop.example.cn/asdf/asdf": "www.shop.example.cn",
        "wwww.a.b?a=b&b=c/asdf.asp": "wwww.a.b?a=b&b=c",
        "wwww.a.b?a=b": "wwww.a.b",
        "http://wwww.a.b?a=b&b=c/asdf.asp": "wwww.a.b",
        "https://user@h:8080/x": "user@h:8080",
    }
    got = column(spark, U.domain(F.col("u")), [(u,) for u in cases], ["u"])
    assert got == list(cases.values())


BASES = ("http://www.shop.example", "http://www.shop.example/b.html", "http://www.shop.example/a/b/c.html",
         "http://www.shop.example?a=1&b=2", "http://www.shop.example/a.html?a=1&b=2", "https://h.example/x/y/?q=1#top")
REFS = ("a.html", "/a.html", "../a/./b", "../../../../z", "?q=1", "#top", "//cdn.x/y", "//cdn.x", "./", "..", ".",
        "http://o.example/a/../b", "https://o.example", "javascript:x", "mailto:a@b", "a/b/../c/", "g?y/./x", "/./g/..",
        "d/")


def test_resolve_agrees_with_rfc(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    got = column(spark, U.resolve(F.col("b"), F.col("r")), rows, ["b", "r"])
    assert got == [urljoin(b, r) for b, r in rows]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b.c", "..", ".", "", "x y"]), min_size=1, max_size=6).map("/".join)
                .filter(lambda r: r and not r.startswith("//") and "//" not in r), min_size=20, max_size=60))
def test_resolve_paths(spark, refs):
    rows = [(b, r) for b in BASES for r in refs]
    got = column(spark, U.resolve(F.col("b"), F.col("r")), rows, ["b", "r"])
    assert got == [urljoin(b, r) for b, r in rows]


def test_empty_segments_stay(spark):
    assert column(spark, U.resolve(F.col("b"), F.col("r")), [("http://h/x//y", "a//b"), ("http://h", "/a//../b")],
                  ["b", "r"]) == ["http://h/x//a//b", "http://h/a/b"]


def test_empty_fragment_is_removed(spark):
    assert column(spark, U.resolve(F.col("b"), F.col("r")), [("http://h/a#b", "#"), ("http://h/a", "c#")],
                  ["b", "r"]) == ["http://h/a", "http://h/c"]


def test_add_www(spark):
    cases = {"http://a.b/c": "http://www.a.b/c", "http://www.a": "http://www.a", "https://www.a": "https://www.a",
             "wwww.x//y": "wwww.x//y", "a//b//c": "a//www.b//c"}
    assert column(spark, U.add_www(F.col("u")), [(u,) for u in cases], ["u"]) == list(cases.values())


LINKS = [(None, None), ("", None), ("javascript:x", None), ("mailto:a@b", None), ("#top", None), ("#", "http://h/p"),
         ("//cdn.x/y", "http://cdn.x/y"), ("?q=1", "http://h/p/?q=1"), ("../a/./b", "http://h/a/b"),
         ("x.jpeg", "http://h/p/x.jpeg"), ("x.jpg?y", None), ("X.JPG", "http://h/p/X.JPG"),
         ("https://facebook.com/z", None), ("d/", "http://h/p/d"), ("d//", "http://h/p/d/"),
         ("http://o/a/../b/", "http://o/a/../b"), ("http://o/#", None), ("a#b.c", "http://h/p/a#b.c")]


def test_links_of_a_blog(spark):
    df = spark.createDataFrame([("http://h/p/", r) for r, _ in LINKS], "url string, href string")
    got = {r.href: r.link for r in filter_links(canonicalize(df)).collect()}
    assert got == {r: l for r, l in LINKS if l}


def test_links_of_a_product_site_keep_the_slash(spark):
    df = spark.createDataFrame([("http://h/p/", "d/"), ("http://h/p/", "http://o/a/../b/")], "url string, href string")
    assert [r.link for r in canonicalize(df, blog=False).collect()] == ["http://h/p/d/", "http://o/a/../b/"]


@pytest.mark.parametrize("scope, admitted", [
    ("prefix", ["http://a.com/x", "http://a.com.evil"]), ("host", ["http://a.com/x", "https://a.com/x"]),
    ("none", ["http://a.com/x", "http://a.com.evil", "https://a.com/x"])])
def test_scope(spark, scope, admitted):
    df = spark.createDataFrame([("http://a.com/x",), ("http://a.com.evil",), ("https://a.com/x",)], ["link"])
    assert [r.link for r in df.filter(scope_test(F.col("link"), F.lit("http://a.com"), scope)).collect()] == admitted


def test_page_kind(spark):
    listing = ["http://h/2012/3/", "http://h/2012-03-07", "http://h/2012/12", "http://h/x?showComment=1", "http://h/page/2",
               "http://h/?cat=3", "http://h/a#b", "http://h/search?q", "http://h/index.php", "http://h/june/",
               "http://h/category/x", "http://h/2012_01_archive.html"]
    detail = ["http://h/2012/13", "http://h/a-post", "http://h/june-wedding", "http://h/JUNE", "http://h/2012/3/7/post"]
    df = spark.createDataFrame([(u,) for u in listing + detail], ["url"])
    assert [r.detailed for r in page_kind(df).collect()] == [0] * len(listing) + [1] * len(detail)
