"""URL columns against the standard library on hostile values."""

from urllib.parse import parse_qs, unquote, urlencode, urlparse

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from webtables.functions import urls

VALUES = [
    "https://a.example/p/q?x=1&id=2#f", "https://a.example", "HTTP://A.example/Path?ID=1", "/only/path?x", "//h.example/p?x=1#a?b",
    "https://a.example/a b/c?x=a b", "100%", "%zz%41%e3%83%96", "%ff%fe", "a+b%2Bc", "https://a.example/x;p=1?id=~*%7E&id=&=v&id", "",
    "https://a.example/x?id=1&&x=2&id=3", "https://a.example/?x=%E3%83%96#", "mailto:x@example.com?id=1", "https://a.example/a;b/c;d?id=1",
    "?id=4", "#only", "https://a.example/%3Fx=1%23y", "https://a.example?id=+%20+",
]


def keep(url, names):
    parts = urlparse(url)
    kept = {k: v for k, v in parse_qs(parts.query, keep_blank_values=True).items() if k in names}
    return parts._replace(query=urlencode(kept, doseq=True)).geturl()


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


CASES = {
    "url_decode": (urls.url_decode, unquote),
    "path_only": (urls.path_only, lambda u: urlparse(u).path or u),
    "page_to_path": (urls.page_to_path, lambda u: urlparse(u).path),
    "strip_qs": (urls.strip_qs, lambda u: urlparse(u)._replace(query="", fragment="").geturl()),
    "keep_qs": (lambda c: urls.keep_qs(c, ["id", "x"]), lambda u: keep(u, ["id", "x"])),
    "normalize_page": (urls.normalize_page, lambda u: unquote(u).split("?", 1)[0].split("#", 1)[0].lower()),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_standard_library(spark, name):
    function, expected = CASES[name]
    assert apply(spark, function, VALUES) == [expected(v) for v in VALUES]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1/?#&=%+;~*. é", max_size=14), min_size=40, max_size=60))
def test_random_tails(spark, tails):
    values = ["https://h.example/" + t for t in tails]
    for name in ("url_decode", "path_only", "normalize_page", "strip_qs", "keep_qs"):
        function, expected = CASES[name]
        assert apply(spark, function, values) == [expected(v) for v in values], name


def test_null_stays_null(spark):
    assert apply(spark, urls.normalize_page, [None]) == [None]


def test_hosts(spark):
    values = ["https://www.Shop.example/a", "www.shop.example", "shop.example?x", None]
    assert apply(spark, urls.normalize_domain, values) == ["shop.example", "shop.example", "shop.example", None]
    private = ["localhost", "http://localhost:8080/x", "127.0.0.1:99", "10.1.2.3", "172.31.0.9:1", "172.32.0.9", "192.168.0.1", "[::1]:80", "9.9.9.9", "localhost.example", None]
    assert apply(spark, urls.is_private_source, private) == [True, True, True, True, True, False, True, True, False, False, False]


def test_slashes(spark):
    assert apply(spark, urls.trailing_slash, ["/a/b", "/a/b/", "/a/b.pdf", "/v1.2/b", "", "x.html"]) == ["/a/b/", "/a/b/", "/a/b.pdf", "/v1.2/b/", "/", "x.html"]
    assert apply(spark, urls.site_key, ["https://a.example/", " http://a.example ", "sc-domain:a.example/"]) == ["https://a.example", "http://a.example", "sc-domain:a.example/"]
