from __future__ import annotations

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagemill.functions import naming as N
from pagemill.functions import urls as U
from pagemill.functions import values as V


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://A.com/Book/12/?utm_source=x&b=2&a=1#frag", "https://a.com/Book/12?a=1&b=2"),
        ("http://a.com:80/x", "http://a.com/x"),
        ("https://a.com:443/x", "https://a.com/x"),
        ("https://a.com:8443/x", "https://a.com:8443/x"),
        ("https://a.com/", "https://a.com/"),
        ("https://a.com/x//", "https://a.com/x"),
        ("https://a.com/?T=1&Rand=2&SID=3&spm=4&from=5", "https://a.com/"),
        ("https://a.com/?q=a%20b&q=%7E*", "https://a.com/?q=a+b&q=~%2A"),
        ("https://a.com/?empty=&x", "https://a.com/?empty=&x="),
        ("https://a.com/?q=100%", "https://a.com/?q=100%25"),
        ("", ""),
    ],
)
def test_normalize_url(one, raw, want):
    assert one(U.normalize_url(F.lit(raw))) == want


def test_normalize_url_is_idempotent(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        query = "&".join(rng.choice(["a=1", "b=%41", "utm_x=1", "c=x+y", "d", "e=%zz", "中=文"]) for _ in range(rng.randint(0, 4)))
        rows.append((f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['A.com', 'b.org:80', 'c.net:443'])}{rng.choice(['', '/', '/x/', '/X//'])}?{query}#f",))
    df = spark.createDataFrame(rows, "u string").select(U.normalize_url("u").alias("a"))
    assert df.filter(F.col("a") != U.normalize_url("a")).count() == 0


def test_url_join_follows_the_standard(spark):
    refs = ["g", "./g", "g/", "/g", "//h/x", "?y", "g?y", "#s", "../g", "../../g", "../../../g", "..", ".", "http://z/a", "mailto:x", "", "/a/./b/../c"]
    rows = [(b, r) for b in ("http://a/b/c/d;p?q", "http://a", "https://x.com/k/l/m") for r in refs]
    for r in spark.createDataFrame(rows, "b string, r string").select("b", "r", U.url_join("b", "r").alias("j")).collect():
        assert r["j"] == urljoin(r["b"], r["r"]), (r["b"], r["r"])


@pytest.mark.parametrize(
    ("value", "want"),
    [("/a", True), ("book/1", True), ("chapter.html", True), ("https://a.com", True), ("//a", True), ("三体", False), ("two words/x", False), ("", False)],
)
def test_looks_like_url(one, value, want):
    assert one(U.looks_like_url(F.lit(value))) is want


def test_identity(one):
    key = lambda s, u: one(U.identity_key(F.lit(s).cast("string"), F.lit(u), F.lit(3), F.lit("T")))
    assert key("c1", "https://a.com/x") == "sid:c1"
    assert key(None, "https://A.com/x/") == "url:https://a.com/x"
    assert key("", "") == "idx:3:T"
    assert one(U.candidate_keys(F.lit("c1"), F.lit("https://a.com/x"), F.lit(3), F.lit("T"))) == ["sid:c1", "url:https://a.com/x"]


def test_request_key(one):
    def key(url, params=None, method="GET", body=None, headers=None):
        as_map = lambda m: F.create_map(*[F.lit(x) for p in m.items() for x in p])
        return one(U.request_key(F.lit("s"), F.lit(method), F.lit(url), as_map(params) if params else None,
                                 F.lit(body) if body else None, as_map(headers) if headers else None))

    base = key("https://a.com/s", {"q": "x", "page": "1"})
    assert base == key("https://a.com/s", {"page": "1", "q": "x"}) == key("https://a.com/s?page=1", {"q": "x", "utm_a": "z"})
    assert base != key("https://a.com/s", {"q": "y", "page": "1"})
    assert key("https://a.com/s", method="post", body="a") != key("https://a.com/s", method="post", body="b")
    assert key("https://a.com/s", headers={"Cookie": "1"}) == key("https://a.com/s", headers={"cookie": "2"}) != key("https://a.com/s")
    assert key("https://a.com/s", headers={"User-Agent": "1"}) == key("https://a.com/s")


@pytest.mark.parametrize(
    ("raw", "want"),
    [('a<b>:"/\\|?*c', "a_b________c"), ("CON", "_CON"), ("lpt1.txt", "_lpt1.txt"), ("   ", "untitled"), ("..", "untitled"), ("a  b.", "a b"), ("x" * 200, "x" * 150)],
)
def test_sanitize(one, raw, want):
    assert one(N.sanitize_component(F.lit(raw))) == want


def test_templates(one):
    values = F.create_map(F.lit("title"), F.lit("T{{author}}"), F.lit("book.url"), F.lit("u"))
    assert one(N.render_template(F.lit("[{{ title }}|{{none}}|{{book.url}}]"), values)) == "[T{{author}}||u]"
    assert one(N.unknown_variables(F.lit("{{book.url}}/{{page}}/{{page}}"), values)) == ["page"]


@pytest.mark.parametrize("name", ["..", ".", "", "a/b", "a\\b", "a\x00b"])
def test_unsafe_names(one, name):
    assert one(N.is_unsafe_component(F.lit(name))) is True


def test_retry(one):
    assert [one(V.retry_delay(F.lit(a))) for a in (0, 1, 2, 10)] == [1.0, 2.0, 4.0, 60.0]
    assert one(V.retry_delay(F.lit(0), F.lit(120.0))) == 60.0
    assert one(V.retry_delay(F.lit(0), F.lit(5.0))) == 5.0
    assert 3.0 <= one(V.retry_delay(F.lit(2), jitter=0.25, seed=1)) <= 5.0
    assert one(V.parse_retry_after(F.lit("Wed, 21 Oct 2015 07:28:00 GMT"))) is None
    assert one(V.is_retryable(F.lit("NETWORK_HTTP_STATUS"), F.lit(503), F.lit(0))) is True
    assert one(V.is_retryable(F.lit("NETWORK_HTTP_STATUS"), F.lit(429), F.lit(2))) is True
    assert one(V.is_retryable(F.lit("NETWORK_HTTP_STATUS"), F.lit(404), F.lit(0))) is False
    assert one(V.is_retryable(F.lit("NETWORK_TIMEOUT"), F.lit(None).cast("int"), F.lit(3))) is False


def test_charset(one):
    headers = lambda v: F.create_map(F.lit("Content-Type"), F.lit(v))
    meta = F.lit(b'<meta charset="gb2312">')
    assert one(V.detect_charset(meta, headers("text/html; charset=Big5"))) == "big5"
    assert one(V.detect_charset(meta, headers("text/html"))) == "gb18030"
    assert one(V.detect_charset(F.lit(b'<meta http-equiv="x" content="text/html; charset=euc-kr">'), headers("x"))) == "euc-kr"
    assert one(V.detect_charset(F.lit(b"plain"), headers("x"))) == "utf-8"
    assert one(V.detect_charset(F.lit(b" " * 4096 + b'<meta charset="gbk">'), headers("x"))) == "utf-8"


def test_decode(one):
    assert one(V.decode_body(F.lit("三体é".encode("gb18030")), F.lit("gb18030"))) == "三体é"
    assert one(V.decode_body(F.lit("三体".encode()), F.lit("utf-8"))) == "三体"
    assert one(V.decode_body(F.lit(b"a\xffb"), F.lit("utf-8"))) == "a�b"
    assert one(V.decode_body(F.lit("é".encode("latin-1")), F.lit("ISO-8859-1"))) == "é"


def test_asset_suffix(one):
    assert one(V.asset_suffix(F.lit("http://x/img?id=1"), F.lit("image/jpeg; q=1"))) == ".jpg"
    assert one(V.asset_suffix(F.lit("http://x/a.PNG?x=1"), F.lit("text/plain"))) == ".png"
    assert one(V.asset_suffix(F.lit("http://x/a.svg"), F.lit("image/svg+xml"))) is None
    assert one(V.asset_suffix(F.lit("http://x/a"), F.lit(None).cast("string"))) is None


def test_progress(one):
    assert one(V.task_progress(F.lit(3), F.lit(1), F.lit(8))) == 0.5
    assert one(V.task_progress(F.lit(9), F.lit(1), F.lit(8))) == 1.0
    assert one(V.task_progress(F.lit(9), F.lit(1), F.lit(0))) == 0.0
