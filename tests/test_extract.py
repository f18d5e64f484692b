from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagemill.operators import extract as E
from pagemill.operators import html as H
from pagemill.operators import transforms as T
from pagemill.operators import paging, rules

SEARCH = """<html><body><ul>
<li class="book-item new"><a href="/b/1"><span class="title"> One  Book </span></a><i class="author">A</i><img src="1.jpg"></li>
<li class="book-item"><a href="b/2"><span class="title">Two &amp; more</span></a><i class="author">B</i><img src="//c.com/2.jpg"></li>
<li class="book-item"><a href="https://x.com/3"><span class="title">Three</span></a></li>
</ul></body></html>"""
CHAPTER = """<html><head><style>p{}</style></head><body><div class="advert">buy</div>
<div id="content"><p>First</p><script>var x = "<p>no</p>";</script><p>Second<br>line</p><div class="advert">ad</div></div>
<nav class="chapter-nav">next</nav></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame([(1, "s", "https://e.com/list/", SEARCH), (2, "s", "https://e.com/c/", CHAPTER)], "id int, source_id string, url string, html string")
    return H.shred_html(df).cache()


def values(pages, page, selector, attribute="text"):
    found = E.css_values(F.struct("page_text", "html"), F.col("nodes"), H.parse_selector(F.lit(selector)), F.lit(attribute))
    return pages.filter(F.col("id") == page).select(found.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("page", "selector", "attribute", "want"),
    [
        (1, ".title", "text", ["One Book", "Two & more", "Three"]),
        (1, "li.book-item.new a", "href", ["/b/1"]),
        (1, "ul > li > i", "text", ["A", "B"]),
        (1, "ul > i", "text", []),
        (1, "img[src]", "src", ["1.jpg", "//c.com/2.jpg"]),
        (1, "a[href=b/2], .author", "text", ["A", "Two & more", "B"]),
        (1, "img, a", "href", ["/b/1", "b/2", "https://x.com/3"]),
        (1, "#none", "text", []),
        (2, "#content p", "text", ["First", "Secondline"]),
        (2, "#content", "own_text", [""]),
        (2, "p", "own_text", ["First", "Second"]),
        (2, "div#content > p", "html", ["<p>First</p>", "<p>Second<br>line</p>"]),
    ],
)
def test_selectors(pages, page, selector, attribute, want):
    assert values(pages, page, selector, attribute) == want


def test_parser_repairs_tag_soup(spark):
    soup = "<ul><li>a<li>b</ul><p>one<p>two<div>three</div></p><td>x<br/>y"
    df = H.shred_html(spark.createDataFrame([(1, soup)], "id int, html string"))
    rows = H.node_table(df, ["id"]).orderBy("node").select("tag", "text", "depth").collect()
    assert [tuple(r) for r in rows] == [
        ("ul", "ab", 0), ("li", "a", 1), ("li", "b", 1), ("p", "one", 0), ("p", "two", 0), ("div", "three", 0), ("td", "xy", 0), ("br", "", 1),
    ]


def test_drop_nodes(pages):
    clean = H.drop_nodes(pages, ["script", "style", ".advert", ".chapter-nav"])
    assert values(clean, 2, "#content") == ["First Secondline"] or values(clean, 2, "#content") == ["FirstSecondline"]
    assert values(clean, 2, "script") == []
    assert "no" not in values(clean, 2, "#content", "html")[0]


def catalogue(spark):
    none = None
    rule_rows = [
        ("search", "list", ".book-item"), ("search", "title", ".title"), ("search", "author", ".author"), ("search", "url", "a@href"),
        ("search", "cover", "img@src"), ("search", "kind", "@class"), ("content", "body", "#content@html"), ("content", "none", "#missing"),
    ]
    step_rows = [
        ("s", none, 0, "trim", none, none, none, none), ("s", "search", 1, "normalize_whitespace", none, none, none, none),
        ("s", "search", 2, "url_join", none, none, none, none), ("s", "content", 1, "remove_html", none, none, none, none),
    ]
    r = spark.createDataFrame([("s", *x) for x in rule_rows], "source_id string, capability string, field string, rule string")
    t = spark.createDataFrame(step_rows, "source_id string, capability string, ord int, op string, pattern string, replacement string, value string, separator string")
    return E.rule_sets(r, t)


def test_search_page(spark, pages):
    hits = E.extract_search(E.extract_many(E.with_rules(pages.filter("id = 1"), catalogue(spark), "search")))
    got = [(r["title"], r["author"], r["url"], r["cover_url"], r["extra"]) for r in hits.orderBy("item_no").collect()]
    assert got == [
        ("One Book", "A", "https://e.com/b/1", "1.jpg", {"kind": "book-item new"}),
        ("Two & more", "B", "https://e.com/list/b/2", "https://c.com/2.jpg", {"kind": "book-item"}),
        ("Three", None, "https://x.com/3", None, {"kind": "book-item"}),
    ]


def test_content_page(spark, pages):
    clean = H.drop_nodes(pages.filter("id = 2"), ["script", "style", ".advert"])
    done, rejected = E.extract_content(E.with_rules(clean, catalogue(spark), "content"))
    assert done.first()["content"].split() == ["First", "Second", "line"]
    assert rejected.count() == 0


def test_book_rejects_without_title(spark):
    rows = spark.createDataFrame(
        [("https://E.com/b/1/", {"title": "T", "status": "完结", "tag": "x"}), ("https://e.com/b/2", {"title": None})],
        "url string, record map<string,string>",
    )
    books, bad = E.extract_book(rows)
    book = books.first()
    assert (book["title"], book["source_book_id"], book["status"], book["extra"]) == ("T", "https://e.com/b/1", "completed", {"tag": "x"})
    assert bad.first()["reason"] == "no_title"


def test_chapter_index_keeps_gaps(spark):
    rows = [("b", p, i, {"title": "" if (p, i) == (1, 1) else f"t{p}{i}", "url": f"u{p}{i}"}) for p in (1, 2) for i in range(3)]
    items = spark.createDataFrame(rows, "book_id string, page_no int, item_no int, record map<string,string>").withColumn("rev", F.lit(True))
    up = E.extract_chapters(items).orderBy("index").collect()
    assert [(r["index"], r["title"]) for r in up] == [(0, "t10"), (2, "t12"), (3, "t20"), (4, "t21"), (5, "t22")]
    down = E.extract_chapters(items, reverse="rev").orderBy("index").collect()
    assert [(r["index"], r["title"]) for r in down] == [(0, "t22"), (1, "t21"), (2, "t20"), (3, "t12"), (5, "t10")]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (".a b@href", ("css", ".a b", "href")), ("@text", ("attr", "text", None)), ("XPath://a", ("xpath", "//a", None)),
        ("jsonpath:$.a[*]", ("jsonpath", "$.a[*]", None)), ("regex:a@b", ("regex", "a@b", None)), ("a@b@c", ("css", "a@b", "c")),
    ],
)
def test_parse_rule(one, raw, want):
    assert tuple(one(E.parse_rule(F.lit(raw)))) == want


def test_json_lists(spark, one):
    text = '{"data":{"list":[{"t":"a","n":1},null,{"t":null}]}}'
    df = spark.createDataFrame([(1, text)], "id int, text string")
    for path in ("$.data.list", "$.data.list[*]"):
        rows = E.extract_many_json(df, path, {"t": "$.t", "n": "$.n"}).orderBy("item_no").collect()
        assert [(r["t"], r["n"]) for r in rows] == [("a", "1"), (None, None)]
    assert one(E.extract_jsonpath(F.lit('{"a":[{"b":"x"},{"b":"y"}]}'), "$.a[*].b")) == ["x", "y"]
    assert one(E.extract_jsonpath(F.lit('{"a":null}'), "$.a")) == []


def test_regex_groups(one):
    assert one(E.extract_regex(F.lit("a1 b2"), r"[a-z](\d)")) == ["1", "2"]
    assert one(E.extract_regex(F.lit("a1 b2"), r"[a-z](?:\d)")) == ["a1", "b2"]


@pytest.mark.parametrize(
    ("value", "steps", "want"),
    [
        ("  x　", ["trim"], "x"),
        ("a \n b", ["normalize_whitespace"], "a b"),
        ("a<br/>b<BR>c<p>d</p>e", ["remove_html"], "a\nb\ncd\ne"),
        ("x &lt;b&gt; &amp;lt;", ["remove_html"], "x <b> &lt;"),
        ("1-2", [{"op": "replace", "pattern": "-", "replacement": "$"}], "1$2"),
        ("ab", [{"op": "regex_replace", "pattern": "(a)(b)", "replacement": r"\2$\1"}], "b$a"),
        (None, [{"op": "prepend", "value": "x"}], "x"),
        ("a", [{"op": "append", "value": "x"}], "ax"),
        ("", [{"op": "default", "value": "d"}], "d"),
        (None, ["trim", "normalize_whitespace", "remove_html"], None),
        ("/a", ["url_join"], "https://e.com/a"),
        ("三体", ["url_join"], "三体"),
        (" a ", ["trim", {"op": "append", "value": "!"}, {"op": "prepend", "value": ">"}], ">a!"),
    ],
)
def test_transforms_both_ways(spark, one, value, steps, want):
    base = F.lit("https://e.com/x/y")
    assert one(T.apply_transforms(F.lit(value).cast("string"), steps, base)) == want
    rows = [({"op": s} if isinstance(s, str) else s) for s in steps]
    data = [[{k: r.get(k) for k in ("op", "pattern", "replacement", "value", "separator")} for r in rows]]
    df = spark.createDataFrame([(value, [tuple(d.values()) for d in data[0]])], f"v string, s {T.STEPS}")
    assert df.select(T.apply_transform_column(F.col("v"), F.col("s"), base).alias("o")).first()["o"] == want


def test_rare_entities(one):
    assert one(T.unescape_entities(F.lit("&#8212;&eacute;&amp;"))) == "—é&"
    assert one(T.remove_html(F.lit("<b>&#x4e2d;</b> &copyx &nosuch; &#38;lt;"))) == "中 ©x &nosuch; &lt;"


def test_every_named_and_many_numeric_references(spark):
    import html

    texts = [f"&{n} x" for n in html.entities.html5] + [f"&#{n};" for n in range(300)] + ["&#xD800;", "&#x110000;", "&#99999999999999;", "&#000065;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.unescape_entities("t").alias("u")).collect()
    assert [r.t for r in rows if r.u != html.unescape(r.t)] == []


def test_bad_transforms_are_refused():
    with pytest.raises(ValueError):
        T.apply_transforms("x", ["shout"])
    with pytest.raises(ValueError):
        T.apply_transforms("x", [{"op": "replace"}])
    with pytest.raises(ValueError):
        T.apply_transforms("x", ["url_join"])


def chain(spark, links, starts, limit):
    df = spark.createDataFrame(links, "url string, next_url string")
    out = paging.follow_pages(spark.createDataFrame([(s,) for s in starts], "start string"), df, limit)
    return {s: [(r["url"], r["stop_reason"]) for r in out.filter(F.col("start") == s).orderBy("page_no").collect()] for s in starts}


def test_page_chains(spark):
    links = [("a1", "a2"), ("a2", "a3"), ("a3", None), ("s", "s"), ("x", "y"), ("y", "x"), ("g", "gone")]
    got = chain(spark, links, ["a1", "s", "x", "g"], 20)
    assert got == {
        "a1": [("a1", None), ("a2", None), ("a3", "end")], "s": [("s", "loop")], "x": [("x", None), ("y", "loop")], "g": [("g", "not_landed")],
    }


@pytest.mark.parametrize("limit", [2, 3, 5, 7])
def test_page_limit(spark, limit):
    links = [(f"p{i}", f"p{i + 1}" if i < 5 else None) for i in range(1, 6)]
    got = chain(spark, links, ["p1"], limit)["p1"]
    assert [u for u, _ in got] == [f"p{i}" for i in range(1, min(limit, 5) + 1)]
    assert got[-1][1] == ("limit" if limit < 5 else "end")


def test_domain_admission(spark):
    rows = spark.createDataFrame(
        [(1, "s", "https://www.example.com/x"), (2, "s", "https://badexample.com/"), (3, "s", "https://u:p@example.com:8443/"), (4, "t", "https://any.org/")],
        "id int, source_id string, url string",
    )
    own = spark.createDataFrame([("s", "example.com")], "source_id string, domain string")
    got = {r["id"]: r["admitted"] for r in rules.domain_admission(rows, own).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}
    top = spark.createDataFrame([("any.org",)], "domain string")
    got = {r["id"]: r["admitted"] for r in rules.domain_admission(rows, own, top).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True}
    empty = spark.createDataFrame([], "domain string")
    assert rules.domain_admission(rows, own, empty).filter("admitted").count() == 3


@pytest.mark.parametrize(
    ("selector", "ok"),
    [("a.b > c#d [x=y]", True), ("*", True), ("a, b", True), ("a:hover", False), ("a >", False), ("a + b", False), ("a[", False)],
)
def test_selector_support(one, selector, ok):
    assert one(H.selector_supported(F.lit(selector))) is ok


def test_rules_that_cannot_be_evaluated_are_rejected_and_stop_nothing(spark):
    rules = [
        ("s", "chapters", "list", "li"), ("s", "chapters", "a", "li:last-child"), ("s", "chapters", "b", "xpath://li[contains(text(),'2')]"),
        ("s", "chapters", "c", "xpath://li[2]"), ("s", "chapters", "d", "regex:("), ("s", "chapters", "e", "regex:(?P<x>1)"),
        ("s", "chapters", "f", "xpath://a[@class='k']/@href"), ("s", "chapters", "g", "jsonpath:$..x"), ("s", "chapters", "h", "@text"),
        ("j", "chapters", "list", "jsonpath:$.data.list"), ("j", "chapters", "title", "jsonpath:$.t"),
    ]
    table = spark.createDataFrame(rules, "source_id string, capability string, field string, rule string")
    bad = {r.field: r.problem for r in E.rule_rejects(table).collect()}
    assert bad == {"a": "unsupported selector", "b": "unsupported path", "c": "unsupported path", "d": "unusable pattern", "g": "unsupported JSON path"}
    pages = spark.createDataFrame(
        [("s", "u", "<ul><li>1<a class='k' href='h1'>z</a></li><li>2</li></ul>"), ("j", "u", '{"data":{"list":[{"t":"one"},null,{"t":"two"}]}}')],
        "source_id string, url string, html string")
    items = E.extract_many(E.with_rules(H.shred_html(pages), E.rule_sets(table), "chapters")).collect()
    got = {(r.source_id, r.item_no): {k: v for k, v in r.record.items() if v is not None} for r in items}
    assert got == {("s", 0): {"e": "1", "f": "h1", "h": "1z"}, ("s", 1): {"h": "2"}, ("j", 0): {"title": "one"}, ("j", 1): {"title": "two"}}
