"""One parse per page: values swept in the parse equal those of node arrays, and the work grows with the page only."""

from __future__ import annotations

import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators import extract as E
from pagemill.operators import html as H

TAGS = ("div", "p", "ul", "li", "span", "a")
SELECTORS = ("div p", "div > p", "ul li > a", "li, span", ".x .y", "#k a", "a[href]", "div div", "div > div span", "*", "p > *", "a[href='u1']")


def soup(seed: int) -> str:
    rng, out = random.Random(seed), []
    for k in range(rng.randint(0, 60)):
        tag = rng.choice(TAGS)
        attrs = "".join(f" {a}" for a in (f'class="{rng.choice(("x", "y", "x y"))}"', 'id="k"', f'href="u{k % 3}"') if rng.random() < 0.4)
        out.append(rng.choice((f"<{tag}{attrs}>", f"<{tag}{attrs}>t {k} ", f"</{tag}>", "<br/>", f" w{k}\n", "<!-- c -->")))
    return "".join(out)


@pytest.fixture(scope="module")
def landed(spark):
    rows = [(i, "s", f"https://e.com/{i}", soup(i)) for i in range(120)] + [(900, "s", "u", None), (901, "s", "u", ""), (902, "s", "u", "plain text")]
    return spark.createDataFrame(rows, "id int, source_id string, url string, html string")


def rules(spark, rows):
    return E.rule_sets(spark.createDataFrame([("s", "book", *r) for r in rows], "source_id string, capability string, field string, rule string"))


FIELDS = [(f"f{i}", s + m) for (i, s), m in zip(enumerate(SELECTORS), itertools.cycle(("", "@html", "@own_text", "@href", "@text")))]
FIELDS += [("r1", "@class"), ("r2", "@text"), ("x", "regex:w(\\d+)"), ("j", "jsonpath:$.a")]


def records(df):
    return sorted((r.id, r.item_no if "item_no" in df.columns else 0, sorted(r.record.items())) for r in df.collect())


@pytest.mark.parametrize("drop", [(), ("span", ".y"), ("div div",)])
def test_whole_pages_like_node_arrays(spark, landed, drop):
    sets = rules(spark, FIELDS)
    nodes = H.shred_html(landed.filter("html like '%<%'"))
    old = E.extract_one(E.with_rules(H.drop_nodes(nodes, drop) if drop else nodes, sets, "book"))
    new = E.extract_one(E.scan(landed.filter("html like '%<%'"), sets, "book", drop=drop))
    want, got = records(old), records(new)
    # a page whose first nodes are gone has no root that is the page; its patterns run over the page all the same
    assert [(i, k, [(n, v) for n, v in r if n != "x"]) for i, k, r in got] == [(i, k, [(n, v) for n, v in r if n != "x"]) for i, k, r in want]


@pytest.mark.parametrize("items", ["li", "div > p", "div", "a, span"])
def test_items_like_node_arrays(spark, landed, items):
    sets = rules(spark, [("list", items), *FIELDS])
    old = E.extract_many(E.with_rules(H.shred_html(landed), sets, "book"))
    new = E.extract_many(E.scan(landed, sets, "book", many=True))
    got, want = records(new), records(old)
    # an item that begins with the page's first node used to take patterns from the whole page, now from itself
    assert [(i, k, [(n, v) for n, v in r if n != "x"]) for i, k, r in got] == [(i, k, [(n, v) for n, v in r if n != "x"]) for i, k, r in want]
    assert len(got) > 20


def test_pages_without_nodes(spark, landed):
    one = E.extract_one(E.scan(landed.filter("id >= 900"), rules(spark, [("t", "p"), ("w", "regex:te(x)t"), ("r", "@text")]), "book"))
    assert {r.id: (r.record["t"], r.record["w"], r.record["r"]) for r in one.collect()} == {900: (None,) * 3, 901: (None,) * 3, 902: (None, "x", None)}


def test_rules_of_several_sources_side_by_side(spark):
    pages = spark.createDataFrame([(1, "a", "u", "<p>x</p><b>y</b>"), (2, "b", "u", "<p>x</p><b>y</b>"), (3, "c", "u", "<p>x</p>")], "id int, source_id string, url string, html string")
    sets = E.rule_sets(spark.createDataFrame([("a", "book", "t", "p"), ("b", "book", "t", "b"), ("b", "book", "u", "p")], "source_id string, capability string, field string, rule string"))
    assert {r.id: dict(r.record) for r in E.extract_one(E.scan(pages, sets, "book")).collect()} == {1: {"t": "x"}, 2: {"t": "y", "u": "x"}}


def step(tag, child=False):
    return {"tag": tag, "id": None, "classes": [], "attrs": [], "child": child}


@pytest.mark.parametrize("shape", ["wide", "deep", "nested lists"])
def test_a_page_of_many_nodes_is_linear(shape):
    """Ten times the nodes take about ten times as long, also where every node is kept at every step."""
    sheet = H._Sheet(json.dumps({"fields": [{"selector": [[step("div"), step("div"), step("div"), step("i")]]}, {"selector": [[step("div", True), step("b")]]}]}))

    def took(n):
        page = {"wide": "<div>" + "<div>x</div>" * n, "deep": "<div>" * n, "nested lists": ("<div><div>" + "<div>y</div>" * 8) * (n // 10)}[shape]
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            H._entries(sheet, page, False)
            best = min(best, time.perf_counter() - start)
        return best

    small, large = took(1_000), took(10_000)
    assert large < 5.0 and large < 40 * small


def test_deep_pages_have_the_right_matches():
    nodes = H._Page("<div>" * 3 + "<p>a</p>" + "</div>" * 3 + "<p>b</p>", []).nodes
    pick = lambda *steps: [n["node"] for n in H.sweep(nodes, [H._Steps(list(steps))], 0, len(nodes) - 1)]
    assert pick(step("div"), step("p")) == [3] and pick(step("div"), step("p", True)) == [3] and pick(step("p")) == [3, 4]
    assert pick(step("div"), step("div")) == [1, 2] and pick(step("div"), step("div"), step("div")) == [2]


def test_a_catalogue_is_parsed_once(spark, landed, monkeypatch):
    """What extract_chapters joins and counts reads the written items: no Python is left in its plan."""
    sets = rules(spark, [("list", "li"), ("title", "a"), ("url", "a@href")])
    items = E.extract_many(E.scan(landed, sets, "book", many=True)).select(F.col("source_id").alias("book_id"), F.col("id").alias("page_no"), "item_no", "record")
    plan = E.extract_chapters(items)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    assert items._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
