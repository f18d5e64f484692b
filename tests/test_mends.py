"""Nulls, repeats and set-up: rows must not be lost, ties must not be random."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from pagemill.operators import cache, merge, ordered, schedule

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_null_keys_and_order_values_keep_their_rows(spark):
    rows = [("a", 1, 1), ("a", None, 2), (None, 5, 3), (None, 4, 4), (None, None, 5), ("b", 7, 6)]
    df = spark.createDataFrame(rows, "k string, o int, i int")
    for width in (None, 3.0):
        got = {r.i: r.rn for r in ordered.row_numbers(df, ["k"], ["o", "i"], width).collect()}
        assert got == {2: 1, 1: 2, 5: 1, 4: 2, 3: 3, 6: 1}
        back = {r.i: r["index"] for r in ordered.assign_index(df, ["k"], ["o", "i"], width, reverse=True).collect()}
        assert back == {1: 0, 2: 1, 3: 0, 4: 1, 5: 2, 6: 0}
        before = {r.i: r.p for r in ordered.neighbours(df, ["k"], ["o", "i"], width, {"p": "i"}).collect()}
        assert before == {2: None, 1: 2, 5: None, 4: 5, 3: 4, 6: None}


def test_requests_without_a_source_are_scheduled(spark):
    df = spark.createDataFrame([("s", 0.0, 1), (None, 0.0, 2), (None, 0.1, 3)], "source_id string, arrival double, request_id int")
    got = {r.request_id: round(r.start_at, 3) for r in schedule.politeness_schedule(df, 1.0).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0}


def test_an_entry_without_access_time_is_the_oldest(spark):
    rows = [("a", 10, "2024-01-02"), ("b", 10, None), (None, 10, None), ("d", 10, "2024-01-01")]
    df = spark.createDataFrame(rows, "key string, size_bytes long, at string").withColumn("accessed_at", F.to_timestamp("at"))
    for most, left in ((40, 4), (25, 2), (15, 1), (30, 3)):
        flags = {(r.key, r.at): r.evicted for r in cache.evict_lru(df, most).collect()}
        assert None not in flags.values() and sum(not f for f in flags.values()) == left
        assert cache.enforce_capacity(df, most).count() == left
    assert {r.key for r in cache.enforce_capacity(df, 15).collect()} == {"a"}


@pytest.mark.parametrize("parts", [1, 3])
def test_repeats_collapse_the_same_way_every_time(spark, parts):
    books = spark.createDataFrame(
        [], "id string, source_id string, source_book_id string, url string, title string, author string, intro string, cover_url string, "
        "latest_chapter string, status string, metadata map<string,string>, created_at timestamp, updated_at timestamp")
    draft = lambda title: ("s", "b", "u", title, "a", "i", "c", "l", "ok", {"k": title})
    drafts = spark.createDataFrame(
        [draft("one"), draft("two"), draft("two")], "source_id string, source_book_id string, url string, title string, author string, "
        "intro string, cover_url string, latest_chapter string, status string, extra map<string,string>").repartition(parts)
    now = F.lit("2024-01-01").cast("timestamp")
    got = merge.upsert_books(books, drafts, now).collect()
    assert len(got) == 1 and got[0].metadata == {"k": got[0].title}
    assert got[0].title == merge.upsert_books(books, drafts.orderBy(F.desc("title")), now).first()["title"]


def test_sources_found_twice(spark):
    index = spark.createDataFrame(
        [], "source_id string, name string, version string, spec_version string, homepage string, license string, capabilities string, "
        "enabled boolean, health string, installed_version string, previous_version string, installed_at timestamp, updated_at timestamp")
    found = spark.createDataFrame(
        [("s", "n", "1", "1", "h", "l", "c"), ("s", "n", "2", "1", "h", "l", "c")],
        "source_id string, name string, version string, spec_version string, homepage string, license string, capabilities string")
    now = F.lit("2024-01-01").cast("timestamp")
    assert [(r.source_id, r.version) for r in merge.sync_catalogue(index, found, now).collect()] == [("s", "2")]
    stamped = found.withColumn("installed_at", F.col("version").cast("int"))
    assert [r.installed_version for r in merge.install_source(index, stamped, now, "installed_at").collect()] == ["2"]


def test_bad_junk_patterns_are_ignored(spark):
    from pagemill.functions.text import clean_text

    df = spark.createDataFrame([("keep\nadvert 1\nspam 22",)], "t string")
    with pytest.warns(UserWarning):
        cleaned = df.select(clean_text("t", ["(", "advert.*", "(?P<a>spam) \\d+"]).alias("c")).first()["c"]
    assert cleaned == "keep"


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from pagemill.session import prepare\nfrom pagemill.operators.html import shred_html\n"
        "df = prepare(s).createDataFrame([('u', '<p>x</p>')], 'url string, html string')\n"
        "print('NODES', len(shred_html(df).collect()))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "NODES 1" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize(
    ("low", "high"),
    [
        ("1.9.0", "1.10.0"), ("1.0.0-rc.1", "1.0.0"), ("1.0.0-alpha", "1.0.0-beta"), ("1.0.0-rc.2", "1.0.0-rc.10"), ("1.0.0-1", "1.0.0-alpha"),
        ("1.0.0-alpha", "1.0.0-alpha.1"), ("v1.2", "1.2.1"), ("2.0.0", "10"), (None, "0"), ("unknown", "0.0.1"), ("1.0.0-rc1", "1.0.0-rc2"),
    ],
)
def test_versions_are_ordered_by_number(one, low, high):
    order = merge.version_order
    low, high = order(F.lit(low).cast("string")), order(F.lit(high))
    assert one(F.coalesce(low < high, low.isNull() & high.isNotNull()))


def test_equal_versions(one):
    assert one(merge.version_order(F.lit("1.0")) == merge.version_order(F.lit("v1.0.0+build.5")))


STEP_COLUMNS = "source_id string, capability string, ord int, op string, pattern string, replacement string, value string, separator string"


def test_steps_that_cannot_run_are_rejected_and_stop_nothing(spark):
    from pagemill.operators import extract, rules

    steps = spark.createDataFrame(
        [("s", None, 0, "regex_replace", "(", "", None, None), ("s", "book", 1, "regex_replace", "(?P<a>x)(y)", "\\2\\g<1>", None, None),
         ("s", "book", 2, "regex_replace", "x", "\\3", None, None), ("s", "book", 3, "shout", None, None, None, None), ("s", "book", 4, "append", None, None, "!", None),
         ("s", "book", 5, "replace", None, "q", None, None), ("t", "book", 6, "regex_replace", "[[a]]+", "", None, None)], STEP_COLUMNS)
    bad = {(r.source_id, r.ord): (r.pattern, r.problem) for r in extract.transform_rejects(steps).collect()}
    assert {k: p for k, (_, p) in bad.items()} == {
        ("s", 0): "unusable pattern", ("s", 2): "unusable replacement", ("s", 3): "unknown transform", ("s", 5): "no pattern", ("t", 6): "unusable pattern"}
    assert bad["s", 0][0] == "("
    table = spark.createDataFrame([("s", "book", "t", "p"), ("t", "book", "t", "p")], "source_id string, capability string, field string, rule string")
    pages = spark.createDataFrame([("s", "u", "<p>xy</p>"), ("t", "u", "<p>xy</p>")], "source_id string, url string, html string")
    got = {r.source_id: r.record["t"] for r in extract.extract_one(extract.scan(pages, extract.rule_sets(table, steps), "book")).collect()}
    assert got == {"s": "yx!", "t": "xy"}
    empty = lambda ddl: spark.createDataFrame([], ddl)
    found = rules.lint_rules(
        empty("source_id string, allowed array<string>"), empty("source_id string, capability string, field string, rule string"),
        empty("source_id string, capability string, path string, template string"), empty("source_id string, selector string"), steps)
    assert sorted((r.path, r.severity) for r in found.collect()) == [
        ("book.2", "error"), ("book.3", "error"), ("book.5", "error"), ("book.6", "error"), ("transforms.0", "error")]


def test_a_circle_of_retries_does_not_hold_up_the_others(spark):
    """Settled tasks leave, and a circle ends the loop once a jump is longer than what is left."""
    from pagemill.operators import tasks

    rounds = []
    real = tasks.cut_lineage
    tasks.cut_lineage = lambda df: rounds.append(1) or real(df)
    try:
        data = [("x", "y"), ("y", "x")] + [(f"t{i}", f"t{i - 1}" if i else None) for i in range(9)] + [(None, "t0"), ("self", "self")]
        got = {r["task_id"]: (r["root_task_id"], r["retries"]) for r in tasks.retry_lineage(spark.createDataFrame(data, "task_id string, parent_task_id string")).collect()}
    finally:
        tasks.cut_lineage = real
    assert got["t8"] == ("t0", 8) and got["x"][0] is None and got["self"][0] is None and got[None] == ("t0", 1) and len(got) == 13
    assert len(rounds) <= 6


def test_overall_limit(spark):
    from pagemill.operators import schedule

    df = spark.createDataFrame([("a", 0, 10), ("b", 1, 9), ("a", 2, 8), ("c", 8, 9)], "source_id string, started long, ended long")
    got = {r.source_id: (r.max_in_flight, r.allowed, r.within_limit) for r in schedule.concurrency_audit(df, 1, 3).collect()}
    assert got == {"a": (2, 1, False), "b": (1, 1, True), "c": (1, 1, True), None: (3, 3, True)}
    assert schedule.concurrency_audit(df.limit(0)).count() == 0
