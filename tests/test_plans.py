"""What the physical plans must look like."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from pagemill import plans
from pagemill.operators import library as L
from pagemill.operators.export import export_txt
from pagemill.plans.registry import Tables

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables not there")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    from pagemill.session import prepare

    return Tables(prepare(spark), SMALL)


def test_every_query_has_sql_or_a_reason():
    assert set(plans.QUERIES) == set(plans.SQL)


def test_statistics_read_two_columns(spark, t):
    text = plan(plans.QUERIES["book_stats"](spark, SMALL))
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>", text)
    assert "partial_sum" in text


def test_lookups_are_pushed_down(spark, t):
    text = plan(plans.QUERIES["point_lookup"](spark, SMALL))
    assert "EqualTo(conv_id,3)" in text and "EqualTo(turn,1)" in text


def test_summaries_do_not_read_bodies_when_the_flag_is_stored(spark, t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("book_id"), F.col("doc_id").alias("index"), F.col("lang").alias("title"),
                              F.col("n_chars").alias("word_count"), (F.col("n_chars") > 0).alias("has_content"), "text")
    assert "text:string" not in plan(L.list_summaries(rows))


def test_search_is_a_top_k(spark, t):
    text = plan(plans.QUERIES["search_library"](spark, SMALL))
    assert "TakeOrderedAndProject" in text and "Contains" in text


def test_top_n_is_cut_before_the_shuffle(spark, t):
    text = plan(plans.QUERIES["top_n_per_source"](spark, SMALL))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_selectors_do_not_shuffle(spark, t):
    text = plan(plans.QUERIES["select_css"](spark, SMALL))
    assert "Join" not in text and text.count("Exchange") <= 1


NO_PRODUCT = ["chapter_names", "cross_source_search", "domain_admission", "export_xhtml_parts", "lint_summary", "politeness_audit", "upsert_chapters", "upsert_books"]


@pytest.mark.parametrize("name", NO_PRODUCT)
def test_no_products(spark, name):
    text = plan(plans.QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_exports_never_gather_a_book(spark, t):
    from pagemill.plans import views as W

    text = plan(export_txt(W.books(t), W.chapters(t)))
    assert "collect_list" not in text and "listagg" not in text


def test_the_gate_is_evaluated_once(spark, t):
    text = plan(plans.QUERIES["process_content"](spark, SMALL))
    assert text.count("regexp_replace") < 60 and "Generate inline" in text


def test_flagship_has_no_python(spark):
    assert "Python" not in plan(plans.QUERIES["content_by_source"](spark, SMALL))


@pytest.mark.parametrize("name", ["schedule", "transitions", "attempts", "index", "in flight", "gaps"])
def test_ordered_passes_run_nothing_while_they_are_planned(spark, t, name):
    """Count, sample and splitters are subqueries of the plan, and no splitter is a literal in it."""
    from pagemill.operators import ordered, schedule, tasks
    from pagemill.plans import views as W

    events, docs = W.task_events(t), t.documents.select("doc_id", "source")
    seconds = (F.col("micros") / 1e6).alias("arrival")
    requests = events.select(F.col("status").alias("source_id"), seconds, F.col("event_id").alias("request_id"))
    spans = requests.select("source_id", "request_id", F.col("arrival").alias("started"), (F.col("arrival") + 5).alias("ended"))
    codes = events.select("task_id", "event_id", "at", F.lit("HTTP").alias("code"), F.lit(500).alias("status_code"))
    build = {
        "schedule": lambda: schedule.politeness_schedule(requests), "transitions": lambda: tasks.validate_transitions(events),
        "attempts": lambda: schedule.attempt_history(codes, request="task_id", tie="event_id"), "index": lambda: ordered.assign_index(docs, ["source"], ["doc_id"], None),
        "in flight": lambda: schedule.in_flight(spans), "gaps": lambda: schedule.gap_violations(spans),
    }[name]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"plan-{name}", "planning")
    df = build()
    text = plan(df)
    assert list(tracker.getJobIdsForGroup(f"plan-{name}")) == []
    spark.sparkContext.setJobGroup("rest", "")
    assert "named_struct(cast" not in text and len(text) < 100_000 and "Subquery" in text
    assert df.limit(1).collect() or name == "gaps"
