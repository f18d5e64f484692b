from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.core import fold_space, strip
from pagemill.operators import quality as Q


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a​b﻿c", "abc"),
        ("正文一\n请记住本站网址\n正文二", "正文一\n正文二"),
        ("a\nwww.example.com\nb", "a\nb"),
        ("a\nhttps://example.org\nb", "a\nb"),
        ("\xa0\xa0 para", "para"),
        ("　　第一段", "第一段"),
        ("x&nbsp;y &amp; z", "x y & z"),
        ("<p>one</p>two", "onetwo"),
        ("2 < 3", "2 < 3"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("bell\x07 tab\tend", "bell tab\tend"),
        ("", ""),
    ],
)
def test_clean_text(one, raw, want):
    assert one(X.clean_text(F.lit(raw))) == want


def test_extra_junk_lines(one):
    assert one(X.clean_text(F.lit("keep\nad: buy\nkeep too"), ["ad:"])) == "keep\nkeep too"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a\r\nb\rc", "a\nb\nc"),
        ("a　b  c\t\td", "a b c d"),
        ("  a  \n\n\n\n b ", "a\n\nb"),
        ("\x0b\x0ca", "a"),
        ("", ""),
    ],
)
def test_normalize_text(one, raw, want):
    assert one(X.normalize_text(F.lit(raw))) == want


def test_normalize_is_idempotent(spark):
    rng = random.Random(7)
    alphabet = "ab 中\t\n\r　\xa0​\x0b"
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))),) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string").select(X.normalize_text("t").alias("a"))
    assert df.filter(F.col("a") != X.normalize_text("a")).count() == 0


def test_strip_and_fold_agree_with_python(spark):
    rng = random.Random(3)
    alphabet = "xy \t\n\r\x1c\x1f\x85\xa0     　​"
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))),) for _ in range(500)]
    got = spark.createDataFrame(rows, "t string").select("t", strip("t").alias("s"), fold_space("t").alias("f")).collect()
    for r in got:
        assert r["s"] == r["t"].strip()
        assert r["f"] == " ".join(r["t"].split())


def test_paragraphs(one):
    assert one(X.split_paragraphs(F.lit("a\nb\n\nc"))) == ["a\nb", "c"]
    assert one(X.split_paragraphs(F.lit("a\n b \nc"))) == ["a", "b", "c"]
    assert one(X.split_paragraphs(F.lit(" \n"))) == []


@pytest.mark.parametrize(("text", "n"), [("三体 hello world 42", 5), ("", 0), ("中文", 2), ("don't", 2)])
def test_count_words(one, text, n):
    assert one(X.count_words(F.lit(text))) == n


def test_ratios(one):
    assert one(X.script_ratio(F.lit("中文ab"))) == 0.5
    assert one(X.script_ratio(F.lit("  "))) == 0.0
    assert one(X.repeat_line_ratio(F.lit("a\nb\na\n\n c"))) == 0.5
    assert one(X.repeat_line_ratio(F.lit("a\na"))) == 0.0


def test_hash_ignores_white_space(one):
    assert one(X.content_hash(F.lit(" a\n　b "))) == one(X.content_hash(F.lit("a b")))
    assert one(X.content_changed(F.lit("a b"), X.content_hash(F.lit("a  b")))) is False
    assert one(X.content_changed(F.lit("a b"), F.lit(None).cast("string"))) is True


@pytest.mark.parametrize(
    ("text", "policy", "reason"),
    [
        ("  \n ", {}, "empty"),
        ("短", {}, "too_short"),
        ("文" * 120, {"max_length": 100}, "too_long"),
        ("word " * 40, {}, "low_script_ratio"),
        ("请记住这个网站\n" * 20 + "正文", {}, "high_repeat_ratio"),
        ("正文内容" * 30, {}, None),
        ("x", {"min_length": 0, "min_script_ratio": 0.0}, None),
    ],
)
def test_quality_gate(one, text, policy, reason):
    verdict = one(Q.quality_gate(F.lit(text), Q.ContentPolicy(**policy)))
    assert (verdict and verdict["reason"]) == reason


def test_rejects_keep_measure_and_threshold(spark):
    df = spark.createDataFrame([(1, "短"), (2, "正文内容" * 30)], "id int, text string")
    done = Q.process_content(df)
    bad = Q.rejected(done).collect()
    assert [(r["id"], r["reason"], r["measure"], r["threshold"]) for r in bad] == [(1, "too_short", 1.0, 50.0)]
    assert [r["id"] for r in Q.accepted(done).collect()] == [2]


def test_policy_order(spark):
    rows = spark.createDataFrame([("t1", "s1", "x" * 30), ("t2", "s1", "x" * 30), ("t3", "s2", "x" * 30)], "task_id string, source_id string, text string")
    task = spark.createDataFrame([("t1", 10)], "task_id string, min_length int")
    source = spark.createDataFrame([("s1", 40)], "source_id string, min_length int")
    out, policy = Q.resolve_policy(rows, task, source, {"min_length": 20, "min_script_ratio": 0.0, "max_repeat_line_ratio": 1.0})
    got = {r["task_id"]: r["r"] for r in out.select("task_id", Q.quality_gate(F.col("text"), policy)["reason"].alias("r")).collect()}
    assert got == {"t1": None, "t2": "too_short", "t3": None}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("ongoing", "ongoing"), (" 连载中 ", "ongoing"), ("FINISHED", "completed"), ("已完结", "completed"), ("0", "unknown"), ("1", "unknown"),
     ("非连载", "unknown"), ("", "unknown"), (None, "unknown")],
)
def test_parse_status(one, raw, want):
    assert one(X.parse_status(F.lit(raw).cast("string"))) == want


def test_search_predicate_is_literal(one):
    assert one(X.contains_keyword(F.lit("rate 100% sure"), "100%")) is True
    assert one(X.contains_keyword(F.lit("rate 1000 sure"), "100%")) is False
    assert one(X.contains_keyword(F.lit("axb"), "a_b")) is False
    assert one(X.contains_keyword(F.lit("AbC"), "aBc")) is True
    assert one(X.contains_keyword(F.lit("abc"), "")) is False
    assert one(X.escape_like(F.lit("a%b_c\\"))) == "a\\%b\\_c\\\\"


def test_snippet(one):
    text = "x" * 50 + "KEY" + "y" * 50
    assert one(X.make_snippet(F.lit(text), "KEY")) == "…" + "x" * 30 + "KEY" + "y" * 30 + "…"
    assert one(X.make_snippet(F.lit("KEY at start"), "KEY")) == "KEY at start"
    assert one(X.make_snippet(F.lit("z" * 100), "KEY")) == "z" * 60
