"""Searches that open only the files whose trigram signature has all of a keyword."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions.text import contains_keyword
from pagemill.operators import signatures as SG


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "chapters")
    words = ["alpha beta", "GAMMA delta", "été noir", "zeta \U0001f600 omega", None, "", "ab"]
    rows = [(f"b{i % 12}", i, f"{words[i % 7]} only{i}x" if words[i % 7] else words[i % 7]) for i in range(120)]
    df = spark.createDataFrame(rows, "book_id string, index int, content string")
    df.repartition(12, "book_id").sortWithinPartitions("index").write.partitionBy("book_id").parquet(path)
    return path, SG.file_signatures(spark, path).cache()


@pytest.mark.parametrize("keyword", ["alpha", "ONLY7X", "only17x", "gamma DELTA", "été", "\U0001f600", "a", "b", "beta only", "nowhere", "ab", "x"])
def test_the_same_rows_as_a_scan(spark, stored, keyword):
    path, signatures = stored
    want = sorted(map(tuple, spark.read.parquet(path).filter(contains_keyword("content", keyword)).select("book_id", "index").collect()))
    got = SG.scan_indexed(spark, path, signatures, keyword)
    assert sorted(map(tuple, got.select("book_id", "index").collect())) == want
    assert SG.scan_indexed(spark, path, signatures, "").count() == 0


def test_few_files_are_read(spark, stored):
    path, signatures = stored
    files = spark.read.parquet(path).inputFiles()
    assert signatures.count() == len(files) == 12
    found = SG.scan_indexed(spark, path, signatures, "only17x")
    assert len(found.inputFiles()) <= 3 and found.count() == 1
    assert SG.candidate_files(signatures, "nowhere at all") == []
    assert len(SG.candidate_files(signatures, "b")) == 12  # too short to tell


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30), st.integers(0, 30), st.integers(0, 30))
def test_no_keyword_is_missed(body, a, b):
    keyword = body[min(a, b) : max(a, b)]
    fold = lambda t: t.encode("utf-8", "surrogatepass").translate(SG._FOLD)
    assert set(SG._places(fold(keyword)).tolist()) <= set(SG._places(fold(body.upper() if body.isascii() else body)).tolist())


def test_signatures_read_two_columns(spark, stored):
    plan = SG.file_signatures(spark, stored[0])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<content:string>" in plan and "bitmap_or_agg" in plan
