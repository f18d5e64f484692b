from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import negatives
from pagemill.llm.negatives import Best, SubsetSums, bit_planes, score_window

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step=50, positives=5, count=3):
    """Every score by plain integer arithmetic."""
    kept = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in vector]
        kept.append((i, ints, (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, va, la in kept:
        if a % step:
            continue
        scored = [(sum(x * y for x, y in zip(va, vb, strict=False)), b, lb) for b, vb, lb in kept]
        best = sorted(((s, b) for s, b, lb in scored if lb == la and b != a), key=lambda r: (-r[0], r[1]))[:positives]
        for p, b in best:
            inside = sorted(((s, n) for s, n, ln in scored if ln != la and 50 * p <= 100 * s <= 95 * p), key=lambda r: (-r[0], r[1]))
            out += [(a, b, k, n, p, s) for k, (s, n) in enumerate(inside[:count], 1)]
    return sorted(out)


def rows_of(rng, n, dims=12, labels=3):
    vectors = rng.normal(0.1, 0.3, (n, dims)).astype(np.float32)
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, rng.integers(0, labels, n), strict=True))]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_scores_are_inner_products(data):
    size = data.draw(st.sampled_from([1, 3, 300, 40_000, 2**26]))
    dims = data.draw(st.integers(1, 20))
    number = st.integers(-size, size - 1)
    matrix = st.lists(st.lists(number, min_size=dims, max_size=dims), min_size=1, max_size=6)
    anchors, rows = (np.array(data.draw(matrix), np.int64) for _ in range(2))
    assert (SubsetSums(anchors).scores(bit_planes(rows)) == rows @ anchors.T).all()


@given(st.integers(-(10**6), 10**6), st.integers(-(10**6), 10**6))
def test_window_is_exact(p, n):
    low, high = score_window(np.array([p]))
    assert (low[0] <= n <= high[0]) == (50 * p <= 100 * n <= 95 * p)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-3, 3), st.integers(0, 9)), max_size=60), st.integers(1, 4))
def test_best_keeps_the_first(hits, k):
    best = Best(4, k)
    for lo in range(0, len(hits), 7):
        part = np.array(hits[lo : lo + 7], np.int64).reshape(-1, 3)
        best.add(part[:, 0], part[:, 1], part[:, 2])
    want = [h for s in range(4) for h in sorted((h for h in hits if h[0] == s), key=lambda h: (-h[1], h[2]))[:k]]
    assert list(zip(best.slot.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == want


def mined(spark, rows, **how):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("path", "score", "id", "slot", "rank", "anchor_id"):
        df = df.withColumn(name, F.lit("clash"))
    return sorted(map(tuple, negatives.hard_negatives(df, **how).collect()))


def test_edges(spark):
    rng = np.random.default_rng(7)
    rows = rows_of(rng, 160)
    rows += [
        (None, [0.1] * 12, 1), (200, None, 1), (250, [0.5] * 12, None), (300, [0.1, None] * 6, 1), (350, [float("nan")] * 12, 2),
        (400, [float("inf")] + [0.0] * 11, 2), (450, [], 1), (500, [0.9] * 3, 1), (550, [0.4] * 30, 2), (600, [3000.0] * 12, 0), (-50, [-0.4] * 12, 1),
    ]
    rows += [(50, rows[7][1], 2), (50, rows[7][1], 2), (9, rows[9][1], rows[9][2])]  # repeated ids and rows
    rows += [(700 + k, rows[3][1], k % 3) for k in range(30)]  # ties
    assert mined(spark, rows, anchor_rows=3, block_rows=17) == brute(rows)
    assert mined(spark, rows) == brute(rows)


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    assert mined(spark, [(50, [0.5], 1), (51, [0.5], 1)]) == []


def test_a_hot_vector_and_a_hot_id(spark):
    """A third of all rows are copies of one vector, another third share an id that is an anchor's."""
    rng = np.random.default_rng(11)
    rows = rows_of(rng, 120, labels=2)
    rows += [(1000 + k, rows[5][1], 1) for k in range(120)] + [(100, rows[6][1], 0)] * 40
    assert mined(spark, rows, block_rows=50) == brute(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_on_given_vectors(spark, folder):
    from pagemill.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = QUERIES["op13_hard_negatives"](spark, folder)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
