"""Thinning of long bursts in ranges equals the plain loop."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators import tasks as K


def brute(rows, interval):
    kept, out = {}, set()
    for task, at, i, final in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if task not in kept or final or at - kept[task] >= interval:
            kept[task] = at
            out.add(i)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.4, 0.9]), min_size=1, max_size=60), st.sampled_from([0.3, 1.0, 2.5]), st.integers(1, 20))
def test_steps_of_ranges_follow_the_loop(gaps, interval, size):
    """Whatever the cut, the event kept before each range is the one the loop has kept."""
    at = np.cumsum([min(g, interval * 0.99) for g in gaps])
    kept, before = None, []
    for k, moment in enumerate(at):
        if k % size == 0:
            before.append(kept)
        if kept is None or moment - kept >= interval:
            kept = moment
    frame = pd.DataFrame({"t": "x", "_burst": 1, "_range": np.arange(len(at)) // size, "_at": at})
    place = ["t", "_burst", "_range"]
    steps = pd.concat(K._range_steps(iter([frame.iloc[:7], frame.iloc[7:]]), place, interval), ignore_index=True)
    got = pd.concat(K._followed(iter([steps]), place, interval))["_kept"].tolist()
    assert [None if pd.isna(g) else g for g in got] == before


@pytest.mark.parametrize("interval", [0.5, 5.0, 200.0])
def test_long_bursts_like_the_loop(spark, interval):
    rng = random.Random(int(interval))
    rows, at = [], {"hot": 0.0, "b": 0.0, None: 0.0}
    for i in range(6_000):
        task = "hot" if rng.random() < 0.8 else rng.choice(["b", None])
        at[task] += rng.choice((0.0, 0.01, 0.1, 0.3)) if rng.random() < 0.999 else interval * 2
        rows.append((task, round(at[task], 3), i, rng.random() < 0.001))
    df = spark.createDataFrame([(t, a, i, 9 if f else 1, 9) for t, a, i, f in rows], "task_id string, at double, event_id int, done int, total int").repartition(3)
    got = K.throttle_progress(df, interval)
    assert got.columns == df.columns
    assert {r.event_id for r in got.collect()} == brute(rows, interval)


def test_one_burst_of_many_events_is_spread(spark):
    """A burst that is all of the table: no task thins more than a few ranges of it."""
    from pyspark.sql import functions as F

    n = 300_000
    df = spark.range(n).select(F.lit("t").alias("task_id"), (F.col("id") / 100).alias("at"), F.col("id").alias("event_id"), F.lit(1).alias("done"), F.lit(9).alias("total"))
    got = sorted(r.event_id for r in K.throttle_progress(df, 2.5).select("event_id").collect())
    at, kept, want = np.arange(n) / 100, -1e9, []
    for k in range(n):
        if at[k] - kept >= 2.5:
            kept = at[k]
            want.append(k)
    assert got == want
