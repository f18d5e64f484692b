"""Task records: current state, transitions, recovery, lineage, reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import fixed
from pagemill.operators.ordered import RANGE, neighbours, running_sums, with_ranges
from pagemill.session import cut_lineage


def transition_allowed(src: Column, dst: Column) -> Column:
    """Membership in the state graph, as an expression: the graph has fifteen edges."""
    edges = F.array(*[F.lit(f"{a}>{b}") for a, b in fixed.TASK_TRANSITIONS])
    return F.array_contains(edges, F.concat(src, F.lit(">"), dst))


def latest_task_state(events: DataFrame, at: str = "at", tie: str = "event_id") -> DataFrame:
    """Current record per task; partial maxima are taken before the shuffle."""
    rest = [c for c in events.columns if c != "task_id"]
    return events.groupBy("task_id").agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r")).select("task_id", "_r.*")


def validate_transitions(events: DataFrame, at: str = "at", tie: str = "event_id", width: float | None = None) -> DataFrame:
    """Every event with the status before it and a verdict: start, same, allowed or rejected."""
    seen = neighbours(events, ["task_id"], [at, tie], width, {"previous_status": "status"})
    before, status = F.col("previous_status"), F.col("status")
    verdict = (
        F.when(before.isNull(), "start").when(before == status, "same")
        .when(transition_allowed(before, status), "allowed").otherwise("rejected")
    )
    return seen.withColumn("verdict", verdict)


def recover_orphans(events: DataFrame, cutoff: Column, at: str = "at", tie: str = "event_id") -> DataFrame:
    """Tasks whose last record before the cut-off says running or retrying are failed as interrupted."""
    last = latest_task_state(events.filter(F.col(at) < cutoff), at, tie)
    return last.filter(F.col("status").isin(*fixed.ORPHAN_STATUSES)).select(
        "task_id", F.lit("failed").alias("status"), F.lit("INTERRUPTED").alias("error_code"), cutoff.alias("finished_at")
    )


def retry_tasks(states: DataFrame, now: Column) -> DataFrame:
    """New pending tasks for failed and cancelled ones; the old rows stay, the parameters are copied."""
    again = states.filter(F.col("status").isin("failed", "cancelled"))
    return again.select(
        F.md5(F.concat_ws("\x1f", F.col("task_id").cast("string"), F.lit("retry"))).alias("task_id"),
        F.col("task_id").cast("string").alias("parent_task_id"),
        F.lit("pending").alias("status"),
        *[c for c in states.columns if c in ("params", "type", "book_id", "source_id")],
        now.alias("created_at"),
    )


def retry_lineage(tasks: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Root task and number of retries of every task (task_id, parent_task_id).

    Each round jumps twice as far up as the one before, so a chain of n retries takes log2(n) rounds; every round is a
    checkpoint. A task that has met its root leaves the loop, so later rounds only carry what is still under way. The tasks
    between a root and any other are settled one after the other, so a round that settles none has only tasks left that end in a
    circle; they come out with a null root. ``max_rounds`` is only a guard: 64 rounds reach further than any table.
    """
    known = tasks.select(F.col("task_id").alias("_t"))
    first = tasks.join(known, F.col("parent_task_id") == F.col("_t"), "left").select(
        "task_id", F.col("_t").alias("up"), F.when(F.col("_t").isNotNull(), 1).otherwise(0).cast("long").alias("retries")
    )
    first = cut_lineage(first)
    # a task without a parent is its own root; a settled task keeps its root in ``up``
    settled = [first.filter(F.col("up").isNull()).withColumn("up", F.col("task_id"))]
    active = first.filter(F.col("up").isNotNull())
    left = active.count()
    for _ in range(max_rounds):
        if not left:
            break
        met = reduce(DataFrame.unionByName, [s.withColumn("_done", F.lit(True)) for s in settled]).unionByName(active.withColumn("_done", F.lit(False)))
        hop = met.select(F.col("task_id").alias("up"), F.col("up").alias("_next"), F.col("retries").alias("_more"), "_done")
        stepped = cut_lineage(
            active.join(hop, "up", "left").select("task_id", F.col("_next").alias("up"), (F.col("retries") + F.col("_more")).alias("retries"), "_done")
        )
        settled.append(stepped.filter("_done").drop("_done"))
        active = stepped.filter(~F.col("_done")).drop("_done")
        before, left = left, active.count()
        if left == before:
            break
    rooted = reduce(DataFrame.unionByName, settled).select("task_id", F.col("up").alias("root_task_id"), "retries")
    circles = active.select("task_id", F.lit(None).cast(rooted.schema["root_task_id"].dataType).alias("root_task_id"), "retries")
    return rooted.unionByName(circles)


def run_report(items: DataFrame) -> DataFrame:
    """Per task: what was done, what failed, the first failure; a task fails only when nothing succeeded.

    ``items``: task_id, ord, outcome (downloaded, failed, skipped, missing), code, message.
    """
    out = F.col("outcome")
    failed = out == "failed"
    first = F.min_by(F.when(failed, F.struct("code", "message")), F.when(failed, F.col("ord")))
    return (
        items.groupBy("task_id")
        .agg(
            *[F.count_if(out == k).alias(k) for k in ("downloaded", "failed", "skipped", "missing")],
            first.alias("_first"),
        )
        .select(
            "task_id", "downloaded", "failed", "skipped", "missing",
            (F.col("failed") == 0).alias("ok"),
            (F.col("downloaded") + F.col("failed") == 0).alias("is_noop"),
            F.when((F.col("downloaded") == 0) & (F.col("failed") > 0), "failed").otherwise("success").alias("status"),
            F.col("_first.code").alias("first_code"),
            F.col("_first.message").alias("first_message"),
        )
    )


def failures(items: DataFrame) -> DataFrame:
    return items.filter(F.col("outcome") == "failed").select("task_id", "ord", "title", "url", "code", "message")


def throttle_progress(
    events: DataFrame, interval: float = fixed.PROGRESS_INTERVAL_SECONDS, width: float | None = None,
    task: str = "task_id", at: str = "at", tie: str = "event_id", done: str = "done", total: str = "total",
) -> DataFrame:
    """Per task keep the first event, then one only ``interval`` after the last kept; a final event always passes.

    An event at least ``interval`` after the event before it is kept whatever came earlier, and so is a final one: both
    start a new burst that can be thinned on its own. A burst of any length is cut into ranges of the order. Each range says, for
    every event that can be its first kept one, which event it keeps last; these few numbers are followed from range to range,
    and then every range is thinned by itself from the event that was kept before it. So rows are never gathered per burst: of a
    burst that is denser than its ranges, eight bytes an event are read as a stream in one task.
    """
    # one cut into ranges serves all passes; both tables are written because several of them read them
    placed = cut_lineage(with_ranges(events, [task], [at, tie], width))
    seen = neighbours(placed, [task], [at, tie], width, {"_previous": at})
    pause = F.col("_previous").isNull() | (F.col(at) - F.col("_previous") >= interval)
    marked = seen.withColumn("_start", pause | (F.col(done) >= F.col(total))).drop("_previous")
    ranged = cut_lineage(running_sums(marked, [task], [at, tie], width, {"_burst": F.col("_start").cast("long")}))
    keys = [task, "_burst"]
    several = ranged.groupBy(*keys).agg((F.min(RANGE) < F.max(RANGE)).alias("_cut")).filter("_cut")
    several = several.select(F.col(task).alias("_t"), F.col("_burst").alias("_b"))
    place = [task, "_burst", RANGE]
    long = ranged.join(several, F.col(task).eqNullSafe(F.col("_t")) & (F.col("_burst") == F.col("_b")), "left_semi")
    moments = long.select(*place, F.col(at).cast("double").alias("_at")).repartition(*place).sortWithinPartitions(*place, "_at")
    ddl = T.StructType([*[ranged.schema[c] for c in place], T.StructField("entry", T.BinaryType()), T.StructField("exit", T.BinaryType())])
    steps = moments.mapInPandas(lambda frames: _range_steps(frames, place, interval), ddl)
    ddl = T.StructType([*[ranged.schema[c] for c in place], T.StructField("_kept", T.DoubleType())])
    followed = steps.repartition(*keys).sortWithinPartitions(*place).mapInPandas(lambda frames: _followed(frames, place, interval), ddl)
    side = followed.select(F.col(task).alias("_t"), F.col("_burst").alias("_b"), F.col(RANGE).alias("_r"), "_kept")
    met = F.col(task).eqNullSafe(F.col("_t")) & (F.col("_burst") == F.col("_b")) & (F.col(RANGE) == F.col("_r"))
    ready = ranged.join(side, met, "left").drop("_t", "_b", "_r").repartition(*place).sortWithinPartitions(*place, at, tie)
    names, kinds = events.columns, events.schema

    def thin(batches):  # noqa: ANN001, ANN202
        group, kept = None, None
        for batch in batches:
            keep = []
            for *here, moment, start, before in zip(*[batch[c] for c in place], batch[at], batch["_start"], batch["_kept"]):
                if here != group:
                    group, kept = here, None if pd.isna(before) else before
                ok = bool(start) or kept is None or moment - kept >= interval
                if ok:
                    kept = moment
                keep.append(ok)
            yield batch.loc[keep, names]

    return ready.mapInPandas(thin, T.StructType(kinds.fields))


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a stream that is sorted by ``keys``; a group is at most one range of the order."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        new = (frame[keys] != frame[keys].shift()) & ~(frame[keys].isna() & frame[keys].shift().isna())
        starts = np.flatnonzero(np.r_[True, new.any(axis=1).to_numpy()[1:]])
        for lo, hi in zip(starts[:-1], starts[1:]):
            yield frame.iloc[lo:hi]
        held = frame.iloc[starts[-1] :]
    if held is not None:
        yield held


def _range_steps(frames: Iterator[pd.DataFrame], place: list[str], interval: float) -> Iterator[pd.DataFrame]:
    """One row per range: times of the events that may be kept first in it, and the time of the last one kept after each."""
    for rows in _groups(frames, place):
        moments = rows["_at"].to_numpy()
        after = _first_after(moments, moments, interval)
        last = np.arange(len(moments))
        for k in range(len(moments) - 1, -1, -1):
            if after[k] < len(moments):
                last[k] = last[after[k]]
        first = int(np.searchsorted(moments, moments[0] + interval, "right")) + 1  # entries, and the first event past them
        row = {c: [rows[c].iloc[0]] for c in place}
        yield pd.DataFrame(row | {"entry": [moments[:first].tobytes()], "exit": [moments[last[:first]].tobytes()]})


def _first_after(moments: np.ndarray, kept: np.ndarray, interval: float) -> np.ndarray:
    """Place of the first moment m with m - kept >= interval, by that very comparison."""
    at = np.searchsorted(moments, kept + interval, "left")
    while True:  # the sum may be rounded to either side of the difference
        back = (at > 0) & (moments[np.maximum(at, 1) - 1] - kept >= interval)
        on = (at < len(moments)) & (moments[np.minimum(at, len(moments) - 1)] - kept < interval)
        if not (back.any() or on.any()):
            return at
        at = np.where(back, at - 1, np.where(on, at + 1, at))


def _followed(frames: Iterator[pd.DataFrame], place: list[str], interval: float) -> Iterator[pd.DataFrame]:
    """For every range of a burst, in order, the time of the event kept last before it (none before the first range)."""
    burst, kept = None, None
    for frame in frames:
        before = []
        for *here, _, entry, leave in zip(*[frame[c] for c in place], frame["entry"], frame["exit"]):
            entries, exits = np.frombuffer(entry), np.frombuffer(leave)
            here = [None if pd.isna(h) else h for h in here]
            if here != burst:
                burst, kept = here, None
            before.append(kept)
            at = 0 if kept is None else int(_first_after(entries, np.array([kept]), interval)[0])
            if at < len(entries):
                kept = exits[at]
        yield frame[place].assign(_kept=pd.Series(before, dtype="float64", index=frame.index))
