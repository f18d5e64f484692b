"""Task events as a stream: parsing, thinning, current state, transition checks, recovery."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from threading import Event

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill import fixed
from pagemill.operators.tasks import transition_allowed

EVENT = (
    "event string, event_id bigint, task_id string, type string, status string, book_id string, total bigint, "
    "completed bigint, failed bigint, error_code string, error_message string, at timestamp"
)


def task_event_stream(lines: DataFrame, task_id: str | None = None, value: str = "value") -> DataFrame:
    """JSON records of a feed: heartbeats and malformed lines are dropped, one task may be picked out."""
    text = F.regexp_replace(F.col(value), r"^data:\s*", "")
    events = lines.select(F.from_json(text, EVENT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    events = events.filter((F.col("event") == "task") & F.col("task_id").isNotNull())
    return events if task_id is None else events.filter(F.col("task_id") == task_id)


def is_terminal(status: Column) -> Column:
    return status.isin(*fixed.TERMINAL_STATUSES)


def until_terminal(events: DataFrame, at: str = "at", tie: str = "event_id") -> DataFrame:
    """Events of one task up to its first terminal status, that one included."""
    place = F.struct(at, tie)
    end = events.filter(is_terminal(F.col("status"))).agg(F.min(place).alias("_end"))
    return events.join(F.broadcast(end), F.col("_end").isNull() | (place <= F.col("_end"))).drop("_end")


def watch_task(
    events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, poll_seconds: float = 0.2
) -> bool:
    """Follow a stream of one task's events until a terminal status has come; True if it has.

    ``apply`` gets each micro-batch up to the terminal event. The stream is stopped then; batches that were planned meanwhile
    give nothing. With ``available_now`` the watch also ends when all that has landed is read. A watch that is started again from
    the same checkpoint goes on after the last batch.
    """
    ended = Event()

    def step(batch: DataFrame, number: int) -> None:
        if ended.is_set():
            return
        rows = batch.persist()
        try:
            apply(until_terminal(rows), number)
            if not rows.filter(is_terminal(F.col("status"))).isEmpty():
                ended.set()
        finally:
            rows.unpersist()

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    run = (writer.trigger(availableNow=True) if available_now else writer).start()
    while not ended.is_set() and not run.awaitTermination(poll_seconds):
        pass
    if ended.is_set():
        run.stop()
    return ended.is_set()


THINNED = "task_id string, event_id bigint, at timestamp, done bigint, total bigint"


def _milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def _expire(state: GroupState, at_ms: int) -> None:
    """The state goes once the watermark has passed ``at_ms``."""
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs() + 1))


def _micros(moment) -> int:  # noqa: ANN001
    return pd.Timestamp(moment).value // 1000


def throttle_progress_stream(events: DataFrame, interval: float = fixed.PROGRESS_INTERVAL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """First event of a task, then one only ``interval`` seconds after the last kept; final events always pass.

    The state is one timestamp per task, and only as long as it matters: once the watermark is ``interval`` past the last event
    kept, the next one passes anyway, so the timer drops it and nothing is lost. Rows more than ``late`` behind the newest are
    dropped. Order is that of event time inside a micro-batch; bound the batch size with the trigger options of the source.
    """
    micros = int(interval * 1_000_000)

    def thin(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values(["at", "event_id"])
        keep = []
        for at, done, total in zip(rows["at"], rows["done"], rows["total"]):
            moment = _micros(at)
            ok = kept is None or done >= total or moment - kept >= micros
            if ok:
                kept = moment
            keep.append(ok)
        state.update((kept,))
        _expire(state, (kept + micros) // 1000 + 1)
        yield rows.loc[keep, ["task_id", "event_id", "at", "done", "total"]]

    return (
        events.withWatermark("at", late).select("task_id", "event_id", "at", "done", "total").groupBy("task_id")
        .applyInPandasWithState(thin, THINNED, "kept bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


def latest_state_stream(events: DataFrame) -> DataFrame:
    """Current record per task, for update mode; partial maxima before the shuffle."""
    rest = [c for c in events.columns if c != "task_id"]
    return events.groupBy("task_id").agg(F.max_by(F.struct(*rest), F.struct("at", "event_id")).alias("r")).select("task_id", "r.*")


def windowed_counts(events: DataFrame, window: str, late: str, by: str = "status", slide: str | None = None) -> DataFrame:
    """Events per window and status; rows later than ``late`` behind the newest are dropped."""
    span = F.window("at", window, slide) if slide else F.window("at", window)
    return (
        events.withWatermark("at", late).groupBy(span, by)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")
    )


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Bursts of activity per task, closed by a pause of ``gap``."""
    return (
        events.withWatermark("at", late).groupBy(F.session_window("at", gap), "task_id")
        .agg(F.count("*").alias("n"))
        .select("task_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


CHECKED = "task_id string, event_id bigint, at timestamp, previous_status string, status string, verdict string"
_EDGES = frozenset(fixed.TASK_TRANSITIONS)


def validate_transitions_stream(
    events: DataFrame, late: str = "10 minutes", keep: str = "30 days", keep_ended: str = "1 day"
) -> DataFrame:
    """Every event with the status before it and a verdict; the state is one status per task.

    A task that has ended is remembered for ``keep_ended`` of event time, so that a record after the end is still rejected, any other
    for ``keep`` after its last event; then the timer drops it, and a task that comes back later starts anew. Rows more than
    ``late`` behind the newest are dropped.
    """
    spans = {True: _milliseconds(keep_ended), False: _milliseconds(keep)}

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values(["at", "event_id"])
        previous, verdicts = [], []
        for status in rows["status"]:
            previous.append(before)
            verdicts.append(
                "start" if before is None else "same" if before == status
                else "allowed" if (before, status) in _EDGES else "rejected"
            )
            before = status
        state.update((before,))
        _expire(state, _micros(rows["at"].iloc[-1]) // 1000 + spans[before in fixed.TERMINAL_STATUSES])
        yield rows.assign(previous_status=previous, verdict=verdicts)[
            ["task_id", "event_id", "at", "previous_status", "status", "verdict"]
        ]

    return (
        events.withWatermark("at", late).select("task_id", "event_id", "at", "status").groupBy("task_id")
        .applyInPandasWithState(check, CHECKED, "status string", "append", GroupStateTimeout.EventTimeTimeout)
    )


RECOVERED = "task_id string, status string, error_code string, finished_at timestamp"


def recover_orphans_stream(events: DataFrame, silence: str, late: str) -> DataFrame:
    """Tasks whose last status is running or retrying and that stay silent for ``silence`` in event time are failed.

    The last event is that of the latest time and, at equal times, of the greatest number, also across micro-batches. Every state
    has a timer and is gone once its task has been silent for that long.
    """
    quiet_ms = _milliseconds(silence)

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, micros, _ = state.get
            state.remove()
            if status in fixed.ORPHAN_STATUSES:
                end = pd.Timestamp(micros, unit="us") + pd.Timedelta(milliseconds=quiet_ms)
                yield pd.DataFrame(
                    {"task_id": [key[0]], "status": ["failed"], "error_code": ["INTERRUPTED"], "finished_at": [end]}
                )
            return
        status, micros, number = state.get if state.exists else (None, -(1 << 63), -(1 << 63))
        for frame in frames:
            last = frame.sort_values(["at", "event_id"]).iloc[-1]
            moment = _micros(last["at"])
            if (moment, last["event_id"]) >= (micros, number):
                status, micros, number = last["status"], moment, int(last["event_id"])
        state.update((status, micros, number))
        _expire(state, micros // 1000 + quiet_ms)
        yield pd.DataFrame(
            {
                "task_id": pd.Series(dtype="object"), "status": pd.Series(dtype="object"),
                "error_code": pd.Series(dtype="object"), "finished_at": pd.Series(dtype="datetime64[us]"),
            }
        )

    return (
        events.withWatermark("at", late).select("task_id", "event_id", "at", "status").groupBy("task_id")
        .applyInPandasWithState(
            watch, RECOVERED, "status string, micros bigint, number bigint", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def control_events(events: DataFrame) -> DataFrame:
    """Pause, resume, cancel and retry requests are events like others: the action names the status asked for."""
    asked = (
        F.when(F.col("action") == "pause", "paused").when(F.col("action") == "resume", "running")
        .when(F.col("action") == "cancel", "cancelled").when(F.col("action") == "retry", "pending")
    )
    return events.withColumn("status", F.coalesce(asked, "status"))


__all__ = [
    "control_events", "is_terminal", "latest_state_stream", "recover_orphans_stream", "sessions", "task_event_stream",
    "throttle_progress_stream", "transition_allowed", "until_terminal", "validate_transitions_stream", "watch_task", "windowed_counts",
]
