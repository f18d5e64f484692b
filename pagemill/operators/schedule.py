"""Crawl schedules and audits as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.functions.values import is_retryable, retry_delay
from pagemill.operators.ordered import RANGE, neighbours, rejoin, row_numbers, running_sums, with_ranges


def priority_order(tasks: DataFrame, cancelled: DataFrame) -> DataFrame:
    """The work list: cancelled tasks removed, higher priority first, then arrival."""
    return tasks.join(cancelled.select("task_id").distinct(), "task_id", "left_anti").orderBy(F.desc("priority"), "seq")


def work_ranks(tasks: DataFrame, cancelled: DataFrame, arrival: list[str]) -> DataFrame:
    """The whole work list with the 1-based rank of every task, numbered range by range instead of in one sorted task."""
    kept = tasks.join(cancelled.select("task_id").distinct(), "task_id", "left_anti").withColumn("_urgency", -F.col("priority"))
    return row_numbers(kept, [], ["_urgency", *arrival], None, "rank").drop("_urgency")


def politeness_schedule(
    requests: DataFrame, gap: float = fixed.MIN_REQUEST_GAP_SECONDS, width: float | None = None,
    source: str = "source_id", arrival: str = "arrival", tie: str = "request_id",
) -> DataFrame:
    """Earliest start of every request (seconds) with at least ``gap`` between starts of one source.

    start = gap * rn + max over the requests up to it of (arrival - gap * rn). Both the position and the maximum are
    taken per time range first and carried over by a prefix, so the queue of one source is never sorted in one task.
    """
    ranged = with_ranges(requests, [source], [arrival, tie], width)
    here = Window.partitionBy(source, RANGE).orderBy(arrival, tie)
    local = ranged.withColumn("_k", F.row_number().over(here)).withColumn("_slack", F.col(arrival) - F.lit(gap) * F.col("_k"))
    totals = local.groupBy(source, RANGE).agg(F.count("*").alias("_n"), F.max("_slack").alias("_m"))
    before = Window.partitionBy(source).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.withColumn("_peak", F.max(F.col("_m") - F.lit(gap) * F.col("_off")).over(before))
    joined = rejoin(local, offsets.select(source, RANGE, "_off", "_peak"), [source])
    upto = F.max("_slack").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.lit(gap) * F.col("_off")
    return joined.withColumn(
        "start_at", F.greatest(upto, F.col("_peak")) + F.lit(gap) * (F.col("_off") + F.col("_k"))
    ).drop(RANGE, "_k", "_slack", "_off", "_peak")


def gap_violations(
    starts: DataFrame, gap: float = fixed.MIN_REQUEST_GAP_SECONDS, width: float | None = None,
    source: str = "source_id", at: str = "started", tie: str = "request_id",
) -> DataFrame:
    """Starts that follow the one before at the same source too soon."""
    seen = neighbours(starts, [source], [at, tie], width, {"previous_start": at})
    return seen.filter(F.col(at) - F.col("previous_start") < gap).withColumn("gap", F.col(at) - F.col("previous_start"))


def in_flight(
    intervals: DataFrame, width: float | None = None, source: str | None = "source_id", started: str = "started",
    ended: str = "ended",
) -> DataFrame:
    """Highest number of requests open at once, per source or overall. An end at a time frees its slot before a start."""
    keys = [source] if source else []
    edges = intervals.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col(started).alias("at"), F.lit(1).alias("step")),
                F.struct(F.col(ended).alias("at"), F.lit(-1).alias("step")),
            )
        ),
    )
    # equal edges are added up before the shuffle; a slot freed at a time is free for a start at that time
    steps = edges.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    open_now = running_sums(steps, keys, ["at"], width, {"open": F.col("step")})
    return open_now.groupBy(*keys).agg(F.max("open").alias("max_in_flight"))


def politeness_audit(
    intervals: DataFrame, gap: float = fixed.MIN_REQUEST_GAP_SECONDS, per_source: int = fixed.SOURCE_CONCURRENCY,
    width: float | None = None,
) -> DataFrame:
    """Per source: requests, starts that came too soon, highest number open at once, and whether limits held."""
    counts = intervals.groupBy("source_id").agg(F.count("*").alias("requests"))
    soon = gap_violations(intervals, gap, width).groupBy("source_id").agg(F.count("*").alias("too_soon"))
    return (
        counts.join(soon, "source_id", "left")
        .join(in_flight(intervals, width), "source_id", "left")
        .withColumn("too_soon", F.coalesce("too_soon", F.lit(0)))
        .withColumn("within_limits", (F.col("too_soon") == 0) & (F.col("max_in_flight") <= per_source))
    )


def concurrency_audit(
    intervals: DataFrame, per_source: int = fixed.SOURCE_CONCURRENCY, overall: int = fixed.GLOBAL_CONCURRENCY, width: float | None = None,
) -> DataFrame:
    """Highest number of requests open at once against its limit: one row per source, and one for all sources together, whose
    ``source_id`` is null and whose ``scope`` is ``overall``."""
    each = in_flight(intervals, width).select(F.lit("source").alias("scope"), "source_id", "max_in_flight", F.lit(per_source).alias("allowed"))
    whole = in_flight(intervals, width, source=None).filter(F.col("max_in_flight").isNotNull())
    none = F.lit(None).cast(intervals.schema["source_id"].dataType).alias("source_id")
    rows = each.unionByName(whole.select(F.lit("overall").alias("scope"), none, "max_in_flight", F.lit(overall).alias("allowed")))
    return rows.withColumn("within_limit", F.col("max_in_flight") <= F.col("allowed"))


def attempt_history(
    attempts: DataFrame, width: float | None = None, request: str = "request_id", at: str = "at", tie: str = "attempt_id",
    retry_after: Column | None = None,
) -> DataFrame:
    """Number every attempt of a request, with the delay before the next one and whether one is allowed."""
    numbered = row_numbers(attempts, [request], [at, tie], width, "attempt")
    failed = F.col("code").isNotNull()
    again = failed & is_retryable("code", "status_code", F.col("attempt") - 1)
    return numbered.withColumns(
        {"will_retry": again, "next_delay": F.when(again, retry_delay(F.col("attempt") - 1, retry_after))}
    )


def final_outcomes(attempts: DataFrame, request: str = "request_id", at: str = "at", tie: str = "attempt_id") -> DataFrame:
    """Attempts and last outcome per request; combined map-side, no sort."""
    return attempts.groupBy(request).agg(
        F.count("*").alias("attempts"),
        F.max_by(F.coalesce("code", F.lit("OK")), F.struct(at, tie)).alias("outcome"),
    )
