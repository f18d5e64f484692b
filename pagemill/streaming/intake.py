"""Incremental intake: landed chapters flow into snapshots, a repeated run changes nothing."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill import fixed
from pagemill.functions.urls import identity_key, request_key
from pagemill.operators.merge import upsert_chapters
from pagemill.operators.quality import ContentPolicy, process_content

SNAPSHOT_COLUMNS = (
    "id", "book_id", "source_chapter_id", "title", "url", "index", "content", "content_hash", "word_count", "has_content",
    "created_at", "updated_at", "identity_key", "batch", "bucket",
)
#: Choose it so that a bucket holds some hundred MB; a table keeps the number it began with.
BUCKETS = 64


#: Groups of keys in ``dedup_requests``; a stream keeps the number it began with.
REQUEST_BUCKETS = 4096


def dedup_requests(
    requests: DataFrame, ttl_seconds: int = fixed.CACHE_TTL_SECONDS, late: str = "10 minutes", at: str = "requested_at",
    buckets: int = REQUEST_BUCKETS,
) -> DataFrame:
    """Requests that must be fetched: the first of its key, then the first after each time to live has run out.

    Built-in deduplication may also swallow a repeat that comes later than the time to live, so the expiry is kept as
    state: one number per key. Keys are grouped in hash buckets, because a call costs milliseconds however few rows it has.
    Expiries that the watermark has passed are dropped when their bucket is met again, the whole bucket by an event-time timer
    once all have run out. Requests without a time are dropped.
    """
    keyed = requests.withColumn("request_key", request_key("source_id", "method", "url"))
    names, ttl = keyed.columns, ttl_seconds * 1_000_000

    def serve(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        expires = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(frames)
        codes, keys = pd.factorize(rows["request_key"], use_na_sentinel=False)
        micros = rows["_micros"].to_numpy()
        order = np.lexsort((micros, codes))
        times, fetch, start = micros[order].tolist(), [], 0
        for key, end in zip(keys, np.cumsum(np.bincount(codes)).tolist()):
            place = bisect_left(times, expires[key], start, end) if key in expires else start
            while place < end:
                fetch.append(place)
                expires[key] = times[place] + ttl
                place = bisect_left(times, expires[key], place + 1, end)
            start = end
        passed = state.getCurrentWatermarkMs()
        kept = {k: e for k, e in expires.items() if e // 1000 >= passed}
        state.update((list(kept), list(kept.values())))
        state.setTimeoutTimestamp(max(max(kept.values(), default=0) // 1000, passed + 1))
        yield rows.iloc[order[fetch]][names]

    return (
        keyed.filter(F.col(at).isNotNull()).withWatermark(at, late)
        .withColumns({"_micros": F.unix_micros(at), "_bucket": F.pmod(F.xxhash64("request_key"), F.lit(buckets)).cast("int")})
        .groupBy("_bucket")
        .applyInPandasWithState(serve, keyed.schema, "keys array<string>, expires array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def identified(processed: DataFrame, batch: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """The accepted rows of ``process_content`` over ``content`` as chapters in the columns of the stored table."""
    return (
        processed.filter(F.col("rejected").isNull())
        .withColumn("content", F.col("body"))
        .withColumn("identity_key", identity_key("source_chapter_id", "url", "index", "title"))
        .withColumns(
            {
                "id": F.md5(F.concat_ws("\x1f", "book_id", "identity_key")),
                "has_content": F.length("content") > 0,
                "created_at": F.col("landed_at"), "updated_at": F.col("landed_at"),
                "batch": F.lit(batch).cast("long"),
                "bucket": F.pmod(F.xxhash64("book_id", "identity_key"), F.lit(buckets)).cast("int"),
            }
        )
        .select(*SNAPSHOT_COLUMNS)
    )


def reject_rows(processed: DataFrame) -> DataFrame:
    return processed.filter(F.col("rejected").isNotNull()).select("book_id", "url", "index", "title", "rejected.*")


def prepare_chapters(landed: DataFrame, policy: ContentPolicy, extra_junk: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Cleaned and identified chapters, and the rejects with their reasons. Each of the two cleans the texts again when it is
    run on its own; ``intake_batch`` writes the cleaned batch first."""
    done = process_content(landed, "content", policy, extra_junk)
    return identified(done), reject_rows(done)


def observed(processed: DataFrame, name: str = "intake") -> DataFrame:
    """Counts of accepted and rejected rows as metrics of the query that runs anyway; no second pass."""
    good = F.col("rejected").isNull()
    return processed.observe(
        name, F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"),
        F.coalesce(F.sum(F.when(good, F.col("word_count"))), F.lit(0)).alias("words"),
    )


def _same(columns: Iterable[str]):  # noqa: ANN202
    return [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]


def changed_only(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Rows whose identity is new or whose title, link or text differs; equal rows are skipped. Bodies of ``current`` are not read."""
    if current is None:
        return incoming
    columns = ("book_id", "identity_key", "content_hash", "title", "url")
    return incoming.alias("l").join(current.select(*columns).alias("r"), _same(columns), "left_anti")


class ChapterTable:
    """The chapter table as plain Parquet in hash buckets, one partition folder each; a batch rewrites only the buckets it changes.

    The bucket comes from (book, identity), so a book of any size is spread. The new content of the touched buckets is written
    beside the table first and then put in their place by a dynamic partition overwrite. A run that stopped in between is
    finished by the next one from that copy; a copy without its success mark was never applied and is written anew. Every row
    names the batch that wrote it, so a batch that is replayed after it was applied is known.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.path, self.staged, self.cleaned = f"{self.root}/chapters-{buckets}", f"{self.root}/_staged", f"{self.root}/_cleaned"

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, system = self._path(name)
        return system.exists(path)

    def _remove(self, name: str) -> None:
        path, system = self._path(name)
        system.delete(path, True)

    def current(self, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets (other folders are not listed as input)."""
        path, system = self._path(f"{self.path}/bucket=*/*.parquet")
        if not system.globStatus(path):
            return None
        rows = self.spark.read.parquet(self.path)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets))

    def last_batch(self) -> int:
        """The newest batch that changed a row; -1 before the first."""
        rows = self.current()
        newest = None if rows is None else rows.agg(F.max("batch")).first()[0]
        return -1 if newest is None else newest

    def begin(self, rows: DataFrame) -> None:
        """An empty table with the columns of ``rows``, for the time until a chapter is accepted."""
        rows.select(*SNAPSHOT_COLUMNS).drop("bucket").limit(0).write.mode("overwrite").parquet(f"{self.path}/bucket=0")

    def replace(self, rows: DataFrame, touched: int) -> None:
        """Put ``rows`` in the place of the buckets they belong to; ``touched``: how many there are."""
        placed = rows.select(*SNAPSHOT_COLUMNS).repartition(max(1, touched), "bucket").sortWithinPartitions("bucket", "book_id", "index")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(self.staged)
        self.recover()

    def recover(self) -> None:
        """Finish what was staged whole; nothing to do in the usual case."""
        if self._exists(f"{self.staged}/_SUCCESS"):
            rows = self.spark.read.parquet(self.staged)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            self._remove(self.staged)


def intake_batch(
    table: ChapterTable, policy: ContentPolicy, on_rejects: Callable[[DataFrame, int], None] | None = None, extra_junk: Iterable[str] = ()
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: clean once, gate, diff against the stored rows, merge, rewrite the changed buckets."""

    def apply(landed: DataFrame, batch: int) -> None:
        table.recover()
        if batch <= table.last_batch():
            return
        process_content(landed, "content", policy, extra_junk).write.mode("overwrite").parquet(table.cleaned)
        done = table.spark.read.parquet(table.cleaned)
        if on_rejects is not None:
            on_rejects(reject_rows(done), batch)
        good = identified(done, batch, table.buckets)
        hit = [r[0] for r in good.select("bucket").distinct().collect()]  # at most the number of buckets
        current = table.current(hit)
        fresh = changed_only(current, good)
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
        if touched:
            known = good.limit(0) if current is None else current.filter(F.col("bucket").isin(*touched))
            table.replace(upsert_chapters(known, fresh), len(touched))
        elif table.current() is None:
            table.begin(good)
        table._remove(table.cleaned)  # noqa: SLF001

    return apply
