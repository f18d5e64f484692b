"""Streaming operators driven by the given tables until they are drained; batch SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators import library as L
from pagemill.operators.quality import ContentPolicy, accepted, process_content
from pagemill.plans import crawl, quality
from pagemill.plans import sqltext as S
from pagemill.plans import views as W
from pagemill.plans.registry import Tables, query
from pagemill.session import new_folder
from pagemill.streaming import intake as I
from pagemill.streaming import tasks as K


def streamed(t: Tables, table: str) -> DataFrame:
    """A given table as a file stream, be it one file or a folder of files. The path is a pattern for one name: a plain path would
    become the stream's base path, which must be a folder."""
    spark, folder = t._spark, t._folder  # noqa: SLF001
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that has landed and read its sink back from the shared folder."""
    spark: SparkSession = stream.sparkSession
    root = new_folder(spark, "stream")
    latest = f"{root}/out"

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{latest}/current")

    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", latest)
    else:
        writer = stream.writeStream.foreachBatch(replace)
    writer = writer.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    run = writer.start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(latest)


def _events(t: Tables) -> DataFrame:
    status = F.create_map(*[F.lit(x) for p in W.STATUS.items() for x in p])
    return streamed(t, "events").select(
        F.col("user_id").cast("string").alias("task_id"), "event_id", F.try_element_at(status, F.col("event_type")).alias("status"),
        F.col("ts").cast("timestamp").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


@query("stream_task_events", """
  SELECT user_id::VARCHAR AS task_id, event_id, event_type AS status FROM events WHERE event_type NOT IN ('view', 'click')""")
def task_events(t: Tables):  # noqa: ANN201
    """Feed lines: views are heartbeats, clicks are cut off in the middle of a record."""
    record = F.to_json(F.struct(F.lit("task").alias("event"), "event_id", F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("status")))
    line = (
        F.when(F.col("event_type") == "view", ": keep-alive").when(F.col("event_type") == "click", F.left(record, F.lit(20)))
        .otherwise(F.concat(F.lit("data: "), record))
    )
    feed = streamed(t, "events").select(line.alias("value"))
    return drained(K.task_event_stream(feed).select("task_id", "event_id", "status"))


@query("stream_throttle", """
  WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS a, json_extract_string(props, '$.k')::INT >= 90 AS final, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  kept AS (SELECT user_id, event_id, a, k FROM e WHERE k = 1
    UNION ALL
    SELECT n.user_id, n.event_id, n.a, n.k FROM (
      SELECT e.user_id, e.event_id, e.a, e.k, row_number() OVER (PARTITION BY e.user_id ORDER BY e.k) AS rn
      FROM kept JOIN e ON e.user_id = kept.user_id AND e.k > kept.k AND (e.a - kept.a >= 43200000000 OR e.final)) n WHERE n.rn = 1)
  SELECT user_id::VARCHAR AS task_id, event_id FROM kept""")
def throttle(t: Tables):  # noqa: ANN201
    events = _events(t).select("task_id", "event_id", "at", F.col("k").alias("done"), F.lit(90).cast("long").alias("total"))
    return drained(K.throttle_progress_stream(events, 43_200)).select("task_id", "event_id")


@query("stream_latest_state", f"""{crawl.EV}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY micros DESC, event_id DESC) AS rn FROM e)
  SELECT task_id, event_id, status, k FROM r WHERE rn = 1""")
def latest_state(t: Tables):  # noqa: ANN201
    return drained(K.latest_state_stream(_events(t)), "complete").select("task_id", "event_id", "status", "k")


@query("stream_transitions", f"""{crawl.EV}, p AS (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY micros, event_id) AS previous_status FROM e)
  SELECT event_id, previous_status, status, CASE WHEN previous_status IS NULL THEN 'start' WHEN previous_status = status THEN 'same'
         WHEN previous_status || '>' || status IN ({crawl._EDGES}) THEN 'allowed' ELSE 'rejected' END AS verdict FROM p""")
def transitions(t: Tables):  # noqa: ANN201
    return drained(K.validate_transitions_stream(_events(t))).select("event_id", "previous_status", "status", "verdict")


@query("stream_recover_orphans", """
  WITH e AS (SELECT user_id, event_id, event_type, date_trunc('hour', ts) AS h FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h DESC, event_id DESC) AS rn FROM e)
  SELECT user_id::VARCHAR AS task_id, 'failed' AS status, 'INTERRUPTED' AS error_code, epoch_us(h + INTERVAL 3 HOUR) AS finished
  FROM r WHERE rn = 1 AND event_type = 'click' AND h + INTERVAL 3 HOUR < (SELECT max(h) FROM e) - INTERVAL 10 MINUTE""")
def recovered(t: Tables):  # noqa: ANN201
    """Times are cut to the hour, so that many events of a task fall on one instant and their numbers decide."""
    events = _events(t).withColumn("at", F.date_trunc("hour", "at"))
    out = drained(K.recover_orphans_stream(events, "3 hours", "10 minutes"))
    return out.select("task_id", "status", "error_code", F.unix_micros("finished_at").alias("finished"))


@query("stream_control_events", f"""{crawl.EV}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY micros DESC, event_id DESC) AS rn FROM e)
  SELECT task_id, CASE event_id % 5 WHEN 0 THEN 'paused' WHEN 1 THEN 'running' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'pending' ELSE status END AS status FROM r WHERE rn = 1""")
def controlled(t: Tables):  # noqa: ANN201
    """Four of five events are requests of a user; the last one of a task says where it stands."""
    asked = F.get(F.array(*[F.lit(a) for a in ("pause", "resume", "cancel", "retry")]), (F.col("event_id") % 5).cast("int"))
    events = K.control_events(_events(t).withColumn("action", asked))
    return drained(K.latest_state_stream(events.drop("action")), "complete").select("task_id", "status")


@query("stream_windows", """
  SELECT status, epoch_us(w) AS start, n FROM (SELECT event_type AS status, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY 1, 2)
  WHERE w + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
def windows(t: Tables):  # noqa: ANN201
    """Closed windows only: the last open one is emitted when later events arrive."""
    events = streamed(t, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("status"))
    out = drained(K.windowed_counts(events, "1 hour", "10 minutes"))
    return out.select("status", F.unix_micros("start").alias("start"), "n")


@query("stream_sessions", """
  WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
  g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
  SELECT user_id::VARCHAR AS task_id, epoch_us(min(ts)) AS start, count(*) AS n FROM g GROUP BY user_id, g
  HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
def sessions(t: Tables):  # noqa: ANN201
    out = drained(K.sessions(_events(t), "6 hours", "10 minutes"))
    return out.select("task_id", F.unix_micros("start").alias("start"), "n")


@query("stream_dedup_requests", """
  WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
  kept AS (SELECT user_id, a, k FROM e WHERE k = 1
    UNION ALL
    SELECT n.user_id, n.a, n.k FROM (
      SELECT e.user_id, e.a, e.k, row_number() OVER (PARTITION BY e.user_id ORDER BY e.k) AS rn
      FROM kept JOIN e ON e.user_id = kept.user_id AND e.k > kept.k AND e.a - kept.a >= 86400000000) n WHERE n.rn = 1)
  SELECT 'https://e.com/x?a=1&b=' || user_id AS url, a AS micros FROM kept""")
def dedup(t: Tables):  # noqa: ANN201
    """Every user asks for one page again and again, spelled in two ways: served from the cache for a day, then fetched anew."""
    user = F.col("user_id").cast("string")
    spelled = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://e.com/x?b="), user, F.lit("&a=1"))).otherwise(F.concat(F.lit("HTTPS://E.com:443/x?a=1&b="), user))
    requests = streamed(t, "events").select(
        F.lit("s").alias("source_id"), F.lit("GET").alias("method"), spelled.alias("url"), F.col("ts").cast("timestamp").alias("requested_at")
    )
    out = drained(I.dedup_requests(requests, 86_400).select(U.normalize_url("url").alias("url"), "requested_at"))
    return out.select("url", F.unix_micros("requested_at").alias("micros"))


@query("stream_watch_task", """
  WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE user_id = 7)
  SELECT user_id::VARCHAR AS task_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' ELSE 'running' END AS status
  FROM e WHERE k <= coalesce((SELECT min(k) FROM e WHERE event_type IN ('error', 'purchase')), 9223372036854775807)""")
def watch(t: Tables):  # noqa: ANN201
    """One task is followed until it has ended; what comes after that is not part of the watch."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").otherwise("running")
    record = F.to_json(F.struct(
        F.lit("task").alias("event"), "event_id", F.col("user_id").cast("string").alias("task_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at")))
    feed = streamed(t, "events").select(F.concat(F.lit("data: "), record).alias("value"))
    root = new_folder(t._spark, "watch")  # noqa: SLF001
    events = K.task_event_stream(feed, "7").select("task_id", "event_id", "status", "at")
    K.watch_task(events, lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint", available_now=True)
    seen = t._spark.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")  # noqa: SLF001
    return seen.select("task_id", "event_id", "status")


@query("stream_process_content", f"""{quality.PROCESSED}
  SELECT doc_id, {S.words('body')} AS word_count, {S.content_hash('body')} AS content_hash FROM g WHERE reason IS NULL""")
def content(t: Tables):  # noqa: ANN201
    done = accepted(process_content(streamed(t, "documents").select("doc_id", "text"), policy=quality.POLICY))
    return drained(done.select("doc_id", F.col("word_count").cast("long").alias("word_count"), "content_hash"))


_LANDED = 1704067200
_INTAKE = f"""WITH ch AS ({W.CHAPTERS}),
  a AS (SELECT book_id, "index", title, {S.normalize(S.clean('content'))} AS body, {_LANDED} AS seen, 0 AS batch FROM ch),
  b AS (SELECT book_id, "index", title, {S.normalize(S.clean("CASE WHEN substr(book_id, 2)::BIGINT % 7 = 0 THEN ' ' WHEN substr(book_id, 2)::BIGINT % 5 = 0 THEN content || ' more' ELSE content END"))} AS body,
        {_LANDED + 3600} AS seen, 1 AS batch FROM ch)"""


def _intake(t: Tables) -> tuple[I.ChapterTable, str]:
    """Three batches: all chapters; all again, some changed and some empty; the same once more. The table and its rejects."""
    spark = t._spark  # noqa: SLF001
    table = I.ChapterTable(spark, new_folder(spark, "intake"), buckets=8)
    rejects = f"{table.root}/rejects"
    policy = ContentPolicy(min_length=0, max_length=10**9, min_script_ratio=0.0, max_repeat_line_ratio=1.0, script=r"\p{L}")
    step = I.intake_batch(table, policy, lambda bad, n: bad.withColumn("batch", F.lit(n).cast("long")).write.mode("append").parquet(rejects))
    book = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    landed = streamed(t, "conversations").select(
        "conv_id", book.alias("book_id"),
        F.when(F.col("conv_id") % 3 != 0, F.concat(book, F.lit("."), F.col("turn").cast("string"))).alias("source_chapter_id"),
        F.concat(F.col("role"), F.lit(" "), F.col("turn").cast("string")).alias("title"),
        F.concat(F.lit("https://Books.example.com/"), book, F.lit("/"), F.col("turn").cast("string")).alias("url"),
        F.col("turn").cast("long").alias("index"), F.col("text").alias("content"),
    )
    later = F.when(F.col("conv_id") % 7 == 0, " ").when(F.col("conv_id") % 5 == 0, F.concat("content", F.lit(" more"))).otherwise(F.col("content"))
    before = -1
    for number, content in enumerate((F.col("content"), later, later)):
        rows = landed.withColumns({"content": content, "landed_at": F.timestamp_seconds(F.lit(_LANDED + 3600 * number))}).drop("conv_id")
        before = table.last_batch()
        run = (
            rows.writeStream.foreachBatch(lambda df, i, n=number: step(df, n))
            .option("checkpointLocation", f"{table.root}/checkpoint-{number}").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    if table.last_batch() != before:
        raise RuntimeError("the repeated run changed the table")
    return table, rejects


@query("incremental_intake", f"""{_INTAKE}
  SELECT a.book_id, a."index", a.title, CASE WHEN n THEN {S.words('b.body')} ELSE {S.words('a.body')} END AS word_count, true AS has_content,
         CASE WHEN n THEN {S.content_hash('b.body')} ELSE {S.content_hash('a.body')} END AS content_hash, a.seen AS created, CASE WHEN n THEN b.seen ELSE a.seen END AS updated,
         CASE WHEN n THEN b.batch ELSE a.batch END AS batch
  FROM (SELECT a.book_id, a."index", b.body <> '' AND {S.content_hash('a.body')} <> {S.content_hash('b.body')} AS n FROM a JOIN b USING (book_id, "index")) AS k
  JOIN a USING (book_id, "index") JOIN b USING (book_id, "index") WHERE a.body <> ''""")
def incremental(t: Tables):  # noqa: ANN201
    """What is stored after an insert, a change with rejects, and a repeat that changes nothing."""
    table, _ = _intake(t)
    seconds = lambda c: F.unix_timestamp(c)
    return table.current().select(
        "book_id", "index", "title", F.col("word_count").cast("long").alias("word_count"), "has_content", "content_hash",
        seconds("created_at").alias("created"), seconds("updated_at").alias("updated"), "batch",
    )


@query("intake_rejects", f"""{_INTAKE}
  SELECT book_id, "index", title, 'empty' AS reason, batch FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT book_id, "index", title, body, seen, 2 FROM b) WHERE body = ''""")
def intake_rejects(t: Tables):  # noqa: ANN201
    """Rows that failed the gate in each batch, while the batch went on."""
    table, rejects = _intake(t)
    return table.spark.read.parquet(rejects).select("book_id", "index", "title", "reason", "batch")


@query("intake_summaries", f"""{_INTAKE}, k AS (SELECT a.book_id, a."index", a.title, CASE WHEN b.body <> '' THEN b.body ELSE a.body END AS body FROM a JOIN b USING (book_id, "index") WHERE a.body <> '')
  SELECT book_id, "index", title, {S.words('body')} AS word_count, true AS has_content FROM k""")
def intake_summaries(t: Tables):  # noqa: ANN201
    """The stored table listed from its stored columns: bodies are not in the scan."""
    table, _ = _intake(t)
    return L.list_summaries(table.current()).drop("id").withColumn("word_count", F.col("word_count").cast("long"))
