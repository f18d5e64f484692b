from __future__ import annotations

import json
import os

from pyspark.sql import Observation
from pyspark.sql import functions as F

from pagemill.functions.text import content_hash
from pagemill.operators import library, merge
from pagemill.operators.quality import ContentPolicy, process_content
from pagemill.streaming import intake as I
from pagemill.streaming import tasks as K

EVENTS = "task_id string, event_id bigint, at timestamp, status string, done bigint, total bigint"
OPEN = ContentPolicy(min_length=1, min_script_ratio=0.0)


def rows(spark, *items):
    data = [(t, i, None, s, d, n, float(at)) for t, i, at, s, d, n in items]
    df = spark.createDataFrame(data, "task_id string, event_id bigint, at timestamp, status string, done bigint, total bigint, sec double")
    return df.withColumn("at", F.timestamp_micros((F.col("sec") * 1_000_000).cast("long") + 10**12)).drop("sec")


class Feed:
    """A folder that files are dropped into, read as a stream file by file."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema, self.n = spark, root, schema, 0
        (root / "in").mkdir()

    def land(self, df):
        df.coalesce(1).write.mode("append").parquet(str(self.root / "in"))

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.root / "in"))

    def run(self, stream, mode="append", name="out"):
        query = (
            stream.writeStream.outputMode(mode).format("parquet").option("path", str(self.root / name))
            .option("checkpointLocation", str(self.root / f"check-{name}")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return self.spark.read.parquet(str(self.root / name))


def test_throttle_keeps_its_state_between_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    feed.land(rows(spark, ("t", 1, 0.0, "running", 0, 100), ("t", 2, 0.4, "running", 50, 100)))
    out = lambda: sorted(r["done"] for r in feed.run(K.throttle_progress_stream(feed.stream())).collect())
    assert out() == [0]
    feed.land(rows(spark, ("t", 3, 0.9, "running", 55, 100), ("t", 4, 1.2, "running", 60, 100), ("t", 5, 1.5, "running", 100, 100)))
    assert out() == [0, 60, 100]


def test_transition_check_remembers_the_last_status(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    feed.land(rows(spark, ("t", 1, 0, "pending", 0, 1), ("t", 2, 1, "running", 0, 1)))
    feed.run(K.validate_transitions_stream(feed.stream()))
    feed.land(rows(spark, ("t", 3, 2, "running", 0, 1), ("t", 4, 3, "success", 1, 1), ("t", 5, 4, "running", 0, 1)))
    got = feed.run(K.validate_transitions_stream(feed.stream())).orderBy("event_id")
    assert [r["verdict"] for r in got.collect()] == ["start", "allowed", "same", "allowed", "rejected"]


def test_silent_tasks_are_recovered(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    for batch in (
        [("a", 1, 0, "running", 0, 1), ("b", 2, 0, "success", 1, 1), ("c", 3, 5, "running", 0, 1)],
        [("c", 4, 3000, "running", 0, 1)],
        [("d", 5, 9000, "pending", 0, 1)],
        [("d", 6, 9001, "pending", 0, 1)],
    ):
        feed.land(rows(spark, *batch))
        out = feed.run(K.recover_orphans_stream(feed.stream(), "1 hour", "1 minute"))
    got = {r["task_id"]: (r["status"], r["error_code"]) for r in out.collect()}
    assert got == {"a": ("failed", "INTERRUPTED"), "c": ("failed", "INTERRUPTED")}


def test_late_rows_are_dropped_from_closed_windows(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    for batch in ([("t", 1, 10, "running", 0, 1)], [("t", 2, 500, "running", 0, 1)], [("t", 3, 20, "running", 0, 1)], [("t", 4, 900, "running", 0, 1)]):
        feed.land(rows(spark, *batch))
        out = feed.run(K.windowed_counts(feed.stream(), "1 minute", "1 minute"))
    assert [r["n"] for r in out.orderBy("start").collect()] == [1, 1]


def test_event_feed_drops_noise(spark, tmp_path):
    good = {"event": "task", "event_id": 1, "task_id": "t", "status": "running"}
    lines = [": keep-alive", "data: " + json.dumps(good), '{"event":"task","task', json.dumps({**good, "task_id": "u"}), json.dumps({"event": "other", "task_id": "t"}), ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(r["task_id"] for r in K.task_event_stream(df).collect()) == ["t", "u"]
    assert [r["task_id"] for r in K.task_event_stream(df, "t").collect()] == ["t"]


def test_requests_repeat_after_their_time_to_live(spark, tmp_path):
    schema = "source_id string, method string, url string, requested_at timestamp"
    feed = Feed(spark, tmp_path, schema)
    for urls, sec in ((("https://a/x?b=1&a=2", "https://a/x?a=2&b=1&utm_x=1"), 0), (("https://a/other",), 4000), (("https://a/x?a=2&b=1",), 8000), (("https://a/last",), 20000)):
        feed.land(spark.createDataFrame([("s", "GET", u) for u in urls], "source_id string, method string, url string").withColumn("requested_at", F.timestamp_seconds(F.lit(10**6 + sec))))
        out = feed.run(I.dedup_requests(feed.stream()).select("url"))
    assert sorted(r["url"] for r in out.collect()).count("https://a/last") == 1
    assert sum("/x" in r["url"] for r in out.collect()) == 2


def test_requests_share_states_and_agree_with_the_rule(spark, tmp_path):
    import random

    draw, ttl, last, want = random.Random(3), 500, {}, []
    feed = Feed(spark, tmp_path, "source_id string, method string, url string, requested_at timestamp")
    for batch in range(3):
        asked = sorted((batch * 2000 + draw.randrange(2000), f"https://a/{draw.randrange(300)}") for _ in range(1500))
        for sec, url in asked:
            if url not in last or sec >= last[url] + ttl:
                last[url] = sec
                want.append((url, sec))
        df = spark.createDataFrame([("s", "GET", u, sec) for sec, u in asked] + [("s", "GET", "https://a/0", None)], "source_id string, method string, url string, sec long")
        feed.land(df.select("source_id", "method", "url", F.timestamp_seconds("sec").alias("requested_at")))
    out = I.dedup_requests(feed.stream(), ttl, "1 hour", buckets=8).select("url", F.unix_timestamp("requested_at").alias("sec"))
    run = (
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["url"], r["sec"]) for r in got) == sorted(want)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) == 8


LANDED = "book_id string, source_chapter_id string, title string, url string, index bigint, content string"


def _landing(spark, table, policy=OPEN, seen=None):
    step = I.intake_batch(table, policy, lambda bad, n: (seen if seen is not None else []).extend(r["reason"] for r in bad.collect()))

    def land(number, *items):
        df = spark.createDataFrame([("b", *x) for x in items], LANDED).withColumn("landed_at", F.timestamp_seconds(F.lit(number)))
        step(df, number)

    return land


def _files(table):
    import glob

    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/bucket=*/*.parquet")}


def test_intake_is_incremental_and_idempotent(spark, tmp_path):
    store, seen = I.ChapterTable(spark, str(tmp_path / "store"), 4), []
    land = _landing(spark, store, seen=seen)
    assert store.current() is None and store.last_batch() == -1
    land(0, ("1", "one", "https://a/1", 0, "text one"), ("2", "two", "https://a/2", 1, "  "))
    assert seen == ["empty"] and store.current().count() == 1
    land(1, ("1", "one", "https://a/1", 0, "text  one"))
    assert store.last_batch() == 0
    land(2, ("1", "uno", "https://a/1", 0, "text one"), ("2", "two", "https://a/2", 1, "text two"))
    got = {r["title"]: r for r in store.current().collect()}
    assert set(got) == {"uno", "two"} and got["uno"]["created_at"].timestamp() == 0 and got["uno"]["updated_at"].timestamp() == 2
    land(2, ("3", "again", "https://a/3", 2, "a replayed batch number is ignored"))
    assert store.current().count() == 2
    land(3, ("4", None, None, 3, "no title"), ("4", None, None, 3, "no title"))
    files = _files(store)
    land(4, ("4", None, None, 3, "no title"))
    assert store.current().count() == 3 and _files(store) == files and store.last_batch() == 3


def test_a_table_without_an_accepted_chapter_is_empty(spark, tmp_path):
    store, seen = I.ChapterTable(spark, str(tmp_path / "store"), 4), []
    land = _landing(spark, store, seen=seen)
    land(0, ("1", "one", "https://a/1", 0, " "))
    assert seen == ["empty"] and store.current().count() == 0 and store.last_batch() == -1
    land(1)
    land(2, *[(str(i), "t", f"https://a/{i}", i, f"text {i}") for i in range(20)])
    assert store.current().count() == 20 and store.last_batch() == 2


def test_only_changed_buckets_are_rewritten(spark, tmp_path):
    store = I.ChapterTable(spark, str(tmp_path / "store"), 16)
    land = _landing(spark, store)
    rows = [(str(i), f"t{i}", f"https://a/{i}", i, f"text {i}") for i in range(200)]
    land(0, *rows)
    before = _files(store)
    assert len(before) == 16
    land(1, *rows[:-2], *[(i, t, u, k, "changed") for i, t, u, k, _ in rows[-2:]])
    after = _files(store)
    changed = {r["bucket"] for r in store.current().filter("batch = 1").select("bucket").collect()}
    gone = {int(f.split("bucket=")[1].split("/")[0]) for f in before.keys() - after.keys()}
    assert gone == changed and 1 <= len(gone) <= 2 and len(after) == 16
    assert all(after[f] == before[f] for f in before.keys() & after.keys())
    assert store.current().count() == 200 and store.current().filter("content = 'changed'").count() == 2
    assert not os.path.exists(store.staged) and not os.path.exists(store.cleaned)


def test_a_run_that_stopped_half_way_is_finished(spark, tmp_path, monkeypatch):
    store = I.ChapterTable(spark, str(tmp_path / "store"), 4)
    land = _landing(spark, store)
    rows = [(str(i), f"t{i}", f"https://a/{i}", i, f"text {i}") for i in range(20)]
    land(0, *rows)
    newer = [(i, t, u, k, f"new {x}") for i, t, u, k, x in rows]
    with monkeypatch.context() as patch:
        patch.setattr(I.ChapterTable, "recover", lambda self: None)
        land(1, *newer)  # staged whole, never put in place
    import shutil

    shutil.rmtree(next(p for p in (tmp_path / "store" / "chapters-4").iterdir() if p.name.startswith("bucket=")))  # and one bucket lost on the way
    land(1, *newer)
    got = store.current()
    assert got.count() == 20 and got.filter("content LIKE 'new %'").count() == 20 and store.last_batch() == 1


def test_each_text_is_cleaned_once(spark, tmp_path):
    """The cleaning of a batch stands in one plan: the one that writes the cleaned batch."""
    store = I.ChapterTable(spark, str(tmp_path / "store"), 4)
    _landing(spark, store)(0, ("1", "one", "https://a/1", 0, "text one"))
    done = process_content(spark.createDataFrame([("b", "1", "one", "https://a/1", 0, "text two")], LANDED).withColumn("landed_at", F.timestamp_seconds(F.lit(1))), "content", OPEN)
    done.write.parquet(str(tmp_path / "cleaned"))
    good = I.identified(spark.read.parquet(str(tmp_path / "cleaned")), 1, 4)
    fresh = I.changed_only(store.current(), good)
    text = merge.upsert_chapters(store.current(), fresh)._jdf.queryExecution().executedPlan().toString()
    assert "inline" not in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_the_listing_of_the_stored_table_reads_no_bodies(spark, tmp_path):
    store = I.ChapterTable(spark, str(tmp_path / "store"), 4)
    _landing(spark, store)(0, ("1", "one", "https://a/1", 0, "text one"))
    listed = library.list_summaries(store.current())
    text = listed._jdf.queryExecution().executedPlan().toString()
    assert "content:string" not in text and "has_content:boolean" in text and listed.first()["has_content"]


def test_upsert_keeps_null_keys_and_columns_the_batch_lacks(spark):
    old = spark.createDataFrame([("i1", None, "k", "t", "x", 1), ("i2", "b", "k", "t", "y", 2)], "id string, book_id string, identity_key string, title string, note string, updated_at int")
    old = old.withColumn("created_at", F.lit(5))
    new = spark.createDataFrame([("n1", None, "k", "new", 3), ("n2", None, "k", "older", 2), ("n3", "c", "k", "more", 3)], "id string, book_id string, identity_key string, title string, updated_at int")
    new = new.withColumn("created_at", F.lit(9))
    got = {(r.id, r.book_id, r.title, r.note, r.created_at, r.merge_action) for r in merge.upsert_chapters(old, new).collect()}
    assert got == {("i1", None, "new", "x", 5, "update"), ("i2", "b", "t", "y", 5, "keep"), ("n3", "c", "more", None, 9, "insert")}


def test_metrics_come_from_the_same_run(spark):
    watch = Observation("intake")
    df = process_content(spark.createDataFrame([("正文内容" * 30,), ("短",)], "text string"))
    seen = I.observed(df, watch)
    assert seen.count() == 2
    assert {k: watch.get[k] for k in ("rows", "accepted", "rejected")} == {"rows": 2, "accepted": 1, "rejected": 1}


def test_control_events(spark):
    df = spark.createDataFrame([("pause", "running"), (None, "failed"), ("cancel", "running")], "action string, status string")
    assert [r["status"] for r in K.control_events(df).collect()] == ["paused", "failed", "cancelled"]


def test_hash_is_stable(one):
    assert one(content_hash(F.lit("a  b"))) == "0cc175b9c0f1b6a831c399e269772661" or len(one(content_hash(F.lit("a  b")))) == 32


def test_a_watch_of_one_task_ends(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    for batch in (
        [("t", 1, 0, "pending", 0, 1)], [("t", 2, 1, "running", 0, 1), ("t", 4, 3, "running", 1, 1), ("t", 3, 2, "success", 1, 1)], [("t", 5, 9, "running", 0, 1)],
    ):
        feed.land(rows(spark, *batch))
    seen = []
    assert K.watch_task(feed.stream(), lambda df, n: seen.extend(r["event_id"] for r in df.collect()), str(tmp_path / "watch"), available_now=True)
    assert sorted(seen) == [1, 2, 3]
    assert not any(q.isActive for q in spark.streams.active)


def test_a_watch_without_an_end_reads_all(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    feed.land(rows(spark, ("t", 1, 0, "pending", 0, 1), ("t", 2, 1, "running", 0, 1)))
    seen = []
    assert not K.watch_task(feed.stream(), lambda df, n: seen.extend(r["event_id"] for r in df.collect()), str(tmp_path / "watch"), available_now=True)
    assert sorted(seen) == [1, 2]


def _state(spark, feed, name="out"):
    return spark.read.format("statestore").load(str(feed.root / f"check-{name}"))


def test_equal_instants_across_batches(spark, tmp_path):
    """A smaller number at the same instant does not overwrite the later status, whichever batch it comes in."""
    feed = Feed(spark, tmp_path, EVENTS)
    for batch in (
        [("a", 5, 0, "success", 1, 1), ("b", 1, 0, "success", 1, 1)], [("a", 3, 0, "running", 0, 1), ("b", 2, 0, "running", 0, 1)],
        [("z", 9, 9000, "pending", 0, 1)], [("z", 10, 9001, "pending", 0, 1)],
    ):
        feed.land(rows(spark, *batch))
        out = feed.run(K.recover_orphans_stream(feed.stream(), "1 hour", "1 minute"))
    assert [r["task_id"] for r in out.collect()] == ["b"]


def test_state_of_thinned_tasks_ends(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    build = lambda: K.throttle_progress_stream(feed.stream(), 60.0, "1 minute")
    feed.land(rows(spark, *[(f"t{i}", i, i, "running", 0, 9) for i in range(20)]))
    feed.run(build())
    assert _state(spark, feed).count() == 20
    feed.land(rows(spark, ("late", 90, 5000, "running", 0, 9)))
    out = feed.run(build())
    assert [r["key"]["task_id"] for r in _state(spark, feed).collect()] == ["late"] and out.count() == 21
    feed.land(rows(spark, ("t3", 91, 5001, "running", 1, 9), ("t3", 92, 5002, "running", 2, 9)))
    assert {r["event_id"] for r in feed.run(build()).filter("task_id = 't3'").collect()} == {3, 91}


def test_state_of_checked_tasks_ends(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    build = lambda: K.validate_transitions_stream(feed.stream(), "1 minute", keep="2 hours", keep_ended="10 minutes")
    verdict = lambda n: feed.run(build()).filter(F.col("event_id") == n).first()["verdict"]
    feed.land(rows(spark, ("done", 1, 0, "success", 1, 1), ("open", 2, 0, "running", 0, 1)))
    assert verdict(1) == "start"
    feed.land(rows(spark, ("done", 3, 300, "running", 0, 1)))
    assert verdict(3) == "rejected"  # still remembered
    feed.land(rows(spark, ("x", 4, 4000, "success", 0, 1)))
    feed.run(build())
    assert {r["key"]["task_id"] for r in _state(spark, feed).collect()} == {"open", "x", "done"}  # done says running again
    feed.land(rows(spark, ("y", 5, 9000, "success", 0, 1)))
    feed.run(build())
    assert {r["key"]["task_id"] for r in _state(spark, feed).collect()} == {"y"}
    feed.land(rows(spark, ("open", 6, 9001, "success", 0, 1)))
    assert verdict(6) == "start"  # forgotten after two silent hours
