"""Catalogue diffs: which chapters are new, changed, unchanged or missing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.urls import candidate_keys, identity_key, normalize_url
from pagemill.session import cut_lineage

WHOLE = 100_000
_KEYS = ("source_chapter_id", "url", "index", "title")


def _keyed(rows: DataFrame, order: str) -> DataFrame:
    keys = candidate_keys(*_KEYS)
    return rows.select("book_id", F.col(order).alias("_order"), F.posexplode(keys).alias("_prio", "_key"))


def _proposals(local: DataFrame, remote: DataFrame, local_order: str, remote_order: str) -> DataFrame:
    """(book, remote, priority, local): a key stands for the first local chapter that has it."""
    holders = _keyed(local, local_order).groupBy("book_id", "_key").agg(F.min("_order").alias("l"))
    wants = _keyed(remote, remote_order).withColumnRenamed("_order", "r")
    return wants.join(holders, ["book_id", "_key"]).select("book_id", "r", "_prio", "l")


def _choices(pairs: DataFrame) -> DataFrame:
    """One row per remote with its candidates by priority; a remote has at most two, so the array is tiny."""
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("_prio", "l"))), lambda p: p["l"])
    return pairs.groupBy("book_id", "r").agg(F.array_distinct(ranked).alias("choices")).withColumn("at", F.lit(1))


def _pick_in_order(book: pd.DataFrame) -> pd.DataFrame:
    """Every remote of one book takes its first candidate that is still free."""
    free_of: dict = {}
    for r, choices in sorted(zip(book["r"], book["choices"], strict=True), key=lambda p: p[0]):
        pick = next((c for c in choices if c not in free_of), None)
        if pick is not None:
            free_of[pick] = r
    return pd.DataFrame({"book_id": book["book_id"].iloc[0], "r": list(free_of.values()), "l": list(free_of)}, columns=["book_id", "r", "l"])


def match_chapters(
    local: DataFrame, remote: DataFrame, local_order: str = "index", remote_order: str = "index", whole: int = WHOLE
) -> DataFrame:
    """One-to-one matches (book_id, r, l), as if remote rows picked in order.

    Remotes propose to their best candidate, a local keeps the earliest proposer, rejected remotes propose to their
    next candidate, until nobody is rejected. Books where every proposal was kept at once are finished in the first
    round. A book with a conflict and at most ``whole`` proposing chapters is then settled in remote order in one task;
    only larger ones go through further rounds, which may be as many as the longest chain of rejections. Each round is a
    checkpoint, so a lost executor never restarts the loop.
    """
    state = cut_lineage(_choices(_proposals(local, remote, local_order, remote_order)))
    order = state.schema["choices"].dataType.elementType
    done = None
    while True:
        proposal = state.withColumn("l", F.try_element_at("choices", F.col("at")))
        kept = proposal.filter(F.col("l").isNotNull()).groupBy("book_id", "l").agg(F.min("r").alias("winner"))
        judged = (
            proposal.join(kept, ["book_id", "l"], "left")
            .withColumn("lost", F.col("l").isNotNull() & (F.col("r") != F.col("winner")))
            .select("book_id", "r", "choices", "at", "l", "lost")
        )
        judged = cut_lineage(judged)
        restless = judged.filter("lost").select("book_id").distinct()
        settled = judged.join(restless, "book_id", "left_anti").filter(F.col("l").isNotNull()).select("book_id", "r", "l")
        done = settled if done is None else done.unionByName(settled)
        rest = judged.join(restless, "book_id", "left_semi").select(
            "book_id", "r", "choices", (F.col("at") + F.col("lost").cast("int")).alias("at")
        )
        if judged.filter("lost").isEmpty():
            return done
        bounded = rest.groupBy("book_id").agg(F.count("*").alias("n")).filter(F.col("n") <= whole).select("book_id")
        schema = T.StructType([state.schema["book_id"], state.schema["r"], T.StructField("l", order)])
        small = rest.join(bounded, "book_id", "left_semi").select("book_id", "r", "choices")
        done = done.unionByName(small.groupBy("book_id").applyInPandas(_pick_in_order, schema))
        state = rest.join(bounded, "book_id", "left_anti")
        if state.isEmpty():
            return done


def chapter_diff(
    local: DataFrame, remote: DataFrame, local_order: str = "index", remote_order: str = "index"
) -> DataFrame:
    """One row per chapter of either side with ``change_kind``; missing chapters are reported, not removed.

    Both sides: book_id, source_chapter_id, url, index, title; the order columns are unique within a book.
    """
    matches = match_chapters(local, remote, local_order, remote_order)
    old = local.select(
        "book_id", F.col(local_order).alias("l"), F.col("title").alias("old_title"), F.col("url").alias("old_url"),
        identity_key(*_KEYS).alias("old_key"),
    )
    new = remote.select("book_id", F.col(remote_order).alias("r"), *_KEYS)
    linked = new.join(matches, ["book_id", "r"], "left").join(old, ["book_id", "l"], "full_outer")
    differs = ~(F.col("old_title").eqNullSafe(F.col("title"))) | ~(
        normalize_url("old_url").eqNullSafe(normalize_url("url"))
    )
    kind = (
        F.when(F.col("r").isNull(), "missing")
        .when(F.col("old_key").isNull(), "new")
        .when(differs, "changed")
        .otherwise("unchanged")
    )
    return linked.withColumn("change_kind", kind).withColumnsRenamed({"r": "remote_order", "l": "local_order"})


def to_download(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("change_kind").isin("new", "changed"))


def plan_update(diff: DataFrame, order: str = "remote_order") -> DataFrame:
    """Counts per book and the title of its last remote chapter; the rows to fetch are ``to_download``."""
    kind = F.col("change_kind")
    return diff.groupBy("book_id").agg(
        F.count_if(kind != "missing").alias("total"),
        F.count_if(kind.isin("new", "changed")).alias("to_download"),
        F.count_if(kind == "unchanged").alias("skipped"),
        F.count_if(kind == "missing").alias("missing"),
        F.max_by("title", order).alias("latest_chapter"),
        (F.count_if(kind.isin("new", "changed")) == 0).alias("is_noop"),
    )


def list_identities(chapters: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    return chapters.select("book_id", identity_key(*_KEYS).alias("identity_key"), F.col(content_hash).alias("content_hash"))


def deep_diff(local: DataFrame, fetched: DataFrame) -> DataFrame:
    """Content-level diff of two identity lists."""
    joined = local.withColumnRenamed("content_hash", "old_hash").join(
        fetched.withColumnRenamed("content_hash", "new_hash"), ["book_id", "identity_key"], "full_outer"
    )
    return joined.withColumn("change_kind", _hash_change())


def _hash_change() -> Column:
    old, new = F.col("old_hash"), F.col("new_hash")
    return F.when(old.isNull(), "new").when(new.isNull(), "missing").when(old == new, "unchanged").otherwise("changed")
