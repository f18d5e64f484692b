"""Library tables seen in the given ones: conversations as books with chapters, pages as responses, events as tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import content_hash, count_words
from pagemill.plans import sqltext as S

def chapters(t) -> DataFrame:  # noqa: ANN001
    """Turns as chapters of their conversation."""
    book = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    return t.conversations.select(
        F.concat(book, F.lit("-"), F.col("turn").cast("string")).alias("id"),
        book.alias("book_id"),
        F.when(F.col("conv_id") % 3 != 0, F.concat(book, F.lit("."), F.col("turn").cast("string"))).alias("source_chapter_id"),
        F.concat(F.col("role"), F.lit(" "), F.col("turn").cast("string")).alias("title"),
        F.concat(F.lit("https://Books.example.com/"), book, F.lit("/"), F.col("turn").cast("string"), F.lit("?utm_source=x")).alias("url"),
        F.col("turn").cast("long").alias("index"),
        F.col("text").alias("content"),
        count_words("text").cast("long").alias("word_count"),
        content_hash("text").alias("content_hash"),
    )


CHAPTERS = f"""SELECT 'c' || conv_id || '-' || turn AS id, 'c' || conv_id AS book_id,
    CASE WHEN conv_id % 3 <> 0 THEN 'c' || conv_id || '.' || turn END AS source_chapter_id, role || ' ' || turn AS title,
    'https://Books.example.com/c' || conv_id || '/' || turn || '?utm_source=x' AS url, turn AS "index", text AS content,
    {S.words('text')} AS word_count, {S.content_hash('text')} AS content_hash FROM conversations"""


def books(t) -> DataFrame:  # noqa: ANN001
    """One book per conversation."""
    k = F.col("conv_id")
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last")).select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"),
        F.concat(F.lit("s"), (k % 5).cast("string")).alias("source_id"),
        F.concat(F.lit("b"), k.cast("string")).alias("source_book_id"),
        F.concat(F.lit("Book <"), k.cast("string"), F.lit("> & more")).alias("title"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "").otherwise(F.concat(F.lit("Author "), (k % 7).cast("string"))).alias("author"),
        F.when(k % 2 == 0, F.concat(F.lit("Intro of "), k.cast("string"))).alias("intro"),
        F.when(k % 4 == 0, "en").alias("language"),
        F.element_at(F.array(F.lit("unknown"), F.lit("ongoing"), F.lit("completed")), ((k % 3) + 1).cast("int")).alias("status"),
        F.concat(F.lit("turn "), F.col("last").cast("string")).alias("latest_chapter"),
        F.concat(F.lit("https://books.example.com/c"), k.cast("string")).alias("url"),
        F.concat(F.lit("https://img.example.com/c"), k.cast("string"), F.lit(".jpg")).alias("cover_url"),
        F.create_map(F.lit("publisher"), F.concat(F.lit("P"), (k % 2).cast("string")), F.lit("shelf"), (k % 9).cast("string")).alias("metadata"),
        F.timestamp_seconds(F.lit(1704067200) + k * 60).alias("created_at"),
        F.timestamp_seconds(F.lit(1704067200) + (k % 50) * 3600).alias("updated_at"),
    )


BOOKS = """SELECT 'c' || conv_id AS id, 's' || conv_id % 5 AS source_id, 'b' || conv_id AS source_book_id,
    'Book <' || conv_id || '> & more' AS title,
    CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Author ' || conv_id % 7 END AS author,
    CASE WHEN conv_id % 2 = 0 THEN 'Intro of ' || conv_id END AS intro, CASE WHEN conv_id % 4 = 0 THEN 'en' END AS language,
    ['unknown', 'ongoing', 'completed'][(conv_id % 3) + 1] AS status, 'turn ' || max(turn) AS latest_chapter,
    'https://books.example.com/c' || conv_id AS url, 'https://img.example.com/c' || conv_id || '.jpg' AS cover_url,
    'P' || conv_id % 2 AS publisher, (conv_id % 9)::VARCHAR AS shelf,
    to_timestamp(1704067200 + conv_id * 60)::TIMESTAMP AS created_at,
    to_timestamp(1704067200 + (conv_id % 50) * 3600)::TIMESTAMP AS updated_at
  FROM conversations GROUP BY conv_id"""


def task_events(t) -> DataFrame:  # noqa: ANN001
    """Events as status records of tasks (user_id); the kind of the event gives the status."""
    status = F.create_map(*[F.lit(x) for p in STATUS.items() for x in p])
    return t.events.select(
        F.col("user_id").cast("string").alias("task_id"), "event_id", F.try_element_at(status, F.col("event_type")).alias("status"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("ts").cast("timestamp").alias("at"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), "value",
    )


STATUS = {"signup": "pending", "click": "running", "view": "paused", "error": "failed", "purchase": "success"}
_CASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS.items())
TASK_EVENTS = f"""SELECT user_id::VARCHAR AS task_id, event_id, CASE event_type {_CASE} END AS status, epoch_us(ts) AS micros,
    json_extract_string(props, '$.k')::BIGINT AS k, value FROM events"""


def cache(t) -> DataFrame:  # noqa: ANN001
    """Pages as cached responses; access times repeat, so that ties matter."""
    p = F.col("page_id")
    return t.pages.select(
        F.md5("url").alias("key"), F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]+)", 1).alias("source_id"), "url",
        F.length("html").cast("long").alias("size_bytes"),
        F.timestamp_seconds(F.lit(1704067200) + (p % 40) * 600).alias("created_at"),
        F.timestamp_seconds(F.lit(1704067200) + (p % 40) * 600 + F.when(p % 3 == 0, 604800).otherwise(1800)).alias("expires_at"),
        F.timestamp_seconds(F.lit(1704067200) + (p * 7919 % 13) * 900).alias("accessed_at"),
        F.when(p % 11 == 0, 404).otherwise(200).alias("status_code"), "page_id",
    )


CACHE = """SELECT md5(url) AS key, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS source_id, url, length(html) AS size_bytes,
    1704067200 + (page_id % 40) * 600 AS created, 1704067200 + (page_id % 40) * 600 + CASE WHEN page_id % 3 = 0 THEN 604800 ELSE 1800 END AS expires,
    1704067200 + (page_id * 7919 % 13) * 900 AS accessed, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status_code, page_id FROM pages"""
