"""Queries over the book and chapter tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import contains_keyword, fold_ascii_case, make_snippet
from pagemill.sizes import join_small


# --- scans --------------------------------------------------------------------------------------------------------
def scan_chapters(chapters: DataFrame, book_id, book: str = "book_id", index: str = "index") -> DataFrame:  # noqa: ANN001
    return chapters.filter(F.col(book) == F.lit(book_id)).orderBy(index)


def scan_books(books: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; the id breaks ties so that pages do not overlap."""
    return books.orderBy(F.desc("updated_at"), F.asc("id")).offset(offset).limit(limit)


def point_lookup(table: DataFrame, **keys) -> DataFrame:  # noqa: ANN003
    """Equality on stored columns; each condition reaches the Parquet scan."""
    for name, value in keys.items():
        table = table.filter(F.col(name) == F.lit(value))
    return table


def lookup_many(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Batch form: rows whose key columns occur in ``keys``."""
    return join_small(table, keys.distinct(), keys.columns, "left_semi")


def recent(table: DataFrame, order: str, limit: int, tie: str) -> DataFrame:
    return table.orderBy(F.desc(order), F.asc(tie)).limit(limit)


def list_summaries(chapters: DataFrame, content: str = "content") -> DataFrame:
    """Narrow rows without bodies. ``has_content`` is taken from the stored column when there is one."""
    present = (
        F.col("has_content")
        if "has_content" in chapters.columns
        else F.coalesce(F.length(content) > 0, F.lit(False))
    )
    return chapters.select("id", "book_id", "index", "title", "word_count", present.alias("has_content"))


# --- search -------------------------------------------------------------------------------------------------------
def search_library(
    chapters: DataFrame, books: DataFrame, keyword: str, book_id=None, limit: int = 50, content: str = "content"  # noqa: ANN001
) -> DataFrame:
    """Literal substring search with snippets. The body is cut to its snippet in the scan, so the join and the top-k
    only carry narrow rows, and only the hits that survive the limit carry anything to the driver."""
    hits = chapters if book_id is None else chapters.filter(F.col("book_id") == F.lit(book_id))
    hits = hits.filter(contains_keyword(content, keyword)).select(
        "book_id", "id", "index", "title", make_snippet(content, keyword).alias("snippet")
    )
    named = join_small(hits, books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title")), "book_id")
    return (
        named.orderBy("book_id", "index")
        .limit(limit)
        .select(
            "book_id", "book_title", F.col("id").alias("chapter_id"), F.col("title").alias("chapter_title"),
            F.col("index").alias("chapter_index"), "snippet",
        )
    )


def search_many(chapters: DataFrame, keywords: list[str], content: str = "content") -> DataFrame:
    """Many keywords in one pass over the bodies: the list is part of the expression, a row yields its matching words."""
    words = [k for k in dict.fromkeys(keywords) if k]
    if not words:
        return chapters.select("book_id", "id", "index", F.lit("").alias("keyword"), F.lit("").alias("snippet")).limit(0)
    found = F.filter(
        F.array(*[F.lit(k) for k in words]),
        lambda k: F.contains(fold_ascii_case(F.col("_body")), fold_ascii_case(k)),
    )
    return (
        chapters.withColumn("_body", F.col(content))
        .select("book_id", "id", "index", "_body", F.explode(found).alias("keyword"))
        .withColumn("snippet", make_snippet("_body", F.col("keyword")))
        .drop("_body")
    )


def cross_source_search(
    hits: DataFrame, sources: DataFrame, limit: int = 20, wanted: list[str] | None = None, order: tuple[str, ...] = ("rank",)
) -> DataFrame:
    """Hits of the usable, search-capable sources, at most ``limit`` per source."""
    usable = sources.filter(is_usable() & supports("search"))
    if wanted:
        usable = usable.filter(F.col("source_id").isin(*wanted))
    return top_n_per_source(join_small(hits, usable.select("source_id"), "source_id", "left_semi"), limit, order)


def top_n_per_source(hits: DataFrame, limit: int, order: tuple[str, ...]) -> DataFrame:
    """Rank limit per source. The planner cuts each map task to ``limit`` rows per source before the shuffle, so a
    source that holds most rows sends ``limit`` rows per task."""
    from pyspark.sql import Window

    ranked = hits.withColumn("_rn", F.row_number().over(Window.partitionBy("source_id").orderBy(*order)))
    return ranked.filter(F.col("_rn") <= limit).drop("_rn")


def search_errors(attempts: DataFrame) -> DataFrame:
    return attempts.filter(F.col("code").isNotNull()).select("source_id", "code", "message")


def search_totals(hits: DataFrame, errors: DataFrame) -> DataFrame:
    counted = hits.agg(F.count("*").alias("n")).withColumn("what", F.lit("items"))
    return counted.unionByName(errors.agg(F.count("*").alias("n")).withColumn("what", F.lit("errors")))


# --- sources ------------------------------------------------------------------------------------------------------
def is_usable() -> Column:
    """Enabled and neither broken nor unsupported; degraded sources stay usable."""
    return F.col("enabled") & ~F.col("health").isin("broken", "unsupported")


def supports(capability: str) -> Column:
    return F.array_contains("capabilities", F.lit(capability))


def missing_requested(requested: DataFrame, sources: DataFrame) -> DataFrame:
    return requested.join(sources.filter(is_usable()).select("source_id"), "source_id", "left_anti")


# --- aggregates ---------------------------------------------------------------------------------------------------
def book_stats(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    return chapters.groupBy(book).agg(
        F.count("*").alias("chapter_count"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words")
    )


def refresh_book_stats(books: DataFrame, chapters: DataFrame, now: Column) -> DataFrame:
    """Counts, words and last title written back; books without chapters get zeros and keep their title."""
    fresh = chapters.groupBy(F.col("book_id").alias("id")).agg(
        F.count("*").alias("_n"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("_w"),
        F.max_by("title", "index").alias("_last"),
    )
    return books.join(fresh, "id", "left").select(
        *[c for c in books.columns if c not in ("chapter_count", "word_count", "latest_chapter", "updated_at")],
        F.coalesce("_n", F.lit(0)).alias("chapter_count"),
        F.coalesce("_w", F.lit(0)).alias("word_count"),
        F.coalesce("_last", "latest_chapter").alias("latest_chapter"),
        now.alias("updated_at"),
    )


def corpus_acceptance(chapters: DataFrame, content: str = "content", approximate: bool = False) -> DataFrame:
    """Per book: rows, distinct links, gaps in the index, empty bodies, zero counts.

    Distinct links are counted in two steps by (book, link), so the chapters of a hot book are spread by their links.
    """
    empty = F.coalesce(F.length(content) == 0, F.lit(True))
    distinct = F.approx_count_distinct("url") if approximate else F.count_distinct("url")
    return (
        chapters.select("book_id", "url", "index", "word_count", empty.alias("_empty"))
        .groupBy("book_id")
        .agg(
            F.count("*").alias("chapters"),
            distinct.alias("urls"),
            (F.max("index") - F.min("index") + 1).alias("span"),
            F.count_if("_empty").alias("empty_bodies"),
            F.count_if(F.col("word_count") == 0).alias("zero_words"),
        )
        .withColumn("continuous", F.col("span") == F.col("chapters"))
        .withColumn("unique_urls", F.col("urls") == F.col("chapters"))
    )


def duplicate_content(chapters: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """Groups of equal content: size and first member; members are never gathered in one row."""
    return (
        chapters.groupBy(content_hash)
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.count_distinct("book_id").alias("books"))
        .filter(F.col("copies") > 1)
    )
