"""Snapshot merges. Plain Parquet has no MERGE: each operator returns the next snapshot, to be written beside the old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.functions.urls import identity_key

BOOK_REFRESHED = ("url", "title", "author", "intro", "cover_url", "latest_chapter", "status")


def version_order(version: Column | str) -> Column:
    """A value that sorts like the version it stands for: by its numbers, a pre-release below its release, pre-releases by their
    parts with numbers below words. Trailing zeros and what follows a plus sign do not count; texts without a number come first."""
    text = F.col(version) if isinstance(version, str) else version
    digits = "decimal(38,0)"
    core = F.regexp_extract(text, r"^\s*[vV]?(\d+(?:\.\d+)*)", 1)
    rest = F.regexp_replace(F.regexp_replace(text, r"^\s*[vV]?\d+(?:\.\d+)*", ""), r"(?s)\+.*$", "")
    numbers = F.transform(F.split(F.regexp_replace(core, r"(?:\.0+)+$", ""), r"\."), lambda p: p.try_cast(digits))
    parts = F.transform(
        F.regexp_extract_all(rest, F.lit(r"\d+|[A-Za-z]+"), F.lit(0)),
        lambda p: F.struct(p.rlike("^[A-Za-z]").alias("word"), p.try_cast(digits).alias("number"), F.lower(p).alias("text")),
    )
    return F.when(core != "", F.struct(numbers.alias("numbers"), (F.size(parts) == 0).alias("final"), parts.alias("parts")))


def _latest(rows: DataFrame, keys: list[str], order: str | Column | None = None) -> DataFrame:
    """One row per key, the last by ``order``; combined map-side, so repeats of a hot key never travel. Rows that tie are
    told apart by a digest of their values, so that every run picks the same one."""
    rest = [c for c in rows.columns if c not in keys]
    digest = F.md5(F.to_json(F.struct(*rest)))
    place = digest if order is None else F.struct(F.col(order) if isinstance(order, str) else order, digest)
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_r"))
    return picked.select(*keys, "_r.*")


def upsert_books(books: DataFrame, drafts: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """Match on (source_id, source_book_id): refresh seven fields, keep id and creation time, merge metadata. Repeated drafts
    of a book collapse to one, the last by ``order`` if there is such a column."""
    keys = ["source_id", "source_book_id"]
    drafts = _latest(drafts.select(*keys, *BOOK_REFRESHED, "extra", *([order] if order else [])), keys, order)
    fresh = drafts.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in BOOK_REFRESHED], F.col("extra").alias("_extra"), F.lit(True).alias("_hit")
    )
    joined = books.withColumn("_old", F.lit(True)).join(fresh, keys, "full_outer")
    hit, known = F.col("_hit").isNotNull(), F.col("_old").isNotNull()
    new_id = F.md5(F.concat_ws("\x1f", *keys))
    empty = F.create_map().cast("map<string,string>")
    cols = {
        "id": F.coalesce("id", new_id),
        **{c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in BOOK_REFRESHED},
        "metadata": F.map_concat(F.coalesce("metadata", empty), F.coalesce("_extra", empty)),
        "created_at": F.when(known, F.col("created_at")).otherwise(now),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        "merge_action": F.when(~known, "insert").when(hit, "update").otherwise("keep"),
    }
    return joined.withColumns(cols).drop("_old", "_hit", "_extra", *[f"_new_{c}" for c in BOOK_REFRESHED])


def _winners(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``, ties by a hash of the row. Rows with bodies are neither aggregated nor made into
    text: each task keeps its own best row per key before anything is shuffled."""
    digest = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])
    place = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), digest)
    return rows.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")


def upsert_chapters(chapters: DataFrame, incoming: DataFrame, order: str = "updated_at") -> DataFrame:
    """Match on (book_id, identity_key): repeats in the batch collapse to the latest, an existing row keeps its id and
    creation time. Null keys match null keys. One snapshot, one write, one commit.

    What is known of existing rows is joined from narrow columns; bodies of rows that stay are only read and passed on, past
    the keys that came in, so they never wait in a sort beside the new ones. Keys of ``incoming`` are read once more for that.
    """
    keys = ["book_id", "identity_key"]
    key = identity_key("source_chapter_id", "url", "index", "title")
    old = chapters if "identity_key" in chapters.columns else chapters.withColumn("identity_key", key)
    new = incoming if "identity_key" in incoming.columns else incoming.withColumn("identity_key", key)
    new = new.select(*[c for c in old.columns if c in new.columns])
    kept = ("id", "created_at")
    carried = [c for c in old.columns if c not in keys and (c in kept or c not in new.columns)]
    known = old.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[F.col(c).alias(f"_old_{c}") for c in carried], F.lit(True).alias("_hit"))
    met = _winners(new, keys, order).join(known, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys], "left")

    def value(c: str) -> Column:
        before, now = [F.col(f"_old_{c}")] if c in carried else [], [F.col(c)] if c in new.columns else []
        return F.coalesce(*before, *now).alias(c)

    action = F.when(F.col("_hit").isNull(), "insert").otherwise("update").alias("merge_action")
    came = new.select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    stay = old.join(came, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys], "left_anti").withColumn("merge_action", F.lit("keep"))
    return stay.unionByName(met.select(*[value(c) for c in old.columns], action))


SOURCE_DEFINITION = ("name", "version", "spec_version", "homepage", "license", "capabilities")


def sync_catalogue(index: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Definitions found on storage against the index: insert, update (switches and health stay), delete.
    A source found several times counts once, with its greatest version by number."""
    found = _latest(found.select("source_id", *SOURCE_DEFINITION), ["source_id"], version_order("version"))
    fresh = found.select("source_id", *[F.col(c).alias(f"_new_{c}") for c in SOURCE_DEFINITION], F.lit(True).alias("_hit"))
    joined = index.withColumn("_old", F.lit(True)).join(fresh, "source_id", "full_outer")
    hit, known = F.col("_hit").isNotNull(), F.col("_old").isNotNull()
    cols = {
        **{c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in SOURCE_DEFINITION},
        "enabled": F.coalesce("enabled", F.lit(True)),
        "health": F.coalesce("health", F.lit("unknown")),
        "installed_version": F.when(hit, F.col("_new_version")).otherwise(F.col("installed_version")),
        "installed_at": F.coalesce("installed_at", now),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        "sync_action": F.when(~hit, "delete").when(known, "update").otherwise("insert"),
    }
    return joined.withColumns(cols).drop("_old", "_hit", *[f"_new_{c}" for c in SOURCE_DEFINITION])


def install_source(index: DataFrame, installs: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """Install or overwrite: the previous version moves only when the version really changed. Repeated installs of a source
    collapse to one, the last by ``order`` if there is such a column."""
    installs = _latest(installs.select("source_id", *SOURCE_DEFINITION, *([order] if order else [])), ["source_id"], order)
    fresh = installs.select("source_id", *[F.col(c).alias(f"_new_{c}") for c in SOURCE_DEFINITION], F.lit(True).alias("_hit"))
    joined = index.withColumn("_old", F.lit(True)).join(fresh, "source_id", "full_outer")
    hit, known = F.col("_hit").isNotNull(), F.col("_old").isNotNull()
    moved = hit & known & (F.col("installed_version") != F.col("_new_version"))
    cols = {
        "previous_version": F.when(moved, F.col("installed_version")).otherwise(F.col("previous_version")),
        "installed_version": F.when(hit, F.col("_new_version")).otherwise(F.col("installed_version")),
        **{c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in SOURCE_DEFINITION},
        "enabled": F.coalesce("enabled", F.lit(True)),
        "health": F.coalesce("health", F.lit("unknown")),
        "installed_at": F.coalesce("installed_at", now),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return joined.withColumns(cols).drop("_old", "_hit", *[f"_new_{c}" for c in SOURCE_DEFINITION])


def version_history(installs: DataFrame, order: str = "installed_at") -> DataFrame:
    """Installs that changed the version, with the version they replaced. A source has few installs by nature."""
    from pyspark.sql import Window

    by_source = Window.partitionBy("source_id").orderBy(order)
    before = installs.withColumn("previous_version", F.lag("version").over(by_source))
    return before.filter(F.col("previous_version").isNull() | (F.col("previous_version") != F.col("version")))


def cascade_delete(books: DataFrame, chapters: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books and chapters without the books in ``doomed`` (column ``book_id``)."""
    gone = doomed.select("book_id").distinct()
    return (
        books.join(gone.withColumnRenamed("book_id", "id"), "id", "left_anti"),
        chapters.join(gone, "book_id", "left_anti"),
    )


def deleted_counts(chapters: DataFrame, doomed: DataFrame) -> DataFrame:
    """Chapters that go with each book of ``doomed``; zero for books without any."""
    counts = chapters.groupBy("book_id").agg(F.count("*").alias("n"))
    return doomed.select("book_id").distinct().join(counts, "book_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def delete_sources(sources: DataFrame, doomed: DataFrame) -> DataFrame:
    """Only well-formed ids delete anything."""
    valid = doomed.filter(F.col("source_id").rlike(fixed.SOURCE_ID_PATTERN)).select("source_id").distinct()
    return sources.join(valid, "source_id", "left_anti")


TASK_ERRORS = ("MISSING_BOOK_ID", "MISSING_TARGET", "BOOK_NOT_FOUND", "SOURCE_NOT_FOUND")


def validate_references(items: DataFrame, books: DataFrame, sources: DataFrame) -> DataFrame:
    """Work items (type, book_id, source_id, url) with an ``error`` code when what they refer to is not there."""
    known_books = books.select(F.col("id").alias("book_id"), F.lit(True).alias("_book"))
    known_sources = sources.select("source_id", F.lit(True).alias("_source"))
    joined = items.join(known_books, "book_id", "left").join(known_sources, "source_id", "left")
    has_book = F.coalesce(F.col("book_id").cast("string"), F.lit("")) != ""
    has_target = (F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    error = (
        F.when(F.col("type") == "refresh_source", F.lit(None))
        .when((F.col("type") == "export_book") & ~has_book, "MISSING_BOOK_ID")
        .when(has_book & F.col("_book").isNull(), "BOOK_NOT_FOUND")
        .when(has_book, F.lit(None))
        .when(~has_target, "MISSING_TARGET")
        .when(F.col("_source").isNull(), "SOURCE_NOT_FOUND")
    )
    return joined.withColumn("error", error).drop("_book", "_source")
