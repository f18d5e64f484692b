"""Queries over the book and chapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.text import content_hash
from pagemill.operators import keywords as KW
from pagemill.operators import library as L
from pagemill.operators import merge as M
from pagemill.operators import ordered as O
from pagemill.operators import signatures as SG
from pagemill.plans import sqltext as S
from pagemill.plans import views as W
from pagemill.plans.registry import Tables, query
from pagemill.session import written

CB = f"WITH ch AS ({W.CHAPTERS}), bk AS ({W.BOOKS})"


@query("scan_chapters", f"""{CB} SELECT id, "index", title, content, word_count FROM ch WHERE book_id = 'c7' ORDER BY "index" """)
def scan_chapters(t: Tables):  # noqa: ANN201
    return L.scan_chapters(W.chapters(t), "c7").select("id", "index", "title", "content", "word_count")


@query("scan_books", f"{CB} SELECT id, title FROM bk ORDER BY updated_at DESC, id LIMIT 20 OFFSET 10")
def scan_books(t: Tables):  # noqa: ANN201
    return L.scan_books(W.books(t), 20, 10).select("id", "title")


@query("point_lookup", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1")
def point_lookup(t: Tables):  # noqa: ANN201
    return L.point_lookup(t.conversations, conv_id=3, turn=1)


@query("lookup_many", """
  SELECT d.doc_id, d.source, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def lookup_many(t: Tables):  # noqa: ANN201
    return L.lookup_many(t.documents, t.labels.filter("quality = 1").select("doc_id")).select("doc_id", "source", "n_chars")


@query("recent_tasks", f"WITH e AS ({W.TASK_EVENTS}) SELECT event_id, task_id, status FROM e WHERE status = 'failed' ORDER BY micros DESC, event_id LIMIT 50")
def recent_tasks(t: Tables):  # noqa: ANN201
    return L.recent(W.task_events(t).filter("status = 'failed'"), "micros", 50, "event_id").select("event_id", "task_id", "status")


@query("list_summaries", f"""{CB} SELECT id, book_id, "index", title, word_count, length(content) > 0 AS has_content FROM ch""")
def list_summaries(t: Tables):  # noqa: ANN201
    return L.list_summaries(W.chapters(t))


#: A sequence of words that few chapters hold.
RARE = "ing and the"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("search_library", f"""{CB}, h AS (SELECT *, instr({_LOW.format('content')}, 'and the') AS pos FROM ch WHERE contains({_LOW.format('content')}, 'and the'))
  SELECT h.book_id, bk.title AS book_title, h.id AS chapter_id, h.title AS chapter_title, h."index" AS chapter_index,
         CASE WHEN pos > 31 THEN '…' ELSE '' END || trim(substring(content, greatest(pos - 30, 1), least(pos - 1 + 37, length(content)) - greatest(pos - 30, 1) + 1), chr(10) || ' ')
         || CASE WHEN pos + 36 < length(content) THEN '…' ELSE '' END AS snippet
  FROM h JOIN bk ON bk.id = h.book_id ORDER BY h.book_id, h."index" LIMIT 50""")
def search_library(t: Tables):  # noqa: ANN201
    return L.search_library(W.chapters(t), W.books(t), "And The", limit=50)


WORDS = ("with the", "Que", "100%", "para", "der", "not in the text at all")


@query("search_many", f"""{CB}, k AS (SELECT unnest([{', '.join(S.lit(w) for w in WORDS)}]) AS keyword)
  SELECT ch.book_id, ch.id, ch."index", k.keyword, length(ch.content) > 0 AS cut FROM ch JOIN k ON contains({_LOW.format('ch.content')}, {_LOW.format('k.keyword')})""")
def search_many(t: Tables):  # noqa: ANN201
    return L.search_many(W.chapters(t), list(WORDS)).withColumn("cut", F.length("snippet") > 0).drop("snippet")


@query("search_indexed", f"""{CB} SELECT book_id, id, "index", length(content) AS chars FROM ch WHERE contains({_LOW.format('content')}, '{RARE}')""")
def search_indexed(t: Tables):  # noqa: ANN201
    """Chapters stored in files by book, with trigram signatures beside them; the search opens the files that can hold the word."""
    spark = t._spark  # noqa: SLF001
    stored = written(W.chapters(t).repartition(16, "book_id"), "chapters")
    path = stored.inputFiles()[0].rsplit("/", 1)[0]
    signatures = written(SG.file_signatures(spark, path), "signatures")
    hits = SG.scan_indexed(spark, path, signatures, RARE)
    return hits.select("book_id", "id", "index", F.length("content").cast("long").alias("chars"))


@query("search_keywords", f"""{CB}, k AS (SELECT DISTINCT w AS keyword FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 3)
  SELECT ch.book_id, ch.id, ch."index", k.keyword, length(ch.content) > 0 AS cut FROM ch JOIN k ON contains({_LOW.format('ch.content')}, {_LOW.format('k.keyword')})""")
def search_keywords(t: Tables):  # noqa: ANN201
    """All words of the benchmark, a table that grows with it, in one pass over the bodies."""
    words = t.benchmark.select(F.explode(F.split("text", " ")).alias("keyword")).filter(F.length("keyword") >= 3)
    return KW.search_keywords(W.chapters(t), words).withColumn("cut", F.length("snippet") > 0).drop("snippet")


@query("cross_source_search", f"""
  WITH s AS (SELECT DISTINCT {S.host('url')} AS source_id FROM pages),
  u AS (SELECT source_id FROM s WHERE length(source_id) % 4 <> 0 AND length(source_id) % 5 <> 1 AND length(source_id) % 3 <> 2),
  h AS (SELECT {S.host('url')} AS source_id, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
  r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page_id) AS rn FROM h WHERE source_id IN (SELECT source_id FROM u))
  SELECT source_id, page_id, title FROM r WHERE rn <= 3""")
def cross_source_search(t: Tables):  # noqa: ANN201
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]+)", 1)
    hits = t.pages.select(host.alias("source_id"), "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return L.cross_source_search(hits, _sources(t), 3, order=("page_id",))


def _sources(t: Tables):  # noqa: ANN202
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]+)", 1)
    n = F.length("source_id")
    return t.pages.select(host.alias("source_id")).distinct().select(
        "source_id", (n % 4 != 0).alias("enabled"),
        F.when(n % 5 == 1, "broken").when(n % 5 == 2, "degraded").otherwise("healthy").alias("health"),
        F.when(n % 3 == 2, F.array(F.lit("book"))).otherwise(F.array(F.lit("search"), F.lit("book"))).alias("capabilities"),
    )


@query("missing_requested", f"""
  WITH s AS (SELECT DISTINCT {S.host('url')} AS source_id FROM pages)
  SELECT source_id FROM s WHERE length(source_id) % 4 = 0 OR length(source_id) % 5 = 1
  UNION ALL SELECT DISTINCT 'gone-' || source FROM documents""")
def missing_requested(t: Tables):  # noqa: ANN201
    asked = _sources(t).select("source_id").unionByName(t.documents.select(F.concat(F.lit("gone-"), "source").alias("source_id")).distinct())
    return L.missing_requested(asked, _sources(t))


@query("search_totals", """
  SELECT 'items' AS what, count(*) AS n FROM events WHERE event_type <> 'error' UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'""")
def search_totals(t: Tables):  # noqa: ANN201
    rows = t.events.select(
        F.col("user_id").cast("string").alias("source_id"), F.when(F.col("event_type") == "error", "NETWORK_ERROR").alias("code"),
        F.col("props").alias("message"),
    )
    return L.search_totals(rows.filter(F.col("code").isNull()), L.search_errors(rows))


@query("book_stats", """
  SELECT l_orderkey AS book_id, count(*) AS chapter_count, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS words FROM lineitem GROUP BY 1""")
def book_stats(t: Tables):  # noqa: ANN201
    """Order lines as chapters: the widest table, only two columns of it are read."""
    return L.book_stats(t.lineitem.select(F.col("l_orderkey").alias("book_id"), F.col("l_quantity").cast("long").alias("word_count")))


@query("refresh_book_stats", f"""{CB}, f AS (SELECT CASE WHEN "index" <> 0 THEN book_id ELSE 'none' END AS book_id, count(*) AS n, sum(word_count)::BIGINT AS w, arg_max(title, "index") AS last FROM ch GROUP BY 1)
  SELECT bk.id, coalesce(n, 0) AS chapter_count, coalesce(w, 0) AS word_count, coalesce(last, bk.latest_chapter) AS latest_chapter, 1704153600 AS updated
  FROM bk LEFT JOIN f ON f.book_id = bk.id""")
def refresh_book_stats(t: Tables):  # noqa: ANN201
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    chapters = W.chapters(t).withColumn("book_id", F.when(F.col("index") != 0, F.col("book_id")).otherwise("none"))  # some books lose all
    out = L.refresh_book_stats(W.books(t), chapters, now)
    return out.select("id", "chapter_count", "word_count", "latest_chapter", F.unix_timestamp("updated_at").cast("int").alias("updated"))


@query("count_books", "SELECT count(*) AS n FROM (SELECT DISTINCT conv_id FROM conversations)")
def count_books(t: Tables):  # noqa: ANN201
    return W.books(t).agg(F.count("*").alias("n"))


@query("corpus_acceptance", f"""{CB}, v AS (SELECT CASE WHEN book_id LIKE '%5' AND "index" = 1 THEN book_id || '-gap' ELSE book_id END AS book_id, CASE WHEN "index" = 2 THEN lower(title) ELSE url END AS url, "index", word_count, CASE WHEN "index" = 3 THEN '' ELSE content END AS content
           FROM ch)
  SELECT book_id, count(*) AS chapters, count(DISTINCT url) AS urls, max("index") - min("index") + 1 AS span, count(*) FILTER (WHERE coalesce(content, '') = '') AS empty_bodies,
         count(*) FILTER (WHERE word_count = 0) AS zero_words, max("index") - min("index") + 1 = count(*) AS continuous, count(DISTINCT url) = count(*) AS unique_urls
  FROM v GROUP BY book_id""")
def corpus_acceptance(t: Tables):  # noqa: ANN201
    gap = F.endswith("book_id", F.lit("5")) & (F.col("index") == 1)  # these chapters are a book of their own and leave a gap
    rows = W.chapters(t).withColumns(
        {"book_id": F.when(gap, F.concat("book_id", F.lit("-gap"))).otherwise(F.col("book_id")),
         "url": F.when(F.col("index") == 2, F.lower("title")).otherwise(F.col("url")),
         "content": F.when(F.col("index") == 3, "").otherwise(F.col("content"))}
    )
    return L.corpus_acceptance(rows)


@query("duplicate_content", f"""
  SELECT {S.content_hash('text')} AS content_hash, count(*) AS copies, min(doc_id) AS first_id, count(DISTINCT source) AS books
  FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_content(t: Tables):  # noqa: ANN201
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("book_id"), content_hash("text").alias("content_hash"))
    return L.duplicate_content(rows)


@query("top_n_per_source", """
  SELECT source_id, doc_id, n_chars FROM (SELECT source AS source_id, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 5""")
def top_n_per_source(t: Tables):  # noqa: ANN201
    rows = t.documents.select(F.col("source").alias("source_id"), "doc_id", "n_chars")
    return L.top_n_per_source(rows, 5, (F.desc("n_chars"), F.col("doc_id")))


@query("assign_index", """
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS "index", count(*) OVER (PARTITION BY source) - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS reversed FROM documents""")
def assign_index(t: Tables):  # noqa: ANN201
    up = O.assign_index(t.documents.select("doc_id", "source"), ["source"], ["doc_id"], None)
    return O.assign_index(up, ["source"], ["doc_id"], None, reverse=True, out="reversed")


# --- merges -------------------------------------------------------------------------------------------------------
def _now():  # noqa: ANN202
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


@query("upsert_books", f"""WITH bk AS ({W.BOOKS}), old AS (SELECT * FROM bk WHERE right(id, 1) <> '3'), new AS (SELECT * FROM bk WHERE right(id, 1) <> '4')
  SELECT coalesce(o.id, md5(n.source_id || chr(31) || n.source_book_id)) AS id, coalesce(o.source_id, n.source_id) AS source_id,
         CASE WHEN n.id IS NOT NULL THEN upper(n.title) ELSE o.title END AS title, CASE WHEN n.id IS NOT NULL THEN n.author ELSE o.author END AS author,
         CASE WHEN n.id IS NOT NULL THEN 'new' ELSE o.publisher END AS publisher, o.shelf AS shelf, CASE WHEN n.id IS NOT NULL THEN n.intro END AS tag,
         CASE WHEN o.id IS NULL THEN 1709251200 ELSE epoch(o.created_at)::BIGINT END AS created, CASE WHEN n.id IS NULL THEN epoch(o.updated_at)::BIGINT ELSE 1709251200 END AS updated,
         CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'keep' ELSE 'update' END AS merge_action
  FROM old o FULL OUTER JOIN new n ON n.source_id = o.source_id AND n.source_book_id = o.source_book_id""")
def upsert_books(t: Tables):  # noqa: ANN201
    books = W.books(t)
    drafts = books.filter(~F.endswith("id", F.lit("4"))).select(
        "source_id", "source_book_id", "url", F.upper("title").alias("title"), "author", "intro", "cover_url", "latest_chapter", "status",
        F.create_map(F.lit("publisher"), F.lit("new"), F.lit("tag"), F.col("intro")).alias("extra"),
    )
    out = M.upsert_books(books.filter(~F.endswith("id", F.lit("3"))), drafts, _now())
    return out.select(
        "id", "source_id", "title", "author", F.col("metadata")["publisher"].alias("publisher"), F.col("metadata")["shelf"].alias("shelf"),
        F.col("metadata")["tag"].alias("tag"), F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("updated_at").alias("updated"), "merge_action",
    )


_IDENT = f"""CASE WHEN source_chapter_id IS NOT NULL THEN 'sid:' || source_chapter_id ELSE 'url:' || {S.normalize_url('url')} END"""


@query("upsert_chapters", f"""WITH ch AS (SELECT *, {_IDENT} AS k FROM ({W.CHAPTERS})), old AS (SELECT * FROM ch WHERE "index" % 4 <> 3),
  new AS (SELECT book_id, k, 'new-' || id AS id, upper(title) || '!' AS title, content_hash, word_count FROM ch WHERE "index" % 4 <> 0)
  SELECT coalesce(o.id, n.id) AS id, coalesce(o.book_id, n.book_id) AS book_id, coalesce(o.k, n.k) AS identity_key, coalesce(n.title, o.title) AS title,
         coalesce(n.content_hash, o.content_hash) AS content_hash, coalesce(n.word_count, o.word_count) AS word_count,
         CASE WHEN o.id IS NULL THEN 20 ELSE 10 END AS created, CASE WHEN n.id IS NULL THEN 10 ELSE 21 END AS updated,
         CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'keep' ELSE 'update' END AS merge_action
  FROM old o FULL OUTER JOIN new n ON n.book_id = o.book_id AND n.k = o.k""")
def upsert_chapters(t: Tables):  # noqa: ANN201
    """Every incoming chapter arrives twice; the later copy wins, existing rows keep id and creation time."""
    at = lambda s: F.timestamp_seconds(F.lit(s))
    rows = W.chapters(t)
    old = rows.filter("`index` % 4 <> 3").withColumns({"created_at": at(10), "updated_at": at(10)})
    new = rows.filter("`index` % 4 <> 0").withColumns({"id": F.concat(F.lit("new-"), "id"), "created_at": at(20)})
    early = new.withColumns({"title": F.lower("title"), "updated_at": at(20)})
    late = new.withColumns({"title": F.concat(F.upper("title"), F.lit("!")), "updated_at": at(21)})
    out = M.upsert_chapters(old, early.unionByName(late))
    return out.select(
        "id", "book_id", "identity_key", "title", "content_hash", "word_count", F.unix_timestamp("created_at").cast("int").alias("created"),
        F.unix_timestamp("updated_at").cast("int").alias("updated"), "merge_action",
    )


@query("cascade_delete", f"""{CB}, gone AS (SELECT id FROM bk WHERE source_id = 's2')
  SELECT 'book' AS kind, id FROM bk WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'chapter', id FROM ch WHERE book_id NOT IN (SELECT id FROM gone)""")
def cascade_delete(t: Tables):  # noqa: ANN201
    doomed = W.books(t).filter("source_id = 's2'").select(F.col("id").alias("book_id"))
    books, chapters = M.cascade_delete(W.books(t), W.chapters(t), doomed)
    return books.select(F.lit("book").alias("kind"), "id").unionByName(chapters.select(F.lit("chapter").alias("kind"), "id"))


@query("deleted_counts", f"""{CB} SELECT bk.id AS book_id, count(ch.id) AS n FROM bk LEFT JOIN ch ON CASE WHEN ch."index" > 3 THEN ch.book_id ELSE 'none' END = bk.id WHERE bk.source_id = 's2' GROUP BY 1""")
def deleted_counts(t: Tables):  # noqa: ANN201
    doomed = W.books(t).filter("source_id = 's2'").select(F.col("id").alias("book_id"))
    chapters = W.chapters(t).withColumn("book_id", F.when(F.col("index") > 3, F.col("book_id")).otherwise("none"))
    return M.deleted_counts(chapters, doomed)


@query("validate_references", f"""WITH bk AS ({W.BOOKS}),
  i AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'export_book' WHEN 'view' THEN 'refresh_source' ELSE 'download_book' END AS type,
               CASE WHEN event_id % 3 = 0 THEN 'c' || user_id ELSE CASE WHEN event_id % 3 = 1 THEN '' END END AS book_id,
               CASE WHEN event_id % 4 <> 0 THEN 's' || user_id % 8 END AS source_id, CASE WHEN event_id % 5 <> 0 THEN 'u' ELSE '' END AS url FROM events)
  SELECT event_id, CASE WHEN type = 'refresh_source' THEN NULL WHEN type = 'export_book' AND coalesce(book_id, '') = '' THEN 'MISSING_BOOK_ID'
         WHEN coalesce(book_id, '') <> '' THEN CASE WHEN book_id IN (SELECT id FROM bk) THEN NULL ELSE 'BOOK_NOT_FOUND' END
         WHEN source_id IS NULL OR url = '' THEN 'MISSING_TARGET' WHEN source_id NOT IN (SELECT source_id FROM bk) THEN 'SOURCE_NOT_FOUND' END AS error FROM i""")
def validate_references(t: Tables):  # noqa: ANN201
    e, kind = F.col("event_id"), F.col("event_type")
    items = t.events.select(
        "event_id", F.when(kind == "click", "export_book").when(kind == "view", "refresh_source").otherwise("download_book").alias("type"),
        F.when(e % 3 == 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))).when(e % 3 == 1, "").alias("book_id"),
        F.when(e % 4 != 0, F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string"))).alias("source_id"),
        F.when(e % 5 != 0, "u").otherwise("").alias("url"),
    )
    return M.validate_references(items, W.books(t), W.books(t).select("source_id").distinct()).select("event_id", "error")


def _supplier_index(t: Tables):  # noqa: ANN202
    """Suppliers as an index of installed sources."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("src-"), k.cast("string")).alias("source_id"), F.col("s_name").alias("name"),
        F.concat(F.lit("1."), (k % 3).cast("string"), F.lit(".0")).alias("version"), F.lit(1).alias("spec_version"), F.lit("h").alias("homepage"),
        F.lit("l").alias("license"), F.array(F.lit("search")).alias("capabilities"), (k % 2 == 0).alias("enabled"),
        F.when(k % 7 == 0, "broken").otherwise("healthy").alias("health"), F.concat(F.lit("1."), (k % 3).cast("string"), F.lit(".0")).alias("installed_version"),
        F.when(k % 5 == 0, "0.9.0").alias("previous_version"), F.timestamp_seconds(F.lit(10)).alias("installed_at"), F.timestamp_seconds(F.lit(10)).alias("updated_at"), k.alias("k"),
    )


@query("sync_catalogue", """
  SELECT 'src-' || s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN '1.' || s_suppkey % 3 || '.0' ELSE '1.' || s_suppkey % 2 || '.0' END AS version,
         CASE WHEN s_suppkey % 10 = 4 THEN true ELSE s_suppkey % 2 = 0 END AS enabled, CASE WHEN s_suppkey % 10 = 4 THEN 'unknown' WHEN s_suppkey % 7 = 0 THEN 'broken' ELSE 'healthy' END AS health,
         CASE WHEN s_suppkey % 10 = 4 THEN 'insert' WHEN s_suppkey % 3 = 0 THEN 'delete' ELSE 'update' END AS sync_action
  FROM supplier WHERE NOT (s_suppkey % 10 = 4 AND s_suppkey % 3 = 0)""")
def sync_catalogue(t: Tables):  # noqa: ANN201
    rows = _supplier_index(t)
    found = rows.filter("k % 3 <> 0").withColumn("version", F.concat(F.lit("1."), (F.col("k") % 2).cast("string"), F.lit(".0")))
    out = M.sync_catalogue(rows.filter("k % 10 <> 4").drop("k"), found, _now())
    return out.select("source_id", "version", "enabled", "health", "sync_action")


@query("sync_versions", """
  SELECT 'src-' || s_suppkey AS source_id, '1.' || greatest(9, s_suppkey % 20) || '.0' AS version, 'update' AS sync_action FROM supplier""")
def sync_versions(t: Tables):  # noqa: ANN201
    """Each source is found in three versions: 1.9.0, another one, and a pre-release of that one."""
    rows = _supplier_index(t)
    minor = (F.col("k") % 20).cast("string")
    versions = F.array(F.lit("1.9.0"), F.concat(F.lit("1."), minor, F.lit(".0")), F.concat(F.lit("1."), minor, F.lit(".0-rc.2")))
    out = M.sync_catalogue(rows.drop("k"), rows.withColumn("version", F.explode(versions)), _now())
    return out.select("source_id", "version", "sync_action")


@query("install_source", """
  SELECT 'src-' || s_suppkey AS source_id, CASE WHEN s_suppkey % 10 = 4 THEN '1.' || s_suppkey % 2 || '.0' WHEN s_suppkey % 3 = 0 THEN '1.' || s_suppkey % 3 || '.0' ELSE '1.' || s_suppkey % 2 || '.0' END AS installed_version,
         CASE WHEN s_suppkey % 10 = 4 THEN NULL WHEN s_suppkey % 3 <> 0 AND s_suppkey % 3 <> s_suppkey % 2 THEN '1.' || s_suppkey % 3 || '.0' WHEN s_suppkey % 5 = 0 THEN '0.9.0' END AS previous_version
  FROM supplier WHERE NOT (s_suppkey % 10 = 4 AND s_suppkey % 3 = 0)""")
def install_source(t: Tables):  # noqa: ANN201
    rows = _supplier_index(t)
    new = rows.filter("k % 3 <> 0").withColumn("version", F.concat(F.lit("1."), (F.col("k") % 2).cast("string"), F.lit(".0")))
    return M.install_source(rows.filter("k % 10 <> 4").drop("k"), new, _now()).select("source_id", "installed_version", "previous_version")


@query("version_history", """
  SELECT source_id, version, previous_version FROM (SELECT 's' || o_custkey AS source_id, o_orderpriority AS version, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_version FROM orders)
  WHERE previous_version IS NULL OR previous_version <> version""")
def version_history(t: Tables):  # noqa: ANN201
    installs = t.orders.select(
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("source_id"), F.col("o_orderpriority").alias("version"),
        F.struct("o_orderdate", "o_orderkey").alias("installed_at"),
    )
    return M.version_history(installs).drop("installed_at")


@query("delete_sources", """
  SELECT 'src-' || s_suppkey AS source_id FROM supplier WHERE s_suppkey % 4 <> 0""")
def delete_sources(t: Tables):  # noqa: ANN201
    """Deletion requests by id; upper-case ids are not well formed and delete nothing."""
    rows = _supplier_index(t)
    doomed = rows.filter("k % 4 = 0").select("source_id").unionByName(rows.select(F.upper("source_id").alias("source_id")))
    return M.delete_sources(rows, doomed).select("source_id")
