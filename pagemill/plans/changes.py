"""Catalogue diffs between two snapshots derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.text import content_hash
from pagemill.operators import diff as D
from pagemill.plans import sqltext as S
from pagemill.plans.registry import Tables, query


def _snapshots(t: Tables):  # noqa: ANN202
    """Documents as chapters of their source; the remote side drops, renames, re-identifies, moves and adds some."""
    k = F.col("doc_id")
    local = t.documents.select(
        F.col("source").alias("book_id"), k.alias("index"), F.when(k % 10 != 5, F.concat(F.lit("d"), k.cast("string"))).alias("source_chapter_id"),
        F.concat(F.lit("https://x.example.com/"), k.cast("string"), F.lit("?ref=a")).alias("url"), F.concat(F.lit("T "), k.cast("string")).alias("title"),
    )
    mod = F.col("index") % 10
    remote = local.filter(mod != 1).withColumns(
        {
            "title": F.when(mod == 2, F.concat(F.lit("New "), "title")).otherwise(F.col("title")),
            "source_chapter_id": F.when(mod == 3, F.lit(None)).when(mod == 4, F.concat(F.lit("n"), "source_chapter_id")).otherwise(F.col("source_chapter_id")),
            "url": F.when(mod == 4, F.concat(F.lit("https://y.example.com/"), F.col("index").cast("string")))
            .when(mod == 6, F.replace("url", F.lit("ref=a"), F.lit("utm_source=b")))
            .when(mod == 7, F.concat(F.lit("https://z.example.com/"), F.col("index").cast("string"))).otherwise(F.col("url")),
        }
    )
    return local, remote


_LOCAL = """SELECT source AS book_id, doc_id AS "index", CASE WHEN doc_id % 10 <> 5 THEN 'd' || doc_id END AS sid, 'https://x.example.com/' || doc_id AS nurl, 'T ' || doc_id AS title FROM documents"""
_REMOTE = """SELECT source AS book_id, doc_id AS "index", CASE doc_id % 10 WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 4 THEN 'nd' || doc_id ELSE 'd' || doc_id END AS sid,
    CASE doc_id % 10 WHEN 4 THEN 'https://y.example.com/' || doc_id WHEN 7 THEN 'https://z.example.com/' || doc_id ELSE 'https://x.example.com/' || doc_id END AS nurl,
    CASE WHEN doc_id % 10 = 2 THEN 'New ' ELSE '' END || 'T ' || doc_id AS title FROM documents WHERE doc_id % 10 <> 1"""
_DIFF = f"""WITH l AS ({_LOCAL}), r AS ({_REMOTE}),
  d AS (SELECT coalesce(r.book_id, l.book_id) AS book_id, r."index" AS remote_order, l."index" AS local_order, r.title,
        CASE WHEN r."index" IS NULL THEN 'missing' WHEN l."index" IS NULL THEN 'new' WHEN l.title <> r.title OR l.nurl <> r.nurl THEN 'changed' ELSE 'unchanged' END AS change_kind
        FROM r FULL OUTER JOIN l ON l.book_id = r.book_id AND (l.sid = r.sid OR l.nurl = r.nurl))"""


@query("chapter_diff", f"{_DIFF} SELECT book_id, remote_order, local_order, title, change_kind FROM d")
def chapter_diff(t: Tables):  # noqa: ANN201
    return D.chapter_diff(*_snapshots(t)).select("book_id", "remote_order", "local_order", "title", "change_kind")


@query("plan_update", f"""{_DIFF}
  SELECT book_id, count(*) FILTER (WHERE change_kind <> 'missing') AS total, count(*) FILTER (WHERE change_kind IN ('new', 'changed')) AS to_download,
         count(*) FILTER (WHERE change_kind = 'unchanged') AS skipped, count(*) FILTER (WHERE change_kind = 'missing') AS missing,
         arg_max(title, remote_order) AS latest_chapter, count(*) FILTER (WHERE change_kind IN ('new', 'changed')) = 0 AS is_noop FROM d GROUP BY book_id""")
def plan_update(t: Tables):  # noqa: ANN201
    return D.plan_update(D.chapter_diff(*_snapshots(t)))


@query("to_download", f"{_DIFF} SELECT book_id, remote_order, change_kind FROM d WHERE change_kind IN ('new', 'changed')")
def to_download(t: Tables):  # noqa: ANN201
    return D.to_download(D.chapter_diff(*_snapshots(t))).select("book_id", "remote_order", "change_kind")


@query("diff_contested", """
  WITH RECURSIVE d AS (SELECT source AS b, doc_id AS k, floor(doc_id / 40)::BIGINT AS s, floor((doc_id + 20) / 40)::BIGINT AS u FROM documents),
  c AS (SELECT b, k, u, min(k) OVER (PARTITION BY b, s) AS first, min(k) OVER (PARTITION BY b, u) AS second, row_number() OVER (PARTITION BY b ORDER BY k DESC) AS n FROM d),
  st AS (SELECT b, 0::BIGINT AS n, NULL::BIGINT AS k, NULL::BIGINT AS pick, []::BIGINT[] AS used FROM (SELECT DISTINCT b FROM d)
    UNION ALL
    SELECT b, n, k, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
    FROM (SELECT c.b, c.n, c.k, CASE WHEN NOT list_contains(used, first) THEN first WHEN NOT list_contains(used, second) THEN second END AS pick, used FROM st JOIN c ON c.b = st.b AND c.n = st.n + 1)),
  m AS (SELECT b, k, pick FROM st WHERE n > 0)
  SELECT r.b AS book_id, -r.k AS remote_order, r.pick AS local_order, CASE WHEN r.pick IS NULL THEN 'new' WHEN x.u <> y.u THEN 'changed' ELSE 'unchanged' END AS change_kind
  FROM m r JOIN c x ON x.b = r.b AND x.k = r.k LEFT JOIN c y ON y.b = r.b AND y.k = r.pick
  UNION ALL SELECT b, NULL, k, 'missing' FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.b = c.b AND m.pick = c.k)""")
def diff_contested(t: Tables):  # noqa: ANN201
    """Remote rows compete for the same local rows: links and ids are shared by whole groups of documents."""
    k = F.col("doc_id")
    rows = t.documents.select(
        F.col("source").alias("book_id"), k.alias("index"), F.concat(F.lit("s"), (F.floor(k / 40)).cast("string")).alias("source_chapter_id"),
        F.concat(F.lit("https://x.example.com/"), (F.floor((k + 20) / 40)).cast("string")).alias("url"), F.lit("T").alias("title"),
    )
    return D.chapter_diff(rows, rows.withColumn("index", -F.col("index"))).select("book_id", "remote_order", "local_order", "change_kind")


@query("deep_diff", f"""
  WITH l AS (SELECT source AS book_id, 'sid:d' || doc_id AS identity_key, {S.content_hash('text')} AS old_hash FROM documents WHERE doc_id % 5 <> 1),
       r AS (SELECT source AS book_id, 'sid:d' || doc_id AS identity_key, {S.content_hash("CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE replace(text, chr(10), '  ') END")} AS new_hash FROM documents WHERE doc_id % 5 <> 2)
  SELECT coalesce(l.book_id, r.book_id) AS book_id, coalesce(l.identity_key, r.identity_key) AS identity_key, old_hash, new_hash,
         CASE WHEN old_hash IS NULL THEN 'new' WHEN new_hash IS NULL THEN 'missing' WHEN old_hash = new_hash THEN 'unchanged' ELSE 'changed' END AS change_kind
  FROM l FULL OUTER JOIN r ON l.book_id = r.book_id AND l.identity_key = r.identity_key""")
def deep_diff(t: Tables):  # noqa: ANN201
    k = F.col("doc_id")
    rows = t.documents.select(
        F.col("source").alias("book_id"), F.concat(F.lit("d"), k.cast("string")).alias("source_chapter_id"), F.lit("").alias("url"),
        k.alias("index"), F.lit("").alias("title"), "text", "doc_id",
    )
    later = F.when(k % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.replace("text", F.lit("\n"), F.lit("  ")))
    old = D.list_identities(rows.filter(k % 5 != 1).withColumn("content_hash", content_hash("text")))
    new = D.list_identities(rows.filter(k % 5 != 2).withColumn("content_hash", content_hash(later)))
    return D.deep_diff(old, new)
