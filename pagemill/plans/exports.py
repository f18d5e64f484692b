"""Books as text, Markdown and e-book parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.operators import export as X
from pagemill.plans import sqltext as S
from pagemill.plans import views as W
from pagemill.plans.registry import Tables, query
from pagemill.session import new_folder
from pagemill.sources.tables import as_json, read_packed, write_packed

CB = f"WITH ch AS ({W.CHAPTERS}), bk AS ({W.BOOKS})"
LF = "chr(10)"
RULE = f"{LF} || {LF} || repeat('=', 40) || {LF} || {LF}"


def _ends(pieces: str) -> str:
    white = S.lit(S.SPACE_CHARS)
    return f"""p AS ({pieces}), m AS (SELECT *, min(ord) OVER (PARTITION BY book_id) AS a, max(ord) OVER (PARTITION BY book_id) AS z FROM p)
  SELECT book_id, part, ord, CASE WHEN ord = z THEN rtrim(c, {white}) || {LF} ELSE c END AS content
  FROM (SELECT book_id, part, ord, a, z, CASE WHEN ord = a THEN ltrim(content, {white}) ELSE content END AS c FROM m)"""


@query("export_txt", f"""{CB}, """ + _ends(f"""
  SELECT id AS book_id, 'book.txt' AS part, -1 AS ord, title || CASE WHEN author <> '' THEN {LF} || '{fixed.AUTHOR_LABEL}' || author ELSE '' END
         || CASE WHEN intro <> '' THEN {LF} || {LF} || intro ELSE '' END || {RULE} AS content FROM bk
  UNION ALL SELECT book_id, 'book.txt', "index", title || {LF} || {LF} || content || {RULE} FROM ch"""))
def txt(t: Tables):  # noqa: ANN201
    return X.export_txt(W.books(t), W.chapters(t))


@query("packed_export", f"""{CB}, e AS (SELECT * FROM (WITH """ + _ends(f"""
  SELECT id AS book_id, 'book.txt' AS part, -1 AS ord, title || CASE WHEN author <> '' THEN {LF} || '{fixed.AUTHOR_LABEL}' || author ELSE '' END
         || CASE WHEN intro <> '' THEN {LF} || {LF} || intro ELSE '' END || {RULE} AS content FROM bk
  UNION ALL SELECT book_id, 'book.txt', "index", title || {LF} || {LF} || content || {RULE} FROM ch""") + """))
  SELECT book_id, part, ord, strlen(content) AS bytes, md5(content) AS digest FROM e""")
def packed(t: Tables):  # noqa: ANN201
    """The text export written in a few files with an index, and read back through the index."""
    path = new_folder(t._spark, "packed")  # noqa: SLF001
    index = write_packed(X.export_txt(W.books(t), W.chapters(t)), path, tasks=6, file_bytes=100_000)
    return read_packed(index, path).select("book_id", "part", "ord", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


@query("export_markdown", f"""{CB}, n AS (SELECT *, {S.normalize("CASE WHEN \"index\" = 2 THEN '' ELSE content END")} AS body FROM ch), """ + _ends(f"""
  SELECT id AS book_id, 'book.md' AS part, -1 AS ord, '# ' || title || {LF} || CASE WHEN author <> '' THEN {LF} || '- {fixed.AUTHOR_LABEL}' || author ELSE '' END
         || {LF} || '- {fixed.SOURCE_LABEL}' || source_id || CASE WHEN intro <> '' THEN {LF} || {LF} || '> ' || intro ELSE '' END || {LF} AS content FROM bk
  UNION ALL SELECT book_id, 'book.md', "index", '### ' || title || {LF} || {LF} ||
         CASE WHEN body = '' THEN '_{fixed.EMPTY_CHAPTER}_' ELSE array_to_string({S.paragraphs('body')}, {LF} || {LF}) END || {LF} FROM n"""))
def markdown(t: Tables):  # noqa: ANN201
    chapters = W.chapters(t).withColumn("content", F.when(F.col("index") == 2, "").otherwise(F.col("content")))
    return X.export_markdown(W.books(t), chapters, heading_level=3)


def _esc(x: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {S.lit(char)}, {S.lit(entity)})"
    return x


@query("export_metadata", f"""{CB}
  SELECT id AS book_id, 'title=' || title || chr(10) || 'creator=' || coalesce(nullif(author, ''), 'Unknown') || chr(10) || 'language=' || coalesce(language, 'zh-CN')
         || CASE WHEN intro <> '' THEN chr(10) || 'description=' || intro ELSE '' END || chr(10) || 'publisher=' || publisher
         || chr(10) || 'rights=' || status || ' / ' || coalesce(nullif(author, ''), 'unknown') || chr(10) || 'source=' || source_book_id AS metadata FROM bk""")
def metadata(t: Tables):  # noqa: ANN201
    templates = {"rights": "{{status}} / {{author}}", "source": "{{ source_book_id }}", "subject": "{{none}}"}
    out = X.export_metadata(W.books(t), templates)
    pairs = F.transform("metadata", lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("book_id", F.array_join(pairs, "\n").alias("metadata"))


_XHTML = f"""{S.lit(fixed.XHTML_OPEN + '>' + chr(10) + '<head>' + chr(10) + '  <title>')} || {_esc('title')} ||
  {S.lit('</title>' + chr(10) + '  <link rel="stylesheet" type="text/css" href="style.css"/>' + chr(10) + '</head>' + chr(10) + '<body>' + chr(10) + '  <h1>')} || {_esc('title')} || '</h1>' || {LF} ||
  array_to_string(list_transform({S.paragraphs('body')}, lambda q: '    <p>' || {_esc('q')} || '</p>'), {LF}) || {S.lit(chr(10) + '</body>' + chr(10) + '</html>' + chr(10))}"""


@query("export_xhtml_parts", f"""{CB}, n AS (SELECT *, {S.normalize('content')} AS body, row_number() OVER (PARTITION BY book_id ORDER BY "index") AS pos FROM ch)
  SELECT book_id, 'OEBPS/chapter_' || lpad(pos::VARCHAR, 4, '0') || '.xhtml' AS part, 0 AS ord, md5({_XHTML}) AS content FROM n
  UNION ALL SELECT book_id, 'OEBPS/toc.xhtml', pos, md5('      <li><a href="chapter_' || lpad(pos::VARCHAR, 4, '0') || '.xhtml">' || {_esc('title')} || '</a></li>' || {LF}) FROM n
  UNION ALL SELECT book_id, 'OEBPS/toc.ncx', pos, md5('    <navPoint id="nav' || pos || '" playOrder="' || pos || '">' || {LF} || '      <navLabel><text>' || {_esc('title')} || '</text></navLabel>' || {LF}
       || '      <content src="chapter_' || lpad(pos::VARCHAR, 4, '0') || '.xhtml"/>' || {LF} || '    </navPoint>' || {LF}) FROM n
  UNION ALL SELECT book_id, 'OEBPS/content.opf', pos, md5('    <item id="ch' || pos || '" href="chapter_' || lpad(pos::VARCHAR, 4, '0') || '.xhtml" media-type="application/xhtml+xml"/>' || {LF}) FROM n
  UNION ALL SELECT book_id, 'OEBPS/content.opf', pos + 2199023255552, md5('    <itemref idref="ch' || pos || '"/>' || {LF}) FROM n""")
def xhtml_parts(t: Tables):  # noqa: ANN201
    """The pieces made per chapter; contents as digests."""
    parts = X.export_xhtml_parts(W.books(t), W.chapters(t))
    per_chapter = F.startswith("part", F.lit("OEBPS/chapter_")) | (
        F.col("part").isin("OEBPS/toc.xhtml", "OEBPS/toc.ncx", "OEBPS/content.opf") & (F.col("ord") % (1 << 40) > 0)
    )
    return parts.filter(per_chapter).withColumn("content", F.md5("content"))


@query("export_book_parts", f"""{CB}
  SELECT id AS book_id, part, ord, CASE part WHEN 'mimetype' THEN '{fixed.EPUB_MIMETYPE}' WHEN 'OEBPS/cover.xhtml' THEN 'cover' ELSE '' END AS head
  FROM bk, (VALUES ('mimetype', 0), ('META-INF/container.xml', 0), ('OEBPS/style.css', 0), ('OEBPS/cover.xhtml', 0), ('OEBPS/toc.xhtml', 0), ('OEBPS/toc.xhtml', 1099511627776),
       ('OEBPS/toc.ncx', 0), ('OEBPS/toc.ncx', 1099511627776), ('OEBPS/content.opf', 0), ('OEBPS/content.opf', 1099511627776), ('OEBPS/content.opf', 3298534883328)) AS v(part, ord)
  WHERE part <> 'OEBPS/cover.xhtml' OR source_id IN ('s1', 's2')""")
def book_parts(t: Tables):  # noqa: ANN201
    """The pieces made per book; two sources have covers."""
    covers = W.books(t).filter("source_id in ('s1', 's2', 's3')").select(
        F.col("id").alias("book_id"), F.when(F.col("source_id") == "s3", ".tiff").otherwise(".PNG").alias("suffix")
    )
    parts = X.export_xhtml_parts(W.books(t), W.chapters(t), covers)
    per_book = (~F.startswith("part", F.lit("OEBPS/chapter_"))) & (
        ~F.col("part").isin("OEBPS/toc.xhtml", "OEBPS/toc.ncx", "OEBPS/content.opf") | (F.col("ord") % (1 << 40) == 0)
    )
    head = F.when(F.col("part") == "mimetype", F.col("content")).when(F.contains("content", F.lit('src="cover.png"')), "cover").otherwise("")
    return parts.filter(per_book).select("book_id", "part", "ord", head.alias("head"))


@query("export_ledger", f"""WITH e AS ({W.TASK_EVENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY micros DESC, event_id DESC) AS rn,
      min(micros) OVER (PARTITION BY task_id) AS created, max(CASE WHEN status IN ('success', 'failed') THEN micros END) OVER (PARTITION BY task_id) AS finished FROM e)
  SELECT task_id AS export_id, created AS created_at, finished AS finished_at, status, k AS size_bytes, CASE WHEN status = 'success' THEN '/out/' || task_id END AS path FROM r WHERE rn = 1""")
def ledger(t: Tables):  # noqa: ANN201
    rows = W.task_events(t).select(
        F.col("task_id").alias("export_id"), "event_id", F.col("micros").alias("at"), "status", F.col("k").alias("size_bytes"),
        F.when(F.col("status") == "success", F.concat(F.lit("/out/"), "task_id")).alias("path"),
    )
    return X.export_ledger(rows).drop("at", "event_id")


@query("export_formats", """
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'markdown' WHEN 2 THEN 'markdown' WHEN 3 THEN 'epub' END AS format FROM part""")
def formats(t: Tables):  # noqa: ANN201
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "TXT").when(k == 1, "md").when(k == 2, "Markdown").when(k == 3, "epub").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.resolve_format(raw).alias("format"))


@query("as_json", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def listing(t: Tables):  # noqa: ANN201
    return as_json(t.nation)
