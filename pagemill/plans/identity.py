"""URLs, identity and request keys, names and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import fixed
from pagemill.functions import naming as N
from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.functions import values as V
from pagemill.operators import extract as E
from pagemill.operators import rules as R
from pagemill.plans import sqltext as S
from pagemill.plans import views as W
from pagemill.plans.registry import Tables, query


@query("normalize_url", f"SELECT page_id, {S.normalize_url('url')} AS url FROM pages")
def normalize_url(t: Tables):  # noqa: ANN201
    return t.pages.select("page_id", U.normalize_url("url").alias("url"))


@query("url_duplicates", f"""
  SELECT {S.normalize_url('url')} AS url, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1 HAVING count(*) > 1""")
def url_duplicates(t: Tables):  # noqa: ANN201
    """Pages that are one page up to tracking, order, fragment and trailing slash."""
    return (
        t.pages.groupBy(U.normalize_url("url").alias("url")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
        .filter("n > 1")
    )


@query("url_host", f"SELECT {S.host('url')} AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host(t: Tables):  # noqa: ANN201
    return t.pages.groupBy(U.url_host("url").alias("host")).agg(F.count("*").alias("n"))


_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/]+')"
_PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"
_FOLDER = f"regexp_replace({_PATH}, '[^/]*$', '')"


@query("url_join", f"""
  SELECT page_id, {_ORIGIN} || {_FOLDER} || 'x/y' AS relative, {_ORIGIN} || '/a/b' AS rooted,
         regexp_extract(url, '^[a-z]+:') || '//cdn.example.com/i.png' AS scheme_relative,
         {_ORIGIN} || {_PATH} || '?q=1' AS query_only,
         {_ORIGIN} || CASE WHEN len(string_split({_FOLDER}, '/')) <= 2 THEN '/' ELSE array_to_string(list_slice(string_split({_FOLDER}, '/'), 1, len(string_split({_FOLDER}, '/')) - 2), '/') || '/' END || 'up' AS parent,
         'mailto:a@b.c' AS other FROM pages""")
def url_join(t: Tables):  # noqa: ANN201
    refs = {"relative": "./x/y", "rooted": "/a/./c/../b", "scheme_relative": "//cdn.example.com/i.png", "query_only": "?q=1",
            "parent": "../up", "other": "mailto:a@b.c"}
    return t.pages.select("page_id", *[U.url_join("url", F.lit(r)).alias(n) for n, r in refs.items()])


_KEY = f"""CASE WHEN coalesce(source_chapter_id, '') <> '' THEN 'sid:' || source_chapter_id
    WHEN coalesce(url, '') <> '' THEN 'url:' || {S.normalize_url('url')} ELSE 'idx:' || "index" || ':' || title END"""


@query("identity_key", f"""WITH ch AS ({W.CHAPTERS}), v AS (SELECT * REPLACE (CASE WHEN "index" = 1 THEN '' ELSE url END AS url) FROM ch)
  SELECT id, {_KEY} AS identity_key,
         CASE WHEN source_chapter_id IS NULL AND url = '' THEN ['idx:' || "index" || ':' || title]
              ELSE list_filter([CASE WHEN source_chapter_id <> '' THEN 'sid:' || source_chapter_id END, CASE WHEN url <> '' THEN 'url:' || {S.normalize_url('url')} END], lambda k: k IS NOT NULL) END::VARCHAR AS candidates
  FROM v""")
def identity_key(t: Tables):  # noqa: ANN201
    rows = W.chapters(t).withColumn("url", F.when(F.col("index") == 1, "").otherwise(F.col("url")))
    keys = ("source_chapter_id", "url", "index", "title")
    listed = F.concat(F.lit("["), F.array_join(F.transform(U.candidate_keys(*keys), _duck_quote), ", "), F.lit("]"))
    return rows.select("id", U.identity_key(*keys).alias("identity_key"), listed.alias("candidates"))


def _duck_quote(key):  # noqa: ANN001, ANN202
    """How a list of texts prints in the comparison engine: quoted when it holds special characters."""
    return F.when(key.rlike(r"[\s,{}\[\]()'\"=:]"), F.concat(F.lit("'"), key, F.lit("'"))).otherwise(key)


@query("request_key", f"""
  WITH q AS (SELECT page_id, {S.host('url')} AS s, url, page_id % 3 AS m, regexp_replace(url, '#.*$', '') AS bare FROM pages),
       u AS (SELECT page_id, s, m, CASE WHEN contains(bare, '?') THEN bare || '&b=' || m || '&a=x y' ELSE bare || '?b=' || m || '&a=x y' END AS full_url FROM q)
  SELECT page_id, md5(s || chr(31) || CASE m WHEN 0 THEN 'POST' ELSE 'GET' END || chr(31) || {S.normalize_url('full_url')} ||
         CASE m WHEN 0 THEN chr(31) || md5('body') ELSE '' END || CASE m WHEN 1 THEN chr(31) || 'accept=1,cookie=1' ELSE '' END) AS request_key FROM u""")
def request_key(t: Tables):  # noqa: ANN201
    m = F.col("page_id") % 3
    params = F.create_map(F.lit("b"), m.cast("string"), F.lit("a"), F.lit("x y"), F.lit("utm_medium"), F.lit("z"))
    headers = F.when(m == 1, F.create_map(F.lit("Cookie"), F.col("url"), F.lit("ACCEPT"), F.lit("*/*"))).otherwise(
        F.create_map(F.lit("User-Agent"), F.lit("x"))
    )
    key = U.request_key(
        U.url_host("url"), F.when(m == 0, "post").otherwise("get"), "url", params, F.when(m == 0, F.lit("body")), headers
    )
    return t.pages.select("page_id", key.alias("request_key"))


@query("search_predicate", """
  SELECT doc_id, replace(replace(replace(lang || '_' || source || '%', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped,
         contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'that with') AS hit, false AS blank FROM documents""")
def search_predicate(t: Tables):  # noqa: ANN201
    return t.documents.select(
        "doc_id", X.escape_like(F.concat("lang", F.lit("_"), "source", F.lit("%"))).alias("escaped"),
        X.contains_keyword("text", "That WITH").alias("hit"), X.contains_keyword("text", "").alias("blank"),
    )


@query("sanitize_names", f"""
  WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'com' || page_id % 10 || '.' || page_id WHEN 1 THEN ' ..' ELSE url || '  ' || html END AS raw FROM pages),
       c AS (SELECT page_id, raw, {S.rep("trim(" + S.strip(S.rep('raw', fixed.ILLEGAL_NAME_CLASS, "'_'")) + ", '.')", S.SPACE_CLASS + '+', "' '")} AS c0 FROM n),
       d AS (SELECT page_id, raw, CASE WHEN c0 = '' THEN 'untitled' ELSE c0 END AS c1 FROM c)
  SELECT page_id, left(CASE WHEN upper(string_split(c1, '.')[1]) IN ({', '.join(S.lit(r) for r in fixed.RESERVED_NAMES)}) THEN '_' || c1 ELSE c1 END, 150) AS name,
         contains(raw, '/') OR contains(raw, '\\') OR raw IN ('', '.', '..') AS unsafe FROM d""")
def sanitize_names(t: Tables):  # noqa: ANN201
    p = F.col("page_id")
    raw = (
        F.when(p % 4 == 0, F.concat(F.lit("com"), (p % 10).cast("string"), F.lit("."), p.cast("string")))
        .when(p % 4 == 1, " ..").otherwise(F.concat("url", F.lit("  "), "html"))
    )
    return t.pages.select("page_id", raw.alias("raw")).select(
        "page_id", N.sanitize_component("raw").alias("name"), N.is_unsafe_component("raw").alias("unsafe")
    )


@query("export_names", f"""WITH b AS ({W.BOOKS})
  SELECT id, CASE WHEN id IN ('c1', 'c5') THEN '/out/' || id ELSE 'exports/' || replace(replace(coalesce(nullif(author, ''), 'unknown') || ' - ' || title, '<', '_'), '>', '_') || '.txt' END AS path,
         's' || right(source_id, 1) || '-' || status || '-' AS short FROM b""")
def export_names(t: Tables):  # noqa: ANN201
    values = N.book_variables(*[F.col(c) for c in ("title", "author", "source_id", "source_book_id", "latest_chapter", "status")])
    explicit = F.when(F.col("id").isin("c1", "c5"), F.concat(F.lit("/out/"), F.col("id")))
    return W.books(t).select(
        "id", N.export_path(explicit, "exports", N.render_filename(values), "txt").alias("path"),
        N.render_template(F.lit("{{source_id}}-{{ status }}-{{none}}"), values).alias("short"),
    )


@query("chapter_names", f"""WITH ch AS ({W.CHAPTERS})
  SELECT id, "index" || '. ' || title || ' (' || id || ')' AS name FROM ch""")
def chapter_names(t: Tables):  # noqa: ANN201
    values = N.chapter_variables(
        F.create_map().cast("map<string,string>"), F.col("index"), F.col("title"), F.col("id")
    )
    return W.chapters(t).select("id", N.render_filename(values, "{{index}}. {{chapter_title}} ({{chapter_id}})").alias("name"))


@query("retry_curve", """
  SELECT event_id, CASE WHEN value < 30 THEN least(value, 60.0) ELSE least(power(2, json_extract_string(props, '$.k')::INT % 9), 60.0) END AS delay,
         CASE WHEN value < 100 THEN value END AS parsed,
         CASE WHEN event_type = 'error' THEN user_id % 600 >= 500 OR user_id % 600 = 429 ELSE event_type IN ('click', 'view') END AND json_extract_string(props, '$.k')::INT % 5 < 3 AS again
  FROM events""")
def retry_curve(t: Tables):  # noqa: ANN201
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.create_map(
        F.lit("error"), F.lit("NETWORK_HTTP_STATUS"), F.lit("click"), F.lit("NETWORK_TIMEOUT"), F.lit("view"), F.lit("NETWORK_ERROR"),
        F.lit("signup"), F.lit("PARSE_ERROR"), F.lit("purchase"), F.lit("CONTENT_INVALID"),
    )
    header = F.when(F.col("value") < 100, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise("Wed, 21 Oct 2015 07:28:00 GMT")
    return t.events.select(
        "event_id", V.retry_delay(k % 9, F.when(F.col("value") < 30, F.col("value"))).alias("delay"),
        V.parse_retry_after(header).alias("parsed"),
        V.is_retryable(F.try_element_at(code, F.col("event_type")), F.col("user_id") % 600, k % 5).alias("again"),
    )


@query("task_progress", """
  SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 0.0 ELSE least(1.0, round((o_orderkey % 7 + o_orderkey % 3) / (o_custkey % 10), 6)) END AS progress FROM orders""")
def task_progress(t: Tables):  # noqa: ANN201
    return t.orders.select(
        "o_orderkey",
        F.round(V.task_progress(F.col("o_orderkey") % 7, F.col("o_orderkey") % 3, F.col("o_custkey") % 10), 6).alias("progress"),
    )


@query("redact_map", """
  SELECT page_id, '***' AS cookie, url AS referer, '***' AS nested, 'x' AS plain FROM pages""")
def redact_map(t: Tables):  # noqa: ANN201
    record = t.pages.select(
        "page_id", F.create_map(F.lit("Cookie"), F.col("html"), F.lit("Referer"), F.col("url")).alias("headers"),
        F.struct(F.struct(F.col("url").alias("Token"), F.lit("x").alias("plain")).alias("inner")).alias("auth"),
    )
    masked = record.select(*V.redact_struct(record.schema))
    return masked.select(
        "page_id", F.col("headers")["Cookie"].alias("cookie"), F.col("headers")["Referer"].alias("referer"),
        F.col("auth.inner.Token").alias("nested"), F.col("auth.inner.plain").alias("plain"),
    )


@query("parse_status", """
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ongoing' WHEN 1 THEN 'completed' WHEN 2 THEN 'completed' ELSE 'unknown' END AS status FROM part""")
def parse_status(t: Tables):  # noqa: ANN201
    k = F.col("p_partkey") % 6
    raw = (
        F.when(k == 0, " Serializing　").when(k == 1, "FINISHED").when(k == 2, "已完结").when(k == 3, F.col("p_name"))
        .when(k == 4, "1")
    )
    return t.part.select("p_partkey", X.parse_status(raw).alias("status"))


@query("make_snippet", """
  WITH b AS (SELECT doc_id, text, 'with the' AS w, instr(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'with the') AS pos FROM documents)
  SELECT doc_id, CASE WHEN pos = 0 THEN trim(left(text, 60), chr(10) || ' ')
         ELSE CASE WHEN pos > 31 THEN '…' ELSE '' END || trim(substring(text, greatest(pos - 30, 1), least(pos - 1 + 8 + 30, length(text)) - greatest(pos - 30, 1) + 1), chr(10) || ' ')
              || CASE WHEN pos - 1 + 8 + 30 < length(text) THEN '…' ELSE '' END END AS snippet FROM b""")
def make_snippet(t: Tables):  # noqa: ANN201
    return t.documents.select("doc_id", X.make_snippet("text", "With the").alias("snippet"))


@query("build_requests", """
  SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS source_id, 'GET' AS method,
         regexp_extract(url, '^[a-z]+://[^/]+') || '/search' AS url, 'k' || page_id AS q, (page_id % 5)::VARCHAR AS page, 'agent/1' AS agent, 'x' AS accept
  FROM pages WHERE page_id % 7 <> 0""")
def build_requests(t: Tables):  # noqa: ANN201
    """Search requests of every host for one keyword per page; items without a page number are rejects."""
    ready, _ = R.build_requests(*_requests(t))
    return ready.select(
        F.col("item_id").alias("page_id"), "source_id", "method", "url", F.col("params")["q"].alias("q"),
        F.col("params")["page"].alias("page"), F.col("headers")["User-Agent"].alias("agent"), F.col("headers")["Accept"].alias("accept"),
    )


@query("request_rejects", """
  SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS source_id, 'page' AS unknown FROM pages WHERE page_id % 7 = 0""")
def request_rejects(t: Tables):  # noqa: ANN201
    _, bad = R.build_requests(*_requests(t))
    return bad.select(F.col("item_id").alias("page_id"), "source_id", F.array_join("unknown", ",").alias("unknown"))


def _requests(t: Tables):  # noqa: ANN202
    text = F.lit(None).cast("string")
    specs = t.pages.select(U.url_host("url").alias("source_id")).distinct().select(
        "source_id", F.lit("search").alias("capability"), F.lit("get").alias("method"),
        F.lit("{{ book.url }}/search").alias("url"),
        F.create_map(F.lit("Accept"), F.lit("x")).alias("headers"),
        F.create_map(F.lit("Accept"), F.lit("y"), F.lit("User-Agent"), F.lit("{{user_agent}}")).alias("default_headers"),
        F.create_map(F.lit("q"), F.lit("{{keyword}}"), F.lit("page"), F.lit("{{page}}")).alias("query"),
        text.alias("body"), text.alias("encoding"), F.lit(15000).alias("timeout_ms"),
    )
    p = F.col("page_id")
    variables = F.create_map(
        F.lit("keyword"), F.concat(F.lit("k"), p.cast("string")), F.lit("user_agent"), F.lit("agent/1"),
        F.lit("book.url"), F.regexp_extract("url", "^[a-z]+://[^/]+", 0),
        F.lit("page"), F.when(p % 7 != 0, (p % 5).cast("string")),
    )
    items = t.pages.select(U.url_host("url").alias("source_id"), F.lit("search").alias("capability"), p.alias("item_id"), variables.alias("vars"))
    return specs, items
