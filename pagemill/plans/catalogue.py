"""Rule catalogues derived from the crawl: checks, coverage, health, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import rules as R
from pagemill.plans import sqltext as S
from pagemill.plans.registry import Tables, query


def _host():  # noqa: ANN202
    return F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]+)", 1)


def _catalogue(t: Tables):  # noqa: ANN202
    """Suppliers as sources: their key decides what is wrong with their rules."""
    k = F.col("s_suppkey")
    base = t.supplier.select(F.concat(F.lit("src-"), k.cast("string")).alias("source_id"), k.alias("k"))
    site = F.concat(F.lit("site"), F.col("k").cast("string"), F.lit(".example.com"))
    sources = base.select(
        "source_id", F.when(F.col("k") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(site)).alias("allowed")
    )
    none = F.lit(None).cast("string")
    rule = lambda c, f, r: F.struct(F.lit(c).alias("capability"), F.lit(f).alias("field"), r.alias("rule"))
    rules = base.select(
        "source_id",
        F.inline(
            F.array(
                rule("search", "list", F.when(F.col("k") % 4 == 1, "xpath://li").otherwise(".item > a")),
                rule("search", "title", F.lit(".title@text")),
                rule("search", "url", F.when(F.col("k") % 3 != 0, "a@href")),
                rule("search", "author", F.when(F.col("k") % 2 != 0, ".author")),
                rule("content", "body", F.when(F.col("k") % 7 == 2, "div:nth-child(2)").otherwise("#content@html")),
            )
        ),
    ).filter("rule IS NOT NULL")
    tpl = lambda c, p, v: F.struct(F.lit(c).alias("capability"), F.lit(p).alias("path"), v.alias("template"))
    templates = base.select(
        "source_id",
        F.inline(
            F.array(
                tpl("search", "request.url", F.concat(F.lit("https://"), F.when(F.col("k") % 6 == 1, F.lit("other.example.org")).otherwise(
                    F.concat(F.lit("www."), site)), F.lit(":443/s"))),
                tpl("search", "request.query.q", F.lit("{{keyword}} {{ config.lang }}")),
                tpl("book", "request.url", F.when(F.col("k") % 8 == 3, "{{book.link}}").otherwise("{{book.url}}")),
            )
        ),
    )
    removes = base.select("source_id", F.explode(F.array(F.lit("script"), F.when(F.col("k") % 3 == 1, "style").otherwise(none))).alias("selector"))
    return sources, rules, templates, removes.filter("selector IS NOT NULL")


_LINT = """
  WITH s AS (SELECT s_suppkey AS k, 'src-' || s_suppkey AS source_id FROM supplier),
  f AS (
    SELECT source_id, 'error' AS severity, 'book.request.url' AS path, 'unknown variable book.link' AS message FROM s WHERE k % 8 = 3
    UNION ALL SELECT source_id, 'error', 'search.request.url', 'host not allowed: other.example.org' FROM s WHERE k % 6 = 1 AND k % 5 <> 0
    UNION ALL SELECT source_id, 'warning', 'permissions.network', 'no allowed domains' FROM s WHERE k % 5 = 0
    UNION ALL SELECT source_id, 'warning', 'content.clean.remove', 'not removed: style' FROM s WHERE k % 3 <> 1
    UNION ALL SELECT source_id, 'error', 'search.result.fields.url', 'missing field url' FROM s WHERE k % 3 = 0
    UNION ALL SELECT source_id, 'warning', 'search.result.fields.author', 'missing field author' FROM s WHERE k % 2 = 0
    UNION ALL SELECT source_id, 'error', 'content.body', 'unsupported selector div:nth-child(2)' FROM s WHERE k % 7 = 2
    UNION ALL SELECT source_id, 'error', 'search.list', 'list rule of type xpath' FROM s WHERE k % 4 = 1)"""


@query("lint_rules", f"{_LINT} SELECT * FROM f")
def lint(t: Tables):  # noqa: ANN201
    return R.lint_rules(*_catalogue(t)).drop("hint")


@query("lint_summary", f"""{_LINT} SELECT s.source_id, count(f.severity) FILTER (WHERE severity = 'error') AS errors, count(f.severity) FILTER (WHERE severity = 'warning') AS warnings,
  CASE WHEN count(f.severity) FILTER (WHERE severity = 'error') = 0 THEN 'READY' ELSE 'BROKEN' END AS result FROM s LEFT JOIN f ON f.source_id = s.source_id GROUP BY 1""")
def summary(t: Tables):  # noqa: ANN201
    catalogue = _catalogue(t)
    return R.lint_summary(catalogue[0], R.lint_rules(*catalogue))


@query("source_health", f"""{_LINT}, e AS (SELECT source_id, count(severity) FILTER (WHERE severity = 'error') AS errors FROM s LEFT JOIN f USING (source_id) GROUP BY 1)
  SELECT source_id, errors, CASE WHEN errors > 0 THEN 'broken' WHEN length(source_id) % 2 = 0 THEN 'degraded' ELSE 'healthy' END AS health FROM e""")
def health(t: Tables):  # noqa: ANN201
    catalogue = _catalogue(t)
    homes = catalogue[0].select("source_id", F.when(F.length("source_id") % 2 == 0, 503).otherwise(200).alias("status_code"))
    return R.source_health(R.lint_summary(catalogue[0], R.lint_rules(*catalogue)), homes)


@query("capability_consistency", """
  SELECT 'src-' || s_suppkey AS source_id, 'book' AS capability, 'declared_not_provided' AS problem FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 = 0
  UNION ALL SELECT 'src-' || s_suppkey, 'book', 'provided_not_declared' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0""")
def consistency(t: Tables):  # noqa: ANN201
    k = F.col("s_suppkey")
    base = t.supplier.select(F.concat(F.lit("src-"), k.cast("string")).alias("source_id"), k)
    always = base.select("source_id", F.lit("search").alias("capability"))
    book = lambda keep: base.filter(keep).select("source_id", F.lit("book").alias("capability"))
    return R.capability_consistency(always.unionByName(book(k % 3 != 0)), always.unionByName(book(k % 4 != 0)))


@query("valid_ids", """
  SELECT p_partkey, regexp_matches(lower(p_type) || '-' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '' END, '^[a-z][a-z0-9]*(?:[-_][a-z0-9]+)*$') AS good_id,
         p_partkey % 4 <> 0 AS good_version, p_partkey % 4 <> 0 AND p_size >= 10 AND p_size <= 40 AS supported FROM part""")
def valid_ids(t: Tables):  # noqa: ANN201
    k = F.col("p_partkey")
    ident = F.concat(F.lower("p_type"), F.lit("-"), k.cast("string"), F.when(k % 3 == 0, "-").otherwise(""))
    version = F.concat(F.lit("1."), k.cast("string"), F.when(k % 4 == 0, "").otherwise(".0-rc.1+b"))
    engine = F.concat(F.col("p_size").cast("string"), F.lit(".0.0"))
    return t.part.select(
        "p_partkey", R.valid_source_id(ident).alias("good_id"), R.valid_version(version).alias("good_version"),
        ((k % 4 != 0) & ~R.supported_version(engine, F.lit(None).cast("string"), (9, 9, 9)) & R.supported_version(engine, engine, (0, 0, 0)).isNotNull()
         & R.supported_version(engine, F.lit(None).cast("string"), (40, 0, 0))).alias("supported"),
    )


@query("domain_admission", f"""
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN true ELSE {S.host('url')} LIKE '%.example.com' OR {S.host('url')} = 'spam-farm.example.org' END
         AND ({S.host('url')} LIKE '%.example.com' OR {S.host('url')} LIKE '%.example.org') AS admitted FROM pages""")
def admission(t: Tables):  # noqa: ANN201
    """Two lists must pass; a third of the sources has no list of its own."""
    rows = t.pages.select("page_id", "url", (F.col("page_id") % 3).cast("string").alias("source_id"))
    own = rows.filter("source_id <> '0'").select("source_id", F.explode(F.array(F.lit("example.com"), F.lit("spam-farm.example.org"))).alias("domain"))
    top = t.pages.select(F.regexp_extract(_host(), r"([a-z]+\.(?:com|org))$", 1).alias("domain")).filter("domain <> ''")
    return R.domain_admission(rows, own, top).select("page_id", "admitted")


_ASSETS = f"""SELECT page_id, {S.host('url')} AS book_id, CASE page_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.webp' WHEN 3 THEN NULL ELSE '.gif' END AS suffix,
  length(html) > 4000 AS big FROM pages"""


@query("asset_admission", f"""WITH a AS ({_ASSETS})
  SELECT book_id, arg_max(page_id, page_id) AS asset_id, arg_max(suffix, page_id) AS suffix, 'covers/' || book_id || arg_max(suffix, page_id) AS path FROM a WHERE suffix IS NOT NULL AND NOT big GROUP BY 1""")
def assets(t: Tables):  # noqa: ANN201
    return R.asset_admission(_assets(t), max_bytes=4000)[0]


@query("asset_rejects", f"""WITH a AS ({_ASSETS}) SELECT page_id AS asset_id, book_id, CASE WHEN big THEN 'too_large' ELSE 'unknown_format' END AS reason FROM a WHERE suffix IS NULL OR big""")
def asset_rejects(t: Tables):  # noqa: ANN201
    return R.asset_admission(_assets(t), max_bytes=4000)[1]


def _assets(t: Tables):  # noqa: ANN202
    k = F.col("page_id") % 5
    return t.pages.select(
        F.col("page_id").alias("asset_id"), _host().alias("book_id"), F.encode("html", "ISO-8859-1").alias("content"),
        F.concat(F.lit("http://x.example.com/i"), F.when(k == 2, ".WEBP?x=.jpg").when(k == 3, ".svg").otherwise("/c.tiff")).alias("url"),
        F.when(k == 0, "image/JPEG; q=1").when(k == 1, "image/png").when(k == 4, "image/gif").alias("content_type"),
        F.timestamp_seconds(F.col("page_id")).alias("fetched_at"),
    )


@query("extraction_coverage", """
  WITH e AS (SELECT source, c.* FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (VALUES ('book', 'title'), ('book', 'intro'), ('content', 'body'), ('search', 'title')) AS c(capability, field)),
  r AS (SELECT source, 'book' AS capability, 'title' AS field, 'x' AS v FROM documents UNION ALL
        SELECT source, 'book', 'intro', CASE WHEN n_chars % 2 = 0 THEN ' ' ELSE 'i' END FROM documents UNION ALL
        SELECT source, 'content', 'body', CASE WHEN source IN ('src3', 'src4') THEN '' ELSE text END FROM documents)
  SELECT e.source AS source_id, e.capability, e.field, count(r.v) AS items, count(r.v) FILTER (WHERE trim(r.v) <> '') AS matched, count(r.v) FILTER (WHERE trim(r.v) = '') AS empty,
         CASE WHEN count(r.v) = 0 OR (e.capability = 'content' AND count(r.v) FILTER (WHERE trim(r.v) <> '') = 0) THEN 'fail' ELSE 'ok' END AS verdict
  FROM e LEFT JOIN r ON r.source = e.source AND r.capability = e.capability AND r.field = e.field GROUP BY 1, 2, 3""")
def coverage(t: Tables):  # noqa: ANN201
    s = F.col("source").alias("source_id")
    book = t.documents.select(
        s, F.lit("book").alias("capability"),
        F.create_map(F.lit("title"), F.lit("x"), F.lit("intro"), F.when(F.col("n_chars") % 2 == 0, " ").otherwise("i")).alias("record"),
    )
    body = t.documents.select(
        s, F.lit("content").alias("capability"),
        F.create_map(F.lit("body"), F.when(F.col("source").isin("src3", "src4"), "").otherwise(F.col("text"))).alias("record"),
    )
    fields = [("book", "title"), ("book", "intro"), ("content", "body"), ("search", "title")]
    expected = t.documents.select(s).distinct().select(
        "source_id", F.inline(F.array(*[F.struct(F.lit(c).alias("capability"), F.lit(f).alias("field")) for c, f in fields]))
    )
    return R.extraction_coverage(book.unionByName(body), expected)
