"""Text core: cleaning, measures, the gate and its policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.core import fold_space, strip
from pagemill.operators import quality as Q
from pagemill.plans import sqltext as S
from pagemill.plans.registry import Tables, query

LETTERS = r"\p{L}"
POLICY = Q.ContentPolicy(script=LETTERS)
BODY = S.normalize("body0")
PROCESSED = f"""
  WITH c AS (SELECT *, {S.clean('text')} AS body0 FROM documents), b AS (SELECT *, {BODY} AS body FROM c),
  g AS ({S.gate('b', 'body', '50', '200000', LETTERS, '0.3', '0.6')})"""


@query("content_by_source", f"""{PROCESSED}
  SELECT source, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS accepted,
         count(*) FILTER (WHERE reason = 'empty') AS n_empty, count(*) FILTER (WHERE reason = 'too_short') AS too_short,
         count(*) FILTER (WHERE reason = 'too_long') AS too_long,
         count(*) FILTER (WHERE reason = 'low_script_ratio') AS low_script_ratio,
         count(*) FILTER (WHERE reason = 'high_repeat_ratio') AS high_repeat_ratio,
         coalesce(sum({S.words('body')}) FILTER (WHERE reason IS NULL), 0)::BIGINT AS words,
         count(DISTINCT {S.content_hash('body')}) AS hashes
  FROM g GROUP BY source ORDER BY source""")
def content_by_source(t: Tables):  # noqa: ANN201
    """Flagship: clean, normalise, gate, count and hash every document; one row per source."""
    done = Q.process_content(t.documents.select("source", "text"), policy=POLICY)
    reason = F.col("rejected.reason")
    return (
        done.groupBy("source")
        .agg(
            F.count("*").alias("n"),
            F.count_if(reason.isNull()).alias("accepted"),
            F.count_if(reason == "empty").alias("n_empty"),
            *[
                F.count_if(reason == r).alias(r)
                for r in ("too_short", "too_long", "low_script_ratio", "high_repeat_ratio")
            ],
            F.coalesce(F.sum(F.when(reason.isNull(), F.col("word_count"))), F.lit(0)).alias("words"),
            F.count_distinct("content_hash").alias("hashes"),
        )
        .orderBy("source")
    )


@query("clean_text", f"SELECT page_id, {S.clean('html')} AS body FROM pages")
def clean_pages(t: Tables):  # noqa: ANN201
    return t.pages.select("page_id", X.clean_text("html").alias("body"))


@query("normalize_text", f"SELECT doc_id, {S.normalize('text')} AS body FROM documents")
def normalize_documents(t: Tables):  # noqa: ANN201
    return t.documents.select("doc_id", X.normalize_text("text").alias("body"))


@query("split_paragraphs", f"""
  WITH n AS (SELECT doc_id, {S.normalize('text')} AS body FROM documents),
       p AS (SELECT doc_id, {S.paragraphs('body')} AS ps FROM n)
  SELECT doc_id, i - 1 AS pos, ps[i] AS paragraph FROM p, unnest(range(1, len(ps) + 1)) AS r(i)""")
def paragraphs(t: Tables):  # noqa: ANN201
    return t.documents.select("doc_id", F.posexplode(X.split_paragraphs("text")).alias("pos", "paragraph")).withColumn(
        "pos", F.col("pos").cast("long")
    )


@query("text_measures", f"""
  SELECT doc_id, {S.words('text')} AS words, round({S.script_ratio('text', LETTERS)}, 6) AS letters,
         round({S.script_ratio('text', X.fixed.CJK_CLASS)}, 6) AS cjk, round({S.repeat_ratio('text')}, 6) AS repeats,
         {S.content_hash('text')} AS hash, length({S.strip('text')}) AS stripped, length({S.fold('text')}) AS folded
  FROM documents""")
def text_measures(t: Tables):  # noqa: ANN201
    return t.documents.select(
        "doc_id",
        X.count_words("text").cast("long").alias("words"),
        F.round(X.script_ratio("text", LETTERS), 6).alias("letters"),
        F.round(X.script_ratio("text"), 6).alias("cjk"),
        F.round(X.repeat_line_ratio("text"), 6).alias("repeats"),
        X.content_hash("text").alias("hash"),
        F.length(strip("text")).cast("long").alias("stripped"),
        F.length(fold_space("text")).cast("long").alias("folded"),
    )


@query("content_changed", f"""
  SELECT doc_id, {S.content_hash('text')} <> md5(text) AS changed FROM documents""")
def changed(t: Tables):  # noqa: ANN201
    return t.documents.select("doc_id", X.content_changed("text", F.md5("text")).alias("changed"))


@query("quality_rejects", f"""{PROCESSED}
  SELECT doc_id, source, reason, CASE reason WHEN 'empty' THEN n WHEN 'too_short' THEN n WHEN 'too_long' THEN n
         WHEN 'low_script_ratio' THEN round(sr, 4) ELSE round(rr, 4) END::DOUBLE AS measure,
         CASE reason WHEN 'too_short' THEN 50 WHEN 'too_long' THEN 200000 WHEN 'low_script_ratio' THEN 0.3
         WHEN 'high_repeat_ratio' THEN 0.6 END::DOUBLE AS threshold
  FROM g WHERE reason IS NOT NULL""")
def rejects(t: Tables):  # noqa: ANN201
    return Q.rejected(Q.process_content(t.documents.select("doc_id", "source", "text"), policy=POLICY)).drop("text")


@query("process_content", f"""{PROCESSED}
  SELECT doc_id, body, {S.words('body')} AS word_count, {S.content_hash('body')} AS content_hash FROM g WHERE reason IS NULL""")
def processed(t: Tables):  # noqa: ANN201
    done = Q.accepted(Q.process_content(t.documents.select("doc_id", "text"), policy=POLICY))
    return done.drop("text").withColumn("word_count", F.col("word_count").cast("long"))


@query("fallback_content", f"""
  SELECT conv_id, turn, {S.strip('text')} AS body, {S.words(S.strip('text'))} AS word_count,
         {S.content_hash(S.strip('text'))} AS content_hash FROM conversations""")
def fallback(t: Tables):  # noqa: ANN201
    done = Q.fallback_content(t.conversations.drop("role"))
    return done.drop("text").withColumn("word_count", F.col("word_count").cast("long"))


@query("policy_override", f"""
  WITH src AS (SELECT source AS source_id, CASE WHEN min(n_chars) < 100 THEN 120 END AS min_length,
                      CASE WHEN max(n_chars) > 15000 THEN 15000 END AS max_length FROM documents GROUP BY 1),
  task AS (SELECT doc_id, CASE WHEN quality = 0 THEN 0.2 END AS max_repeat_line_ratio, CASE WHEN toxic = 1 THEN 300 END AS min_length FROM labels),
  p AS (SELECT d.doc_id, d.text, coalesce(task.min_length, src.min_length, 60) AS lo, coalesce(src.max_length, 200000) AS hi,
               coalesce(task.max_repeat_line_ratio, 0.6) AS rm
        FROM documents d LEFT JOIN src ON src.source_id = d.source LEFT JOIN task ON task.doc_id = d.doc_id),
  g AS ({S.gate('p', 'text', 'lo', 'hi', LETTERS, '0.3', 'rm')})
  SELECT doc_id, lo::INTEGER AS policy_min_length, hi::INTEGER AS policy_max_length, rm::DOUBLE AS policy_max_repeat_line_ratio, reason FROM g""")
def policies(t: Tables):  # noqa: ANN201
    """Thresholds from tables derived from the corpus: task over source over global over default."""
    source = t.documents.groupBy(F.col("source").alias("source_id")).agg(
        F.when(F.min("n_chars") < 100, 120).alias("min_length"),
        F.when(F.max("n_chars") > 15000, 15000).alias("max_length"),
    )
    task = t.labels.select(
        "doc_id",
        F.when(F.col("quality") == 0, 0.2).alias("max_repeat_line_ratio"),
        F.when(F.col("toxic") == 1, 300).alias("min_length"),
    )
    docs = t.documents.select("doc_id", F.col("source").alias("source_id"), "text")
    rows, policy = Q.resolve_policy(docs, task, source, {"min_length": 60}, task_key="doc_id", script=LETTERS)
    return rows.select(
        "doc_id",
        "policy_min_length",
        "policy_max_length",
        "policy_max_repeat_line_ratio",
        Q.quality_gate(F.col("text"), policy)["reason"].alias("reason"),
    )
