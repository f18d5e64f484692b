"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, decontaminate, importance, langid, negatives, ngram_lm, packing, rules, secrets, shared, simhash, suffixes, token_file, toxicity
from pagemill.llm.tokens import public_file
from pagemill.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(prepare(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@query("op1_secret_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_id(table(spark, folder, "documents"))


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_simhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (n_repeat_words * 100 > n_words * 50)::BIGINT + 4 * (n_symbols * 10 > n_words)::BIGINT
        + 8 * (n_dup_lines * 2 > n_lines)::BIGINT + 16 * (word_chars < n_words * 2)::BIGINT + 32 * (word_chars > n_words * 20)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM f
"""


@query("op5_quality_rules", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality(table(spark, folder, "documents"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents"))


@query("op7_lm_scores")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.lm_scores(table(spark, folder, "documents"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_file("byte_bpe_50k.json"))


@query("op9_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_token_file")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    files = token_file.write_tokens(table(spark, folder, "documents"), public_file("word_bpe_49k.json"), shared.new_folder(spark, "tokens"))
    return token_file.read_tokens(files)


OP11_SQL = r"""
WITH RECURSIVE byte AS (SELECT 0 AS k, range(256) AS t UNION ALL
  SELECT k + 1, list_transform(t, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM byte WHERE k < 8),
crc AS (SELECT t FROM byte WHERE k = 8),
words AS (SELECT 'd' AS side, row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (SELECT side, row_no, unnest(w) AS f FROM words
  UNION ALL SELECT side, row_no, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
met AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
bucketed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM met, crc),
counted AS (SELECT side, bucket, count(*) AS n FROM features JOIN bucketed USING (f) GROUP BY ALL),
sums AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM counted),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE + 1) * (any_value(s) + 10000)
    / ((coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE + 1) * (any_value(t) + 10000))))::BIGINT AS g FROM counted, sums GROUP BY bucket),
weight AS (SELECT row_no, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
  FROM features JOIN bucketed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row_no),
scored AS (SELECT doc_id, row_no, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w) >= 20 AS able,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weight USING (row_no) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) FILTER (able) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""


@query("op11_importance_sample", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return importance.importance_sample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, folder, "documents"), public_file("word_bpe_49k.json"))


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"))
