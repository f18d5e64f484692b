"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of characters that are not letters reads as one space. Counts of the n-grams are
learned from a bounded sample of labelled rows per language; the matrix of log probabilities has a fixed number of
buckets, so that its size is bounded by the number of languages, and it is broadcast. Batches of texts are scored in numpy:
all n-grams of a batch are hashed at once and only their rows of the matrix are summed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import bounded, texts
from pagemill.llm.sampling import bound_share, fold, share

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 3000
TOGETHER = 100  # texts hashed at once; a text of 1,000 characters takes some 150 KB on the way
MOST_LANGUAGES = 100
LETTERS = re.compile(r"[\W\d_]+")
_MIX = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def ngram_buckets(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and where the n-grams of each text begin (one more at the end)."""
    clean = [" " + LETTERS.sub(" ", t.lower()).strip(" ") + " " for t in batch]
    clean = [c if len(c) > 2 else "" for c in clean]
    size = np.array([len(c) for c in clean], np.int64)
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(size), size)
    at = np.arange(len(codes))
    parts, places = [], []
    for n in ORDERS:
        usable = at[: max(0, len(codes) - n + 1)]
        usable = usable[usable + n <= ends[: len(usable)]]
        h = np.full(len(usable), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[usable + k]) * _MIX[k]
            h ^= h >> np.uint64(29)
        parts.append((h >> np.uint64(48)).astype(np.int64))
        places.append(usable)
    if len(ORDERS) > 1:
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        buckets, place = np.concatenate(parts)[order], place[order]
    else:
        buckets, place = parts[0], places[0]
    starts = np.searchsorted(place, np.r_[0, np.cumsum(size)])
    return buckets, starts


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` labelled rows per language at most, chosen by a hash of the id alone."""
    known = docs.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return known.limit(0)
    limits = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, bound_share(n, rows))])
    return known.filter(share("doc_id") < limits[F.col("lang")])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities: BUCKETS rows, one column per language; its last row is the prior.

    Learned from ``text`` and ``lang`` of the given rows. ``sample_rows`` bounds the rows per language; at most
    ``MOST_LANGUAGES`` of the most frequent labels are learned, which bounds the matrix.
    """
    sample = _sample(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), sample_rows).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            langs = batch.column(0).to_pylist()
            buckets, starts = ngram_buckets(texts(batch.column(1)))
            for k, lang in enumerate(langs):
                total = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[:BUCKETS] += np.bincount(buckets[starts[k] : starts[k + 1]], minlength=BUCKETS)
                total[BUCKETS] += 1
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    counted = sample.repartition(4).mapInArrow(run, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[rows["bucket"].to_numpy(), np.searchsorted(langs, rows["lang"]) if langs else []] = rows["n"]
    grams = counts[:BUCKETS] + 0.5
    log = np.vstack([np.log(grams / grams.sum(0)), np.log((counts[BUCKETS:] + 1) / (counts[BUCKETS].sum() + len(langs) or 1))])
    return langs, log.astype(np.float32)


def predict(batch: list[str], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability; ``und`` and 0 for texts without a letter."""
    buckets, starts = ngram_buckets(batch)
    has = np.array([any(map(str.isalpha, t)) for t in batch], bool) & (np.diff(starts) > 0)
    sums = np.zeros((len(batch), len(langs)))
    if len(buckets) and len(langs):
        used = np.flatnonzero(np.diff(starts) > 0)
        for c in range(len(langs)):
            sums[used, c] = np.add.reduceat(matrix[:, c][buckets], starts[:-1][used], dtype=np.float64)
        sums += matrix[BUCKETS]
    if not len(langs):
        return [UNKNOWN] * len(batch), np.zeros(len(batch))
    best = sums.argmax(1)
    posterior = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)], np.where(has, posterior, 0.0)


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the rows; every other column stays. Null texts are ``und``."""
    spark = bounded(docs.sparkSession)
    model = spark.sparkContext.broadcast((langs, np.asfortranarray(matrix)))  # bounded: BUCKETS x MOST_LANGUAGES x 4 bytes
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index("text")
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log = model.value
        for batch in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            best, score = predict(texts(batch.column(at)), names, log)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def language_id(docs: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    Rows whose crc32(doc_id) modulo ``folds`` is 0 are held out of the training; a null id is held out too. Null texts and
    texts without a letter are ``und`` with score 0, as is everything if no row is labelled. Repeated rows come back as often
    as they occur; further columns are ignored. An empty table gives no rows.
    """
    langs, matrix = train(docs.filter(fold("doc_id", folds) != 0), sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == 0).alias("held_out"), "text")
    return identify(rows, langs, matrix).select("doc_id", "held_out", "lang_pred", "score")
