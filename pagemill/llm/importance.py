"""Importance resampling towards a target distribution: documents whose hashed n-grams are commoner in the target score
higher, and a fixed share of the documents is drawn by perturbed score.

N-gram buckets come from prefix CRCs (``prefix_crc``). Two passes over the texts: bucket counts, summed in every task before
they are shuffled, then the mean gain of every document from a table of one number per bucket. The order of the draw is
settled on narrow rows in ranges, so neither a hot id nor a common score gathers in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import bounded, select, texts
from pagemill.llm.prefix_crc import Scanned
from pagemill.session import cut_lineage

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text that are scanned together; a longer text is scanned alone.
SCAN_BYTES = 1 << 20


def _scans(column: pa.Array) -> Iterator[Scanned]:
    rows, held = [], 0
    for text in texts(column):
        rows.append(text.encode())
        held += len(rows[-1])
        if held >= SCAN_BYTES:
            yield Scanned(rows)
            rows, held = [], 0
    if rows:
        yield Scanned(rows)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket, n``: n-gram occurrences of all texts per bucket, without the empty buckets. Null texts count as empty."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for scan in _scans(batch.column(0)):
                for n in range(1, longest + 1):
                    total += np.bincount(scan.ngrams(n)[0] % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], names=["bucket", "n"])

    return select(docs, "text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed bucket frequencies, target over source."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratios = ((float(t + 1) * (s_all + buckets)) / (float(s + 1) * (t_all + buckets)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row; the weight is the floored mean gain, 0 without features."""
    bounded(docs.sparkSession)
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, sums = [], [], []
            for scan in _scans(batch.column(1)):
                count, total = np.zeros(len(scan.counts), np.int64), np.zeros(len(scan.counts), np.int64)
                for n in range(1, longest + 1):
                    crcs, runs = scan.ngrams(n)
                    reach = np.r_[0, np.cumsum(gain[crcs % np.uint32(buckets)])]
                    ends = np.cumsum(runs)
                    total += reach[ends] - reach[ends - runs]
                    count += runs
                words.append(scan.counts)
                features.append(count)
                sums.append(total // np.maximum(count, 1))
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (words, features, sums)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    named = select(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    return named.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel number that depends on the seed and the id alone; a null id reads as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_sample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where the row was not drawn.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn, highest score first, ties to the
    smaller id. Null texts count as empty and are never drawn (unless ``least_words`` is 0); a null id counts as the smallest;
    repeated rows are rows of their own, in any order among equals. Empty tables give no rows, an empty target a table of
    gains that only tells common from rare. Further columns do not travel.
    """
    gain = gains(_dense(bucket_counts(docs, buckets, longest), buckets), _dense(bucket_counts(target, buckets, longest), buckets))
    scored = weights(docs, gain, longest).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    rows = cut_lineage(scored.withColumns({"_open": F.col("n_words") >= least_words, "_row": F.monotonically_increasing_id()}))
    drawn = rows.filter("_open").count() * percent // 100
    order = [F.desc("_open"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_row")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    placed = ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before, past = {}, 0
    for part, n in placed.groupBy("_part").count().orderBy("_part").collect():  # one row per shuffle partition
        before[part], past = past, past + n
    first = docs.sparkSession.createDataFrame(list(before.items()), "_part int, _before long")
    rank = F.col("_before") + F.col("_at") + 1
    out = placed.join(F.broadcast(first), "_part", "left")
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("_open") & (rank <= drawn), rank).alias("rank"))
