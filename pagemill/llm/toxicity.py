"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

Words are hashed in bulk from the bytes of a batch. Features are single words, neighbours, and pairs that skip one or two
words, each present or absent in a text. FTRL-proximal gives every coordinate its own rate, and its L1 term leaves few
weights other than zero; only those are gathered and broadcast. Learning runs over a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import bounded, flat
from pagemill.llm.sampling import bound_share, fold, share

BITS = 20
SKIPS = (1, 2, 3)
SAMPLE_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
THRESHOLD = 0.3
_K = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Bytes of words: letters, digits and everything beyond ASCII.
_WORD = np.array([(48 <= b <= 57) or (97 <= b <= 122) or b >= 128 for b in range(256)])
_POWERS = np.cumprod(np.full(1 << 10, 0x100000001B3, np.uint64), dtype=np.uint64)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of the lower-cased texts, and the row it belongs to."""
    data, offsets = flat(pc.utf8_lower(column))
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end with their text
    first = inside & (edge[:-1] | np.r_[True, ~inside[:-1]])
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    word = np.cumsum(first[at]) - 1
    place = (at - starts[word]) % len(_POWERS)
    sums = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place], np.searchsorted(at, starts))
    sums = (sums ^ (sums >> np.uint64(31))) * _K[0]
    return sums ^ (sums >> np.uint64(29)), np.searchsorted(offsets, starts, "right") - 1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a batch of texts and their rows, repeats included."""
    words, row = word_hashes(column)
    shift = np.uint64(64 - BITS)
    parts, rows = [(words * _K[1]) >> shift], [row]
    for k, skip in enumerate(SKIPS):
        same = row[skip:] == row[:-skip]
        a, b = words[:-skip][same], words[skip:][same]
        mixed = (a * _K[2] + np.uint64(k + 1)) ^ (b * _K[3])
        parts.append(((mixed ^ (mixed >> np.uint64(32))) * _K[0]) >> shift)
        rows.append(row[:-skip][same])
    return np.concatenate(parts).astype(np.int64), np.concatenate(rows)


def present(column: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a batch, by row; with weights only buckets whose weight is not zero."""
    bucket, row = features(column)
    if weights is not None:
        used = weights[bucket] != 0
        bucket, row = bucket[used], row[used]
    both = np.unique((row << BITS) | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


class Ftrl:
    """FTRL-proximal for logistic loss; the last coordinate is the bias, which the L1 term spares."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.l1 = np.full((1 << BITS) + 1, l1)
        self.l1[-1] = 0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        dense = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, dense)

    def learn(self, buckets: np.ndarray, label: int) -> None:
        at = np.append(buckets, 1 << BITS)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        sigma = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] = n + gradient * gradient


def train(labelled: DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all buckets and, last, of the bias. ``labelled`` (``doc_id, text, label``) is a bounded sample: it is
    learned in one task, in an order that depends on the ids alone."""
    schema = "at long, w double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        labels: list[int] = []
        for batch in batches:
            row, bucket = present(batch.column(0))
            rows += np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, batch.num_rows)))
            labels += batch.column(1).to_pylist()
        model = Ftrl()
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)).tolist():
                model.learn(rows[k], labels[k])
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    bounded(labelled.sparkSession)
    ordered = labelled.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text", "label").select("text", "label")
    learned = ordered.mapInArrow(run, schema).toPandas()  # at most 2^BITS + 1 weights, few of them not zero
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[learned["at"].to_numpy()] = learned["w"]
    return weights


def score_batch(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    row, bucket = present(column, weights[:-1])
    logit = np.bincount(row, weights[bucket], minlength=len(column)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` labelled documents at most: ``doc_id, text, label``, chosen by a hash of the id on both sides of the
    join, so that only the texts of the sample travel. Rows without a label or an id are left out."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = share("doc_id") < F.lit(bound_share(marked.count(), rows))
    side = marked.filter(chosen).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return docs.select("doc_id", "text").filter(chosen).join(side, "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, fold_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Labels of rows whose crc32(doc_id) modulo ``folds`` is ``fold_out`` are never learned. Null and empty texts score by the
    bias alone. A document with several labels counts as toxic if one says so. Without labels all scores are 0.5. Repeated
    rows come back as often as they occur; further columns are ignored; an empty table gives no rows.
    """
    weights = train(sample(docs, labels.filter(fold("doc_id", folds) != fold_out), sample_rows))
    held = bounded(docs.sparkSession).sparkContext.broadcast(weights)  # bounded: 2^BITS + 1 weights of 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_batch(batch.column(2), held.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == fold_out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
