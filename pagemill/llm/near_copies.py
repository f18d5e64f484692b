"""Near-duplicate texts by wide SimHash fingerprints: five-word shingles, similarity of 0.8 or more.

The method is that of ``simhash`` (fingerprints compared in bit planes with carry-save counters, blocks abandoned early), but 64
bits cannot tell a similarity of 0.8 from chance with tables that stay small. A fingerprint is here as wide as its band
tables need: two texts of Jaccard similarity s differ in acos(2s / (1 + s)) / pi of the bits on average, so the rule below finds the
width and the number of bands from the number of texts alone. Each band is a table; texts that agree on a band meet, and are
linked if no more than ``REACH`` of all bits differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import bounded, texts
from pagemill.llm.components import components
from pagemill.llm.simhash import _above, _union, hash_shingles
from pagemill.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
#: Share of pairs at just that similarity which no band may bring together.
MISSED = 0.03
#: Standard deviations of the share of differing bits, at that similarity, that still count as near.
SPREAD = 1.3
#: Texts that share a band by chance alone, on average.
CROWD = 32
SLICE = 1 << 15
HELD = 1 << 16
HOT = 4096
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def layout(rows: int, similarity: float = SIMILARITY) -> tuple[int, int, int, int]:
    """Bits of a band, bands, 64-bit words of a fingerprint, and the radius in bits."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    band = max(11, math.ceil(math.log2(max(rows, 1) / CROWD)))
    bands = math.ceil(math.log(MISSED) / math.log(1 - (1 - differ) ** band))
    words = -(-band * bands // 64)
    reach = differ + SPREAD * math.sqrt(differ * (1 - differ) / (64 * words))
    return band, 64 * words // band, words, int(64 * words * reach)


def fingerprint(text: str, words: int, size: int = SHINGLE) -> bytes:
    """``words`` * 64 bits; a bit is the majority over the distinct shingles. No word: zeros."""
    hashes = np.unique(hash_shingles(text, size))
    out = np.zeros(words, np.uint64)
    for k in range(words if len(hashes) else 0):
        h = hashes + np.uint64((k + 1) * _MIX[0] & 0xFFFFFFFFFFFFFFFF)  # an independent hash for every word of the fingerprint
        h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[1])
        h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[2])
        h ^= h >> np.uint64(31)
        total = np.zeros(64, np.int64)
        for lo in range(0, len(h), 1 << 16):
            total += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out.tobytes()


def _matrix(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _spread(fps: DataFrame, band: int, bands: int, words: int) -> DataFrame:
    """``bucket, fp``: a row per band, the band number above its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(band, dtype=np.int64)
        for batch in batches:
            bits = np.unpackbits(_matrix(batch.column(0), words).view(np.uint8), axis=1, bitorder="little")
            keys = bits[:, : band * bands].reshape(-1, bands, band) @ weights + (np.arange(bands, dtype=np.int64) << 40)
            for k in range(bands):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, k].astype(np.int64)), batch.column(0)], names=["bucket", "fp"])

    return fps.select("fp").mapInArrow(run, "bucket long, fp binary")


def _planes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """planes[k, b]: bit k of the up to 64 fingerprints of block b; the lanes in use."""
    words = values.shape[1]
    planes, used = np.empty((64 * words, len(starts)), np.uint64), np.empty(len(starts), np.uint64)
    lane = np.arange(64)
    for at in range(0, len(starts), 512):
        part = slice(at, at + 512)
        rows = np.minimum(starts[part, None] + lane, ends[part, None] - 1)
        bits = np.unpackbits(values[rows].view(np.uint8).reshape(len(rows), 64, 8 * words), axis=2, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little")
        planes[:, part] = packed.view(np.uint64)[:, :, 0]
        used[part] = np.packbits(lane < (ends - starts)[part, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return planes, used


def _within(values: np.ndarray, planes: np.ndarray, used: np.ndarray, row: np.ndarray, block: np.ndarray, radius: int):  # noqa: ANN202
    """Comparisons (row, block) with a lane within the radius, and the mask of these lanes."""
    left, query = np.arange(len(row)), values[row]
    count = np.zeros((max(1, radius.bit_length()), len(row)), np.uint64)
    over = ~used[block]
    for k in range(len(planes)):
        carry = planes[k, block] ^ (np.uint64(0) - ((query[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1)))
        for d in range(len(count)):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if k % 32 == 31:
            over |= _above(count, radius)
            live = over != ~np.uint64(0)
            if not live.all():
                left, block, query, over, count = left[live], block[live], query[live], over[live], count[:, live]
                if not len(left):
                    break
    return left, ~over


def link_buckets(values: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """First row of the component of every row within its bucket; rows are grouped by bucket."""
    ends = np.r_[starts[1:], len(values)]
    labels = np.arange(len(values))
    many = ends - starts > 1
    starts, ends = starts[many], ends[many]
    if not len(starts):
        return labels
    size = ends - starts
    blocks = -(-size // 64)
    first = np.r_[0, np.cumsum(blocks)]
    lo = np.repeat(starts, blocks) + 64 * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    planes, used = _planes(values, lo, np.minimum(lo + 64, np.repeat(ends, blocks)))
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    rows, own = np.repeat(starts, size) + inside, np.repeat(first[:-1], size) + inside // 64
    meets = np.repeat(first[1:], size) - own  # its own block and the later ones of its bucket
    done = np.r_[0, np.cumsum(meets)]
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(done, done[at] + SLICE, "right")) - 1)
        n = meets[at:to]
        row = np.repeat(rows[at:to], n)
        block = np.repeat(own[at:to], n) + (np.arange(n.sum()) - np.repeat(done[at:to] - done[at], n))
        left, mask = _within(values, planes, used, row, block, radius)
        if len(left):
            hit, lane = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            _union(labels, row[left[hit]], lo[block[left[hit]]] + lane)
        at = to
    return labels


def _search(radius: int, words: int, keys: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * keys
        values = np.zeros((0, words), np.uint64)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, values
            if not len(values):
                return
            starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in held], axis=0)])
            cut = len(values) if last else int(starts[-1])  # the last bucket may go on
            if not cut:
                return
            labels = link_buckets(values[:cut], starts[starts < cut], radius)
            linked = np.flatnonzero(labels != np.arange(cut))
            a, b = ([values[k].tobytes() for k in at] for at in (linked, labels[linked]))
            held, values = [c[cut:] for c in held], values[cut:]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            held = [np.r_[h, batch.column(k).to_numpy()] for k, h in enumerate(held)]
            values = np.concatenate([values, _matrix(batch.column(keys), words)])
            if len(values) >= HELD:
                yield from flush(False)
        yield from flush(True)

    return run


def near_links(fps: DataFrame, band: int, bands: int, words: int, radius: int, hot: int = HOT) -> DataFrame:
    """A spanning set of links ``a, b`` between distinct fingerprints that share a band and differ in at most ``radius`` bits.

    Buckets beyond ``hot`` rows are cut into chunks by a hash; every two chunks meet in a task of their own, and so does each chunk
    with itself.
    """
    spread = _spread(fps, band, bands, words)
    large = spread.groupBy("bucket").count().filter(F.col("count") > hot)
    large = cut_lineage(large.select("bucket", F.ceil(F.col("count") / (hot // 2)).cast("long").alias("chunks")))
    usual = spread.join(large, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket")
    links = usual.mapInArrow(_search(radius, words, 1), "a binary, b binary")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    met = spread.join(large, "bucket").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp")
    met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return links.unionByName(met.mapInArrow(_search(radius, words, 3), "a binary, b binary"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row, in all its columns, of each group of near copies.

    Groups are the components of links between texts of about ``similarity`` or more; texts without a word, null ones included, are
    one group. The survivor is chosen by row: the least id (null last), then the least hash of the row. Only rows that are alike
    in all columns (maps excepted) are interchangeable, so runs agree. An empty table gives no rows.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    marks = (F.xxhash64(*plain), F.hash(*plain))  # 96 bits
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("doc_id"), marks[0].alias("h"), marks[1].alias("g"))
    bounded(docs.sparkSession)
    band, bands, words, radius = layout(docs.count(), similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, words, size) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["key", "fp"])

    kind = "struct<unnamed:boolean,doc_id:long,h:long,g:int>"
    marked = docs.select(key.cast(kind).alias("key"), "text").mapInArrow(run, f"key {kind}, fp binary")
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("key").alias("key")))
    # from here on a fingerprint goes by the hash of its bits, so that narrow numbers travel in the rounds
    links = near_links(distinct.select("fp"), band, bands, words, radius)
    named = links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    roots = components(named).withColumnRenamed("node", "n")
    placed = distinct.select(F.xxhash64("fp").alias("n"), "key").join(roots, "n", "left").select(F.coalesce("root", "n").alias("root"), "key")
    first = placed.groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.h").alias("h"), F.col("key.g").alias("g"))
    names = docs.columns
    rows = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("row"), marks[0].alias("h"), marks[1].alias("g"))
    kept = rows.join(first, ["h", "g"], "left_semi").dropDuplicates(["h", "g"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
