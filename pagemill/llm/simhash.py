"""SimHash near-duplicates: fingerprints of word shingles, linked by a bit-sliced search within a Hamming radius.

Candidates: the 64 bits are cut into ``radius + 2`` bands, so two fingerprints within the radius agree on two bands at
least; every pair of bands is a table and rows that agree on both share a bucket. A bucket is compared in blocks of 64
fingerprints that are stored vertically, as one word per bit position: one exclusive-or compares a fingerprint's bit with
64 others, and carry-save counters add up 64 distances at once. A comparison is abandoned as soon as every lane of its
block has passed the radius. Buckets beyond ``HOT`` rows are cut into chunks that meet pairwise in tasks of their own.
A task reports a spanning forest of the links it found, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import bounded, texts
from pagemill.llm.components import components
from pagemill.session import cut_lineage

SEED = 42
HOT = 4096
SLICE = 1 << 16
HELD = 1 << 17


def hash_shingles(text: str, size: int = 4) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words (fewer words: of the whole sequence; no word: nothing)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z is lowered, only ASCII space splits
    if not words:
        return np.zeros(0, np.uint64)
    line, last = b" ".join(words), min(size, len(words)) - 1
    ends = list(accumulate(len(w) + 1 for w in words))
    xx, seed = xxhash.xxh64_intdigest, SEED
    return np.array([xx(line[a : b - 1], seed) for a, b in zip([0, *ends], ends[last:], strict=False)], np.uint64)


def fingerprint(text: str, size: int = 4) -> int:
    """Bit k is set if it is set in over half of the shingle hashes; no word: zero."""
    hashes = hash_shingles(text, size)
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id, fp`` of every document; null and empty texts have the fingerprint zero."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, size) for t in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bands(radius: int) -> list[tuple[int, int]]:
    """First bit and width of each band."""
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def bucket_keys(fp: str, radius: int) -> list:
    """A column per table: the table number above the bits of its two bands."""
    keys = []
    for number, ((a, m), (b, n)) in enumerate(combinations(bands(radius), 2)):
        one = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << m) - 1))
        two = F.shiftrightunsigned(fp, b).bitwiseAND(F.lit((1 << n) - 1))
        keys.append(F.lit(number << 56).bitwiseOR(F.shiftleft(one, 28)).bitwiseOR(two))
    return keys


def _planes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of blocks of at most 64 values: planes[k, b] holds bit k of every lane of block b; lanes in use."""
    planes, used = np.empty((64, len(lo)), np.uint64), np.empty(len(lo), np.uint64)
    lane = np.arange(64)
    for k in range(0, len(lo), 2048):
        part = slice(k, min(k + 2048, len(lo)))
        at = np.minimum(lo[part, None] + lane, hi[part, None] - 1)
        bits = np.unpackbits(values[at].view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
        words = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little")
        planes[:, part] = np.ascontiguousarray(words).view(np.uint64)[:, :, 0]
        lanes = np.packbits(lane < (hi - lo)[part, None], axis=1, bitorder="little")
        used[part] = np.ascontiguousarray(lanes).view(np.uint64)[:, 0]
    return planes, used


def _within(values: np.ndarray, planes: np.ndarray, used: np.ndarray, row: np.ndarray, block: np.ndarray, radius: int):  # noqa: ANN202
    """Comparisons (row, block) with a lane within the radius, and the mask of those lanes."""
    left = np.arange(len(row))
    levels = max(1, radius.bit_length())
    count = np.zeros((levels, len(row)), np.uint64)  # carry-save counter, one word per binary digit and comparison
    over = ~used[block]
    query = values[row]
    for k in range(64):
        carry = planes[k, block] ^ (np.uint64(0) - ((query >> np.uint64(k)) & np.uint64(1)))
        for d in range(levels):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry  # past the digits
        if k % 8 == 7:
            over |= _above(count, radius)
            live = over != ~np.uint64(0)
            if not live.all():  # every lane is past the radius: abandon the comparison
                left, block, query, over, count = left[live], block[live], query[live], over[live], count[:, live]
                if not len(left):
                    break
    return left, ~over


def _above(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose binary counter exceeds the radius, digit by digit from the highest."""
    above = np.zeros(count.shape[1], np.uint64)
    equal = ~above
    for d in range(len(count) - 1, -1, -1):
        if radius >> d & 1:
            equal &= count[d]
        else:
            above |= equal & count[d]
            equal &= ~count[d]
    return above


def _union(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the components of linked rows; a label points to the least row of its component."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further


def link_buckets(values: np.ndarray, bucket_start: np.ndarray, radius: int) -> np.ndarray:
    """Label of every row: the first row of its component within the buckets. ``values`` are grouped by bucket."""
    ends = np.r_[bucket_start[1:], len(values)]
    size = ends - bucket_start
    labels = np.arange(len(values))
    many = size > 1
    bucket_start, ends, size = bucket_start[many], ends[many], size[many]
    if not len(size):
        return labels
    blocks = -(-size // 64)
    first = np.r_[0, np.cumsum(blocks)]
    lo = np.repeat(bucket_start, blocks) + 64 * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    hi = np.minimum(lo + 64, np.repeat(ends, blocks))
    planes, used = _planes(values, lo, hi)
    # each row meets its own block and the later ones of its bucket
    rows = np.repeat(bucket_start, size) + (np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size))
    own = np.repeat(first[:-1], size) + (rows - np.repeat(bucket_start, size)) // 64
    meets = np.repeat(first[1:], size) - own
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


def _search(radius: int, columns: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * (len(columns) + 1)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not len(held[0]):
                return
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in held[:-1]], axis=0)]
            starts = np.flatnonzero(new)
            cut = len(held[0]) if last else int(starts[-1])  # the last bucket may go on
            if not cut:
                return
            values = held[-1][:cut]
            labels = link_buckets(values.view(np.uint64), starts[starts < cut], radius)
            linked = labels != np.arange(cut)
            held = [c[cut:] for c in held]
            yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[labels[linked]])], names=["a", "b"])

        for batch in batches:
            held = [np.r_[h, batch.column(k).to_numpy()] for k, h in enumerate(held)]
            if len(held[0]) >= HELD:
                yield from flush(False)
        yield from flush(True)

    return run


def near_links(fps: DataFrame, radius: int = 4, hot: int = HOT) -> DataFrame:
    """A spanning set of links ``a, b`` between distinct fingerprints (``fp``) at most ``radius`` bits apart."""
    spread = fps.select(F.explode(F.array(*bucket_keys("fp", radius))).alias("bucket"), "fp")
    large = spread.groupBy("bucket").count().filter(F.col("count") > hot)
    large = large.select("bucket", F.ceil(F.col("count") / (hot // 2)).cast("long").alias("chunks"))
    usual = spread.join(large, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket", "fp")
    links = usual.mapInArrow(_search(radius, ["bucket"]), "a long, b long")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    met = spread.join(large, "bucket").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.filter(F.col("chunk") != F.col("other")).select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp")
    met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "fp")
    return links.unionByName(met.mapInArrow(_search(radius, ["bucket", "i", "j"]), "a long, b long"))


def one_of_each(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """One row, in all its columns, of each component of ``near_duplicates``; rows without an id join their groups.

    The survivor is chosen by row, not by id: the least id (null last), then the least hash of the row. Only rows that are alike in
    all columns (maps excepted) are interchangeable, so runs agree.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    marks = (F.xxhash64(*plain), F.hash(*plain))  # 96 bits
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("doc_id"), marks[0].alias("h"), marks[1].alias("g"))
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, size) for t in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["key", "fp"])

    kind = "struct<unnamed:boolean,doc_id:long,h:long,g:int>"
    marked = docs.select(key.cast(kind).alias("key"), "text").mapInArrow(run, f"key {kind}, fp long")
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("key").alias("key")))
    roots = components(near_links(distinct.select("fp"), radius))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "key")
    first = placed.groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.h").alias("h"), F.col("key.g").alias("g"))
    names = docs.columns
    rows = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("row"), marks[0].alias("h"), marks[1].alias("g"))
    kept = rows.join(first, ["h", "g"], "left_semi").dropDuplicates(["h", "g"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    The component is named by its least ``doc_id``; it spans all documents reachable over links of at most ``radius`` bits.
    Null and empty texts share the fingerprint zero and are linked like any other. A null id is kept and never names a
    component unless it is alone. Repeated rows come back as often as they occur. An empty table gives no rows.
    """
    marked = cut_lineage(fingerprints(docs, size))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp"), radius))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.join(named, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
