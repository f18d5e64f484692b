"""Removal of repeated byte strings with a sparse suffix array.

A byte goes if a string of WIDTH bytes that covers it also starts anywhere else. Not every suffix is sorted: each window of
WIDTH bytes chooses an anchor in it, the leftmost of its grams of GRAM bytes with the least hash, so that equal windows choose the same
place. Only suffixes at anchors travel:

1. Anchors (gram hash, hash of the bytes around, text, place) are range-partitioned by sampled splitters and sorted. Grams
   that occur once end here. Anchors whose whole surroundings occur again are covered as they are; of these one per class,
   and every anchor whose surroundings are its own, go on as probes. A run that touches the border of a partition or chunk counts as going on.
2. Probes fetch the bytes around them. Suffixes are range-partitioned by their leading bytes; a bucket is sorted by multikey
   quicksort on 8-byte words, forwards from the anchor and backwards before it, and neighbours give common lengths.
   A window that starts j bytes before the anchor occurs again if another anchor shares j bytes to the left
   and WIDTH - j to the right: classes of both orders, read off the common lengths, decide this for every j.
3. Grams with very many probes would make one large bucket. Their windows are counted instead by 128-bit hashes, summed inside
   map tasks first.

Texts that occur several times are one text here; they are covered whole if they are long enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import bounded, flat
from pagemill.session import cut_lineage

WIDTH = 200
GRAM = 48
HOT = 8192
CHUNK = 200_000
BUCKET_ROWS = 20_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MOST = ~np.uint64(0)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes from each place; ``gram`` is a multiple of 8."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    h = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        part = np.ascontiguousarray(words[k : k + n]).view(np.uint64)[:, 0]
        h = (h ^ part) * _A
        h ^= h >> np.uint64(29)
    return (h * _B) ^ (h >> np.uint64(31))


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors in the flat bytes, their texts and gram hashes."""
    h = gram_hashes(data, gram)
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, np.zeros(0, np.uint64)
    key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, need = 1, width - gram + 1
    while 2 * span <= need:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if span < need:
        key = np.minimum(key[: len(key) - (need - span)], key[need - span :])
    size = np.diff(offsets)
    windows = np.maximum(size - width + 1, 0)
    start = np.repeat(offsets[:-1] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    if not len(start):
        return none, none, np.zeros(0, np.uint64)
    place = (key[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = place[np.r_[True, place[1:] != place[:-1]]]
    return place, np.searchsorted(offsets, place, "right") - 1, h[place]


def _anchor_rows(width: int, gram: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            key = batch.column(0).to_numpy()
            fresh = []
            for k in key.tolist():  # a text that this task has met says nothing new
                fresh.append(k not in seen)
                seen.add(k)
            if not any(fresh):
                continue
            key, column = key[fresh], batch.column(1).filter(pa.array(fresh))
            data, offsets = flat(column)
            place, row, h = anchors(data, offsets, width, gram)
            lo = np.maximum(offsets[row], place - (width - gram))
            hi = np.minimum(offsets[row + 1], place + width)
            raw, digest = memoryview(data.tobytes()), xxhash.xxh3_64_intdigest
            around = np.array([digest(raw[a:b], b - c) for a, b, c in zip(lo.tolist(), hi.tolist(), place.tolist(), strict=True)], np.uint64)
            columns = [h.view(np.int64), around.view(np.int64), key[row], (place - offsets[row]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "around", "k", "pos"])

    return run


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted anchors to rows (h, k, pos, full): covered anchors and probes; what occurs once is left out."""

    def sift(h: np.ndarray, around: np.ndarray, k: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        first = np.r_[True, (h[1:] != h[:-1]) | (around[1:] != around[:-1]) | (k[1:] != k[:-1]) | (pos[1:] != pos[:-1])]
        h, around, k, pos = h[first], around[first], k[first], pos[first]  # copies of one text
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_class = new_h | np.r_[True, around[1:] != around[:-1]]
        run, kind = np.cumsum(new_h) - 1, np.cumsum(new_class) - 1
        in_run, in_class = np.bincount(run)[run], np.bincount(kind)[kind]
        classes = np.bincount(run[new_class])[run]
        border = (run == 0) | (run == run[-1])
        full = in_class > 1
        probe = new_class & ((classes > 1) | border) | ((in_run > 1) & ~full)
        rows = [(full, True), (probe, False)]
        columns = [np.concatenate([c[m] for m, _ in rows]) for c in (h, k, pos)]
        flag = np.concatenate([np.full(int(m.sum()), f) for m, f in rows])
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(flag)], names=["h", "k", "pos", "full"])

    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= CHUNK:
            yield sift(*[np.concatenate(c) for c in zip(*held, strict=True)])
            held, size = [], 0
    if size:
        yield sift(*[np.concatenate(c) for c in zip(*held, strict=True)])


def multikey_sort(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexical order of padded byte rows, and the bytes that each shares with the one before it.

    Multikey quicksort on 8-byte words: rows are split by a word, and only rows that still tie are split by the next one.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    group = np.cumsum(np.r_[True, words[order[1:], 0] != words[order[:-1], 0]]) - 1
    for depth in range(1, words.shape[1] + 1):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = words[:, depth] if depth < words.shape[1] else length.astype(np.uint64)  # of equal bytes the shorter first
        rows_tied = order[tied]
        inner = np.lexsort((key[rows_tied], group[tied]))
        order[tied] = rows_tied[inner]
        split = np.r_[False, (key[order[1:]] != key[order[:-1]])]
        group = np.cumsum(np.r_[True, group[1:] != group[:-1]] | split) - 1
    shared = np.zeros(n, np.int64)
    for k in range(1, n, 8192):
        a, b = order[k : k + 8192], order[k - 1 : min(n, k + 8192) - 1]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(1), differ.argmax(1), width)
        shared[k : k + 8192] = np.minimum(first, np.minimum(length[a], length[b]))
    return order, shared


def repeated_windows(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor the least and the greatest j such that the window that starts j bytes before it occurs at another anchor.

    ``left`` holds the bytes before the anchor in reverse. The greatest is -1 if no window does.
    """
    n = len(left)
    least, most = np.full(n, width), np.full(n, -1)
    order_r, shared_r = multikey_sort(right, right_size)
    order_l, shared_l = multikey_sort(left, left_size)
    for j in range(left.shape[1] + 1):
        able = np.flatnonzero((left_size >= j) & (right_size >= width - j))
        if len(able) < 2:
            continue
        class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
        class_r[order_r] = np.cumsum(shared_r < width - j)
        class_l[order_l] = np.cumsum(shared_l < j)
        both = class_r[able] * (n + 1) + class_l[able]
        _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        hit = able[count[inverse] > 1]
        least[hit] = np.minimum(least[hit], j)
        most[hit] = j
    return least, most


def _matrix(column: pa.Array, width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    out[row, (size[row] - 1 - at) if backwards else at] = data
    return out, size


CONTEXT = "h long, k long, pos int, hot boolean, before binary, after binary"
COVER = "k long, lo long, hi long"


def _contexts(width: int, gram: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            raw = data.tobytes()
            probes = batch.column(2)
            inner = probes.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(probes.offsets.to_numpy()))
            h, pos, hot = (inner.field(c) for c in range(3))
            at = pos.to_numpy() + offsets[row]
            lo, hi = np.maximum(offsets[row], at - (width - gram)), np.minimum(offsets[row + 1], at + width)
            before = pa.array([raw[a:b] for a, b in zip(lo.tolist(), at.tolist(), strict=True)], pa.binary())
            after = pa.array([raw[a:b] for a, b in zip(at.tolist(), hi.tolist(), strict=True)], pa.binary())
            columns = [h, pa.array(batch.column(0).to_numpy()[row]), pos, hot, before, after]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CONTEXT.split(", ")])

    return run


def _buckets(width: int, gram: int):  # noqa: ANN202
    """Sorted contexts, whole grams at a time, to covered ranges."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        k, pos = table.column("k").to_numpy(), table.column("pos").to_numpy().astype(np.int64)
        _, once = np.unique(np.stack([k, pos]), axis=1, return_index=True)
        table = table.take(pa.array(once)).combine_chunks()
        k, pos = k[once], pos[once]
        left = _matrix(table.column("before").chunk(0), width - gram, backwards=True)
        right = _matrix(table.column("after").chunk(0), width)
        least, most = repeated_windows(*left, *right, width)
        hit = most >= 0
        columns = [k[hit], pos[hit] - most[hit], pos[hit] - least[hit] + width]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows >= BUCKET_ROWS:
                h = held.column("h").to_numpy()
                last = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0  # the last gram may go on
                if last:
                    yield solve(held.slice(0, last))
                    held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _window_hashes(width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, pos, before, after in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                whole = before + after
                for s in range(len(whole) - width + 1):
                    d = xxhash.xxh3_128_digest(whole[s : s + width])
                    rows.append((d, k, pos, len(before) - s))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["d", "k", "pos", "j"])

    return run


def _hot_cover(contexts: DataFrame, width: int) -> DataFrame:
    """Covered ranges of grams with very many probes, by counting their windows."""
    once = contexts.filter("hot").select("k", "pos", "before", "after").dropDuplicates(["k", "pos"])
    windows = once.mapInArrow(_window_hashes(width), "d binary, k long, pos int, j int")
    start = F.struct("k", (F.col("pos") - F.col("j")).alias("s"))  # one window may hold several hot grams
    many = windows.groupBy("d").agg(F.min(start).alias("a"), F.max(start).alias("b")).filter("a != b").select("d")
    hit = windows.join(many, "d", "left_semi").groupBy("k", "pos").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    at = F.col("pos").cast("long")
    return hit.select("k", (at - F.col("b")).alias("lo"), (at - F.col("a") + width).alias("hi"))


def cover(keyed: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Covered ranges ``k, lo, hi`` of texts (``k, size, text``), overlapping ones included."""
    found = keyed.filter(F.col("size") >= width).select("k", "text").mapInArrow(_anchor_rows(width, gram), "h long, around long, k long, pos int")
    ordered = found.repartitionByRange("h", "around", "k", "pos").sortWithinPartitions("h", "around", "k", "pos")
    sifted = cut_lineage(ordered.mapInArrow(_sift, "h long, k long, pos int, full boolean"))
    at = F.col("pos").cast("long")
    full = sifted.filter("full").select("k", F.greatest(at - (width - gram), F.lit(0)).alias("lo"), (at + width).alias("hi"))
    probes = sifted.filter(~F.col("full")).select("h", "k", "pos")
    frequent = probes.groupBy("h").count().filter(F.col("count") > hot).select("h", F.lit(True).alias("hot"))
    marked = probes.join(frequent, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    per_text = marked.groupBy("k").agg(F.collect_list(F.struct("h", "pos", "hot")).alias("probes"))
    bytes_of = keyed.filter(F.col("size") >= width).select("k", "text").mapInArrow(_once, "k long, text string")
    contexts = cut_lineage(bytes_of.join(per_text, "k").select("k", "text", "probes").mapInArrow(_contexts(width, gram), CONTEXT))
    lead = F.substring("after", 1, gram)
    usual = contexts.filter(~F.col("hot")).withColumn("lead", lead).repartitionByRange("lead").sortWithinPartitions("lead", "h", "k", "pos").drop("lead")
    sorted_cover = usual.mapInArrow(_buckets(width, gram), COVER)
    copies = keyed.filter(F.col("size") >= width).groupBy("k", "size").count().filter("count > 1")
    whole = copies.select("k", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))
    return full.unionByName(sorted_cover).unionByName(_hot_cover(contexts, width)).unionByName(whole)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text and task."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for k in batch.column(0).to_pylist():
            fresh.append(k not in seen)
            seen.add(k)
        yield batch.filter(pa.array(fresh, pa.bool_()))


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_ranges(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs and the bytes that stay."""
    runs: list[list[int]] = []
    for lo, hi in sorted(ranges):
        hi = min(hi, len(raw))
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        elif lo < hi:
            runs.append([lo, hi])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(raw[at:lo])
        at = hi
    return [tuple(r) for r in runs], b"".join([*kept, raw[at:]])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        raw, at = data.tobytes(), offsets.tolist()
        rows: list[tuple] = []
        for k, ranges in enumerate(batch.column(2).to_pylist()):
            text = raw[at[k] : at[k + 1]]
            runs, kept = cut_ranges(text, [(r["lo"], r["hi"]) for r in ranges or []])
            rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        arrays = [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]]
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in OUT.split(", ")])


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    Texts are UTF-8 bytes; null counts as empty. Matches never cross documents. A text is known by a 64-bit hash and its
    length. Repeated rows are copies of each other and are removed if they have ``width`` bytes; null ids are kept; further
    columns are ignored; an empty table gives no rows. ``gram`` is a multiple of 8 below ``width``.
    """
    bounded(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("k"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    ranges = cover(keyed, width, gram, hot).groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return keyed.join(ranges, "k", "left").select("doc_id", "text", "ranges").mapInArrow(_removed, OUT)
