"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

Texts are lower-cased and white space is folded. A benchmark item is cut into overlapping segments. A region of a document
within k edits of a segment of m characters shares at least m - q + 1 - kq of its q-grams, and their diagonals (place in the
text minus place in the segment) differ by at most k from one another. So shared q-grams are counted in overlapping bands of
diagonals, each twice as wide as needed; bands that reach the bound are aligned with the segment inside the band, and the
region is reported if the alignment needs at most k edits. Items below 20 characters must occur exactly, as whole words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import bounded, texts

Q = 7
SEGMENT = 120
EDIT_SHARE = 0.12
LEAST_CHARS = 20
BLOCK_BYTES = 4 * 1024 * 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
CELLS = 1 << 22
RARE = 6


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(code: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each place, mixed. Characters are folded to a byte, so that a q-gram of 7 is one masked word;
    equal characters stay equal, so no shared q-gram is missed."""
    n = len(code) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    folded = np.append((code ^ (code >> np.uint32(8))).astype(np.uint8), np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.as_strided(folded, (n, 8), (1, 1))
    h = (np.ascontiguousarray(words).view("<u8")[:, 0] & np.uint64((1 << 8 * Q) - 1)) * _MIX
    return h ^ (h >> np.uint64(32))


@dataclass
class Index:
    """q-grams of a bounded block of benchmark segments."""

    items: list
    item: np.ndarray  # item of each segment
    segment: list[str]
    budget: np.ndarray  # edits allowed
    bound: np.ndarray  # q-grams that must be shared
    keys: np.ndarray
    first: np.ndarray  # entries of each key
    entry_segment: np.ndarray
    entry_place: np.ndarray
    rare_first: np.ndarray  # the same without the commonest places of each segment
    rare_segment: np.ndarray
    rare_bound: np.ndarray
    maybe: np.ndarray


def edit_budget(length: int, edit_share: float = EDIT_SHARE) -> int:
    """Edits allowed for a segment: the share, or less where the q-gram bound would vanish."""
    return max(0, min(int(length * edit_share), (length - Q) // Q))


def build_index(rows: list[tuple], edit_share: float = EDIT_SHARE) -> Index:
    """``rows`` are (item_id, text); texts under LEAST_CHARS characters have no edits, those under Q have no q-gram and are left out."""
    items, item, segment = [], [], []
    for name, text in rows:
        whole = normal(text or "")
        if len(whole) < Q:
            continue
        starts = [0] if len(whole) <= SEGMENT else sorted({*range(0, len(whole) - SEGMENT, SEGMENT // 2), len(whole) - SEGMENT})
        segment += [whole[s : s + SEGMENT] for s in starts]
        item += [len(items)] * len(starts)
        items.append(name)
    budget = np.array([edit_budget(len(s), edit_share) if len(s) >= LEAST_CHARS else 0 for s in segment], np.int64)
    bound = np.array([len(s) - Q + 1 for s in segment], np.int64) - Q * budget
    hashed = [grams(codes(s)) for s in segment]
    key = np.concatenate([*hashed, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(segment)), [len(h) for h in hashed])
    place = np.concatenate([*[np.arange(len(h)) for h in hashed], np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    first, owner = np.r_[first, len(key)], owner[order].astype(np.int32)
    often = np.repeat(np.diff(first), np.diff(first))  # places in all segments that hold the q-gram
    rank = np.lexsort((-often, owner))
    within = np.arange(len(rank)) - np.searchsorted(owner[rank], owner[rank])
    skipped = np.maximum(bound - RARE, 0)
    rare = np.ones(len(key), bool)
    rare[rank[within < skipped[owner[rank]]]] = False
    rare_first = np.r_[0, np.cumsum(rare)][first]
    return Index(items, np.array(item, np.int64), segment, budget, bound, keys, first, owner, place[order], rare_first, owner[rare], bound - skipped, maybe)


def align(text: str, segment: str, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the best region of ``text`` for the segment, or None beyond the budget.

    One row of the table per character of the segment; the start and the end in the text are free. The caller's text is the
    band, so a row has few cells; the row is computed at once, its left-to-right dependence by a running minimum.
    """
    at = text.find(segment)
    if at >= 0:
        return 0, at, at + len(segment)
    t, n = codes(text), len(text)
    column = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), column.copy()
    for i, c in enumerate(codes(segment), 1):
        diagonal = np.r_[i, row[:-1] + (t != c)]
        up = row + 1
        new = np.where(diagonal <= up, diagonal, up)
        origin = np.where(diagonal <= up, np.r_[0, start[:-1]], start)
        lowest = np.minimum.accumulate((new - column) * (n + 1) + column)  # value, then the cell it comes from
        source = lowest % (n + 1)
        row, start = (lowest - source) // (n + 1) + column, origin[source]
    end = int(row.argmin())
    return (int(row[end]), int(start[end]), end) if row[end] <= budget else None


#: Scripts that put no space between words, by ranges of code points.
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _joins(a: str, b: str) -> bool:
    """Whether two neighbouring characters lie within one word."""
    spaced = lambda c: c.isalnum() and not any(lo <= ord(c) <= hi for lo, hi in UNSPACED)
    return spaced(a) and spaced(b)


def whole_words(text: str, item: str, lo: int, hi: int) -> tuple[int, int, int] | None:
    """(0, start, stop) of the first exact occurrence of ``item`` inside ``text[lo:hi]`` that cuts no word of ``text``."""
    at = text.find(item, lo, hi)
    while at >= 0:
        end = at + len(item)
        if not (at and _joins(text[at - 1], item[0])) and not (end < len(text) and _joins(item[-1], text[end])):
            return 0, at, end
        at = text.find(item, at + 1, hi)
    return None


def least_edits(text: str, segment: str) -> int:
    """Edits of the best region, by Myers' bit-parallel columns: one whole-number word holds a column of the table."""
    where: dict[str, int] = {}
    for i, c in enumerate(segment):
        where[c] = where.get(c, 0) | 1 << i
    m = len(segment)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = where.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp, hn = down | ~(d0 | up) & full, up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best = score
        hp, hn = hp << 1 & full, hn << 1 & full
        up, down = hn | ~(d0 | hp) & full, hp & d0
    return best


def _entries(first: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of each key in a row, and how many each has."""
    count = (first[key + 1] - first[key]).astype(np.int32)
    return np.repeat((first[key] - np.cumsum(count) + count).astype(np.int32), count) + np.arange(count.sum(), dtype=np.int32), count


def find(batch: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, stop, edits) of the best region per text and item; places are in the normalized text."""
    if not len(index.keys):
        return []
    step = max(1, CELLS // len(index.segment))
    if len(batch) > step:  # the table of texts and segments below stays bounded
        return [(k + r, *rest) for k in range(0, len(batch), step) for r, *rest in find(batch[k : k + step], index)]
    clean = [normal(t) for t in batch]
    gap = "\0" * Q  # no q-gram of a segment reaches over it
    size = np.array([len(c) + Q for c in clean], np.int64)
    begin = np.cumsum(size) - size
    h = grams(codes(gap.join(clean) + gap))
    at = np.flatnonzero(index.maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    key = np.searchsorted(index.keys, h[at])
    key[key == len(index.keys)] = 0
    real = index.keys[key] == h[at]
    at, key = at[real], key[real]
    row = (np.searchsorted(begin, at, "right") - 1).astype(np.int32)
    base = row * np.int32(len(index.segment))
    # first without the commonest q-grams of each segment, which lowers the bound by as many; few texts are left
    entry, count = _entries(index.rare_first, key)
    shared = np.bincount(np.repeat(base, count) + index.rare_segment[entry], minlength=len(batch) * len(index.segment))
    may = shared.reshape(len(batch), -1) >= index.rare_bound
    some = may.any(1)[row]
    at, key, base = at[some], key[some], base[some]
    entry, count = _entries(index.first, key)
    cell = np.repeat(base, count) + index.entry_segment[entry]
    enough = np.flatnonzero(may.ravel()[cell])
    entry, place, cell = entry[enough], np.repeat(at, count)[enough], cell[enough].astype(np.int64)
    row, segment = cell // len(index.segment), cell % len(index.segment)
    width = 2 * index.budget[segment] + 1
    most = int(size.max()) + SEGMENT
    band = (place - begin[row] - index.entry_place[entry] + SEGMENT * 2) // width  # from 0 on
    pairs = (row * len(index.segment) + segment) * (most + 2 * SEGMENT + 2)
    # each in a band and the half before it; a place of the segment counts once in a band, however often the text repeats
    seen = np.sort(np.r_[pairs + band, pairs + band + 1] * SEGMENT + np.tile(index.entry_place[entry], 2))
    seen = seen[np.r_[True, seen[1:] != seen[:-1]]] // SEGMENT if len(seen) else seen
    new = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]]) if len(seen) else np.zeros(0, np.int64)
    bands, shared = seen[new], np.diff(np.r_[new, len(seen)])
    segment = bands // (most + 2 * SEGMENT + 2) % len(index.segment)
    enough = shared >= index.bound[segment]
    bands, segment = bands[enough], segment[enough]
    row, band = bands // (most + 2 * SEGMENT + 2) // len(index.segment), bands % (most + 2 * SEGMENT + 2)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, s, b in zip(row.tolist(), segment.tolist(), band.tolist(), strict=True):
        k, wide, pattern = int(index.budget[s]), int(2 * index.budget[s] + 1), index.segment[s]
        low = (b - 1) * wide - 2 * SEGMENT  # the band spans diagonals [low, low + 2 wide)
        lo, hi = max(0, low - k), max(0, low + 2 * wide + len(pattern) + k)
        key = (r, int(index.item[s]))
        if len(pattern) < LEAST_CHARS:
            if key not in best and (exact := whole_words(clean[r], pattern, lo, hi)):  # bands go from left to right
                best[key] = exact
            continue
        region = clean[r][lo:hi]
        found = align(region, pattern, k) if pattern in region or least_edits(region, pattern) <= k else None
        if found:
            best[key] = min(best.get(key, (1 << 30, 0, 0)), (found[0], lo + found[1], lo + found[2]))
    return [(r, i, start, stop, edits) for (r, i), (edits, start, stop) in sorted(best.items())]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about ``block_bytes`` bytes of text, so that what is broadcast stays bounded."""
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-int(total) // block_bytes))
    for k in range(count):
        part = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in part.distinct().collect()), key=repr)


LEAKS = "doc_id long, item_id long, start long, stop long, edits long"


def leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """``doc_id, item_id, start, stop, edits``: one row per document and benchmark item found in it, the best region of it.

    Places are in the lower-cased text with folded white space. All of every text is searched. Null and empty texts hold
    nothing; repeated rows are reported as often as they occur; null ids are carried. Items of 7 to 19 characters must
    occur exactly, as whole words; shorter ones are ignored; an empty benchmark or table gives no rows. Each block of the benchmark is one pass over the documents.
    """
    context = bounded(docs.sparkSession).sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks(benchmark):
        held = context.broadcast(build_index(block, edit_share))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), find(texts(batch.column(1)), held.value)
                columns = [[ids[f[0]] for f in found], [held.value.items[f[1]] for f in found], *[[f[k] for f in found] for k in (2, 3, 4)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "stop", "edits"])

        part = rows.mapInArrow(run, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """The rows, in all their columns, whose text holds no benchmark item."""
    context = bounded(docs.sparkSession).sparkContext
    at = docs.columns.index("text")
    for block in blocks(benchmark):
        held = context.broadcast(build_index(block, edit_share))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in find(texts(batch.column(at)), held.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
