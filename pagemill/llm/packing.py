"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Every document is encoded, closed with the end id and, if longer than a sequence, cut into full pieces from its end, so
that its first piece may be shorter. Full pieces are sequences of their own. The others are dealt evenly into groups of
bounded size; each group is packed best-fit decreasing, then underfull bins trade pieces: a move, a one-for-one or a
two-for-one exchange is made when it raises the sum of squared fills, until bins come out empty and vanish. Bins that stay
underfull are dissolved once more and repacked together in far fewer groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import bounded, select
from pagemill.llm.tokens import encoder
from pagemill.session import cut_lineage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", group int, bin int, offset long, fill long"
GROUP_PIECES = 8192
STUCK_BINS = 24
ROUNDS_PER_PIECE = 4


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, remember: bool = True) -> DataFrame:
    """One row per piece of every document: ``doc_id, piece, start, length, ids_crc32``.

    ``remember`` keeps the words met for the next task of a worker; without it a task ends as small as it began.

    Null texts count as empty: one piece that holds the end id. Null and repeated ``doc_id`` are kept as they are.
    """
    bounded(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                lo, k = 0, 0
                while lo < n:
                    hi = first if k == 0 else lo + capacity
                    for column, value in zip(rows, (doc, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])), strict=True):
                        column.append(value)
                    lo, k = hi, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)
        if not remember:
            enc.forget()

    return select(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every piece, longest first, each into the fullest bin that still takes it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free, at = 0, np.zeros(len(lengths), np.int64)  # bit r of free: some bin has r free
    bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = free >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            b, r, bins = bins, capacity, bins + 1
        at[i] = b
        left = r - need
        if left:
            room[left].append(b)
            free |= 1 << left
    return at


def local_search(lengths: np.ndarray, at: np.ndarray, capacity: int) -> np.ndarray:
    """Trade pieces between underfull bins as long as the sum of squared fills rises; empty bins vanish.

    Every step moves fill from the emptiest bin into a fuller one. A bin that no step improves is set aside; the search ends
    at the least possible number of bins, after ``STUCK_BINS`` bins set aside, or after a number of steps in proportion to
    the pieces.
    """
    lengths, at = lengths.astype(np.int64), at.copy()
    fill = np.bincount(at, lengths, minlength=at.max(initial=-1) + 1).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    stuck: set[int] = set()
    for _ in range(ROUNDS_PER_PIECE * len(lengths)):
        live = np.flatnonzero(fill > 0)
        if len(live) <= least or len(stuck) >= STUCK_BINS:
            break
        open_bins = [b for b in live[np.argsort(fill[live], kind="stable")].tolist() if b not in stuck and fill[b] < capacity]
        if len(open_bins) < 2:
            break
        t = open_bins[0]
        if not _improve(lengths, at, fill, t, capacity):
            stuck.add(t)
    return at


def _improve(lengths: np.ndarray, at: np.ndarray, fill: np.ndarray, t: int, capacity: int) -> bool:
    """One step that takes fill out of bin ``t``: a move, else a one-for-one, else a two-for-one exchange."""
    mine = np.flatnonzero(at == t)
    mine = mine[np.argsort(-lengths[mine], kind="stable")]
    room = capacity - fill
    for i in mine.tolist():
        ok = np.flatnonzero((room >= lengths[i]) & (fill >= fill[t] - lengths[i]) & (fill > 0))
        ok = ok[ok != t]
        if len(ok):
            _move(lengths, at, fill, i, int(ok[np.argmin(room[ok])]))
            return True
    free = room[at]  # of the bin that holds each piece
    others = np.flatnonzero((at != t) & (free > 0))
    if not len(others):
        return False
    size, gap, full = lengths[others], free[others], fill[at[others]]
    for i in mine.tolist():  # one for one: a longer piece out, a shorter one in
        gain = lengths[i] - size
        ok = np.flatnonzero((gain > 0) & (gain <= gap) & (full + gain > fill[t] - gain))
        if len(ok):
            j = int(others[ok[np.argmax(gain[ok])]])
            b = int(at[j])
            _move(lengths, at, fill, i, b)
            _move(lengths, at, fill, j, t)
            return True
    for a in range(len(mine)):  # two pieces out, one in
        for b in range(a + 1, min(len(mine), a + 24)):
            gain = lengths[mine[a]] + lengths[mine[b]] - size
            ok = np.flatnonzero((gain > 0) & (gain <= gap) & (full + gain > fill[t] - gain))
            if len(ok):
                j = int(others[ok[np.argmax(gain[ok])]])
                to = int(at[j])
                for i in (int(mine[a]), int(mine[b])):
                    _move(lengths, at, fill, i, to)
                _move(lengths, at, fill, j, t)
                return True
    return False


def _move(lengths: np.ndarray, at: np.ndarray, fill: np.ndarray, i: int, b: int) -> None:
    fill[at[i]] -= lengths[i]
    fill[b] += lengths[i]
    at[i] = b


def _pack_group(capacity: int, names: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        group = context.partitionId() if context else 0
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        lengths = table.column("length").to_numpy().astype(np.int64)
        at = local_search(lengths, best_fit(lengths, capacity), capacity)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
        base = np.repeat(starts[first], np.diff(np.r_[first, len(order)]))
        fill = np.bincount(at, lengths).astype(np.int64)
        out = table.take(pa.array(order))
        columns = [out.column(n) for n in names]
        columns += [
            pa.array(np.full(len(order), group), pa.int32()), pa.array(at[order], pa.int32()),
            pa.array(starts - base, pa.int64()), pa.array(fill[at[order]], pa.int64()),
        ]
        packed = pa.Table.from_arrays(columns, names=[*names, "group", "bin", "offset", "fill"])
        yield from packed.combine_chunks().to_batches(max_chunksize=20_000)

    return run


def pack(pieces: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens.

    ``pieces`` (``doc_id, piece, start, length, ids_crc32``) is read more than once and should be cheap to read again. Groups
    hold about ``group_pieces`` pieces whatever the keys are, so no hot document or source makes a large group.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    full = pieces.filter(F.col("length") >= capacity).select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    first = cut_lineage(rest.repartition(groups).mapInArrow(_pack_group(capacity, names), PLACED))
    whole = F.col("fill") >= capacity - F.lit(1)  # nothing fits into such a bin any more
    again = first.filter(~whole).select(*names).repartition(groups // 64 + 1)
    second = again.mapInArrow(_pack_group(capacity, names), PLACED)

    def named(df: DataFrame, step: int) -> DataFrame:
        number = (F.col("group").cast("long") * F.lit(2**32) + F.col("bin")) * 2 + F.lit(step)
        return df.select(*names, number.alias("sequence_id"), "offset")

    return full.unionByName(named(first.filter(whole), 0)).unionByName(named(second, 1))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, remember: bool = True) -> DataFrame:
    """Pack whole documents: one row per piece with ``sequence_id`` and ``offset``.

    Null or empty texts give a piece of one token. An empty table gives no rows. Repeated rows are packed as often as they
    occur. Other columns are ignored, whatever their names.
    """
    return pack(cut_lineage(cut_pieces(docs, tokenizer, end_id, capacity, remember)), capacity)
