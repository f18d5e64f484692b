"""Hard negatives by full exact scores, scored the Four-Russians way.

Components become integers. Of every anchor, the sums of all subsets of eight neighbouring components are tabled (256 entries
for each group of eight). A candidate is kept as bit planes in two's complement: for every plane and group one byte. That byte
indexes the table, the lookups of a plane are added over the groups, and the planes are added with doubling, the sign plane
negative: the exact inner product, without a multiplication.

Candidates and anchors are written as blocks to the shared folder. A task takes one block of anchors and a share of the
candidate blocks, streams them, and keeps a few best rows per anchor; shares are merged by a window over those few rows. So
memory is bounded by the block sizes, candidates are never shuffled, and what is shuffled grows with the anchors only.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import shared
from pagemill.llm.batches import bounded
from pagemill.session import cut_lineage

SCALE = 256
ANCHOR_STEP = 50
POSITIVES = 5
NEGATIVES = 3
#: Bounds of memory: rows of a block of candidates or anchors, and scores that are worked on together.
BLOCK_ROWS = 65_536
ANCHOR_ROWS = 1024
TILE_ROWS = 256
#: Tasks per core that the scoring passes are cut into, as far as there are blocks.
TASKS_PER_CORE = 4


# --- scores -------------------------------------------------------------------------------------------------------
def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """Planes of an integer matrix in two's complement, as [plane, row, group] bytes: as many planes as the values need."""
    rows, dims = vectors.shape
    low, high = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
    planes = 1 + max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0)
    groups = -(-dims // 8)
    wide = np.zeros((rows, groups * 8), np.int64)
    wide[:, :dims] = vectors
    out = np.empty((planes, rows, groups), np.uint8)
    for p in range(planes):
        out[p] = np.packbits((wide >> p & 1).astype(np.uint8).reshape(rows, groups, 8), axis=2, bitorder="little")[:, :, 0]
    return out


class SubsetSums:
    """Tables of a block of anchors: [group, byte, anchor]."""

    def __init__(self, anchors: np.ndarray) -> None:
        rows, dims = anchors.shape
        groups = -(-dims // 8)
        wide = np.zeros((groups * 8, rows), np.int64)
        wide[:dims] = anchors.T
        most = [sum(map(abs, row)) for row in anchors.tolist()]  # exact: of no partial sum the size exceeds this
        self.most = max(most, default=0)
        self.kind = np.int16 if self.most < 1 << 15 else np.int32 if self.most < 1 << 31 else np.int64
        self.tables = np.zeros((groups, 256, rows), self.kind)
        for g in range(groups):
            for bit in range(8):
                self.tables[g, 1 << bit : 2 << bit] = self.tables[g, : 1 << bit] + wide[8 * g + bit].astype(self.kind)

    def scores(self, planes: np.ndarray) -> np.ndarray:
        """Inner products of candidates (bit planes) and all anchors of the block: [candidate, anchor]. Where the two differ
        in length the shorter one counts as filled up with zeros; sums beyond a long wrap."""
        count, rows, groups = planes.shape
        size = self.most << (count - 1)
        total = np.zeros((rows, self.tables.shape[2]), np.int32 if size < 1 << 31 else np.int64)
        plane = np.empty(total.shape, self.kind)
        lookup = np.empty(total.shape, self.kind)
        for p in reversed(range(count)):
            plane[:] = 0
            for g in range(min(groups, len(self.tables))):
                np.take(self.tables[g], planes[p, :, g], axis=0, out=lookup, mode="clip")
                plane += lookup
            if p == count - 1:
                total -= plane
            else:
                total <<= 1
                total += plane
        return total


# --- blocks -------------------------------------------------------------------------------------------------------
BLOCK = "path string, n long"
_LIST = pa.large_list(pa.int64())


def usable(table: DataFrame, relabel_step: int = 7, classes: int = 10) -> DataFrame:
    """``vec_id, label, vector`` (long array) of the rows that take part: no null id, label, vector or component, no component
    that is not finite. Where the id is divisible by ``relabel_step`` the label first becomes (label + 1) % ``classes``."""
    vector = F.col("embedding")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    given = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % relabel_step == 0, (given + 1) % classes).otherwise(given)
    kept = table.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & whole)
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * float(SCALE)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), ints.alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    lists = column.cast(_LIST)
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    sizes, first = np.diff(ends), ends[0]
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - first, sizes)] = flat
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    wide = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])


def _put(path: str, **arrays: np.ndarray) -> None:
    data = io.BytesIO()
    np.savez(data, **arrays)
    shared.put(path, [data.getvalue()])


def _get(path: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(shared.get(path))) as data:
        return {k: data[k] for k in data.files}


def write_blocks(rows: DataFrame, folder: str, name: str, block_rows: int, planes: bool) -> DataFrame:
    """Write ``vec_id, label, vector`` rows as blocks, in ascending id inside a block; one row (path, rows) per block. A second
    attempt of a task writes the same files again."""
    bounded(rows.sparkSession, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, count = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            vectors = _stacked([h[2] for h in held])
            order = np.argsort(ids, kind="stable")
            body = {"planes": bit_planes(vectors[order])} if planes else {"vectors": vectors[order]}
            path = f"{folder}/{name}-{part:06d}-{seq:06d}"
            _put(path, ids=ids[order], labels=labels[order], **body)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(ids)], pa.int64())], names=["path", "n"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                cut = batch.slice(lo, block_rows - count)
                held.append((cut.column(0).to_numpy(), cut.column(1).to_numpy(), _matrix(cut.column(2))))
                count, lo = count + cut.num_rows, lo + cut.num_rows
                if count == block_rows:
                    yield close()
                    seq, held, count = seq + 1, [], 0
        if count:
            yield close()

    return cut_lineage(rows.mapInArrow(run, BLOCK))


# --- best rows ----------------------------------------------------------------------------------------------------
class Best:
    """The first ``k`` candidates of every slot: higher score first, ties to the smaller id."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(slots, np.iinfo(np.int64).min)  # the last score kept where a slot is full, and its id
        self.last = np.full(slots, np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        enters = (score > self.floor[slot]) | (ids < self.last[slot])
        if not enters.any():
            return
        slot, score, ids = slot[enters], score[enters], ids[enters]
        slot, score, ids = (np.concatenate([a, b]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, slot))  # ~x orders like -x and never overflows
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        last = rank[keep] == self.k - 1
        self.floor[self.slot[last]], self.last[self.slot[last]] = self.score[last], self.id[last]


def _tiles(block: dict[str, np.ndarray], tables: SubsetSums) -> Iterator[tuple[slice, np.ndarray]]:
    for lo in range(0, len(block["ids"]), TILE_ROWS):
        rows = slice(lo, lo + TILE_ROWS)
        yield rows, tables.scores(block["planes"][:, rows])


def _enter(best: Best, columns: np.ndarray, hit: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    row, column = np.divmod(np.flatnonzero(hit), hit.shape[1])
    best.add(columns[column], scores[row, column].astype(np.int64), ids[row])


def _bound(values: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Bounds in the kind of the scores, so that comparisons stay narrow."""
    limits = np.iinfo(like.dtype)
    return np.clip(values, limits.min, limits.max).astype(like.dtype)


def best_positives(anchors: dict[str, np.ndarray], blocks: Iterator[dict[str, np.ndarray]], k: int) -> Best:
    """The first ``k`` rows of another id and the anchor's label."""
    tables, best = SubsetSums(anchors["vectors"]), Best(len(anchors["ids"]), k)
    every = np.arange(len(anchors["ids"]))
    for block in blocks:
        for rows, scores in _tiles(block, tables):
            ids = block["ids"][rows]
            hit = block["labels"][rows, None] == anchors["labels"]
            hit &= scores >= _bound(best.floor, scores)
            hit &= ids[:, None] != anchors["ids"]
            _enter(best, every, hit, scores, ids)
    return best


def score_window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative scores n with 50 p <= 100 n <= 95 p, as exact bounds: half of p rounded up, 19 twentieths rounded down."""
    return -(-positive >> 1), positive + (-positive // 20)


def best_negatives(anchors: dict[str, np.ndarray], slot_anchor: np.ndarray, positive: np.ndarray, blocks: Iterator[dict[str, np.ndarray]], k: int) -> Best:
    """For every slot (an anchor and the score of one of its positives) the first ``k`` rows of other labels inside the window."""
    tables, best = SubsetSums(anchors["vectors"]), Best(len(slot_anchor), k)
    low, high = score_window(positive)
    rank = np.arange(len(slot_anchor)) - np.searchsorted(slot_anchor, slot_anchor)
    groups = [np.flatnonzero((rank == r) & (low <= high)) for r in range(int(rank.max(initial=-1)) + 1)]
    for block in blocks:
        for rows, scores in _tiles(block, tables):
            ids = block["ids"][rows]
            other = block["labels"][rows, None] != anchors["labels"]
            for slots in groups:
                at = slot_anchor[slots]
                inside = scores if len(at) == scores.shape[1] else scores[:, at]
                hit = inside >= _bound(np.maximum(low[slots], best.floor[slots]), scores)
                hit &= inside <= _bound(high[slots], scores)
                hit &= other if len(at) == scores.shape[1] else other[:, at]
                _enter(best, slots, hit, inside, ids)
    return best


# --- the two passes -----------------------------------------------------------------------------------------------
def _listed(folder: str, share: int, shares: int) -> list[str]:
    """The candidate blocks of one share, by their place in the sorted listing of the folder."""
    system, path = pafs.FileSystem.from_uri(folder)
    found = [f.base_name for f in system.get_file_info(pafs.FileSelector(path))]
    names = sorted(n for n in found if n.startswith("candidates-") and not n.endswith(".tmp"))
    return [f"{folder}/{n}" for n in names[share::shares]]


def _merged(df: DataFrame, keys: list[str], k: int, out: str) -> DataFrame:
    """The first ``k`` of what the shares found; a key has at most ``k`` rows per share."""
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn(out, F.row_number().over(place)).filter(F.col(out) <= k)


def hard_negatives(
    table: DataFrame, anchor_step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES,
    anchor_rows: int = ANCHOR_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``anchor_step``. Rows that take no part are named at ``usable``. Another row is
    one of another id; repeated rows count as often as they occur, a repeated anchor gives its rows as often. Vectors of unequal
    length score as if filled up with zeros. Components beyond a long are set to its ends and sums beyond a long wrap; all
    smaller scores are exact. An empty table, one without anchors or with one label gives no rows. Further columns do not travel.
    """
    spark = table.sparkSession
    folder = shared.new_folder(spark, "negatives")
    rows = usable(table)
    candidates = write_blocks(rows, folder, "candidates", block_rows, True)
    chosen = rows.filter(F.col("vec_id") % anchor_step == 0)
    blocks = -(-chosen.count() * 10 // (anchor_rows * 9))  # rows are dealt in turn, not quite evenly
    written = write_blocks(chosen.repartition(max(1, blocks)), folder, "anchors", anchor_rows, False)
    cores = spark.sparkContext.defaultParallelism
    shares = max(1, min(candidates.count(), -(-TASKS_PER_CORE * cores // max(1, blocks))))

    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    tasks = written.select("path", share).repartition(max(1, shares * blocks), "path", "share")

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                best = best_positives(_get(path), map(_get, _listed(folder, part, shares)), positives)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(best.slot), pa.string()), *map(pa.array, (best.slot, best.score, best.id))], names=["path", "slot", "score", "id"]
                )

    found = tasks.mapInArrow(find_positives, "path string, slot long, score long, id long")
    found = cut_lineage(_merged(found, ["path", "slot"], positives, "place"))
    gathered = F.sort_array(F.collect_list(F.struct("slot", "place", "score", "id")))  # at most anchor_rows * positives
    second = found.groupBy("path").agg(gathered.alias("found")).select("path", "found", share).repartition(max(1, shares * blocks), "path", "share")

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, pairs, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                slot, place, score, ids = (pairs.values.field(n).to_numpy() for n in ("slot", "place", "score", "id"))
                anchors = _get(path)
                best = best_negatives(anchors, slot, score, map(_get, _listed(folder, part, shares)), negatives)
                at = best.slot
                columns = (slot[at], place[at], anchors["ids"][slot[at]], ids[at], score[at], best.score, best.id)
                names = ["slot", "place", "anchor_id", "positive_id", "positive_score", "score", "id"]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), *map(pa.array, columns)], names=["path", *names])

    ddl = "path string, slot long, place int, anchor_id long, positive_id long, positive_score long, score long, id long"
    hits = _merged(second.mapInArrow(find_negatives, ddl), ["path", "slot", "place"], negatives, "rank")
    return hits.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
