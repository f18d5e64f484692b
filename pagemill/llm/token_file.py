"""Token ids as directly addressable codes: any token is read without decoding a block.

File layout, little endian: the magic, a header (documents, tokens, levels), a document table (id, presence of the id,
first token), then the levels. Level k keeps, for every id that reaches it, 8 bits of the id as one byte; a bitmap says
which ids go on to level k + 1, and a rank directory holds the number of ones before every 512th bit. The code of
token i on the next level stands at rank(bitmap, i).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagemill.llm import shared
from pagemill.llm.batches import bounded
from pagemill.llm.tokens import encoder
from pagemill.session import cut_lineage

#: Fixed values of the file format.
MAGIC = b"DACTOK01"
HEADER = struct.Struct("<8sQQQ")
LEVEL = struct.Struct("<Q")
CHUNK_BITS = 8
RANK_BITS = 512

FILE_TOKENS = 1 << 24


def _pad(n: int) -> bytes:
    return b"\0" * (-n % 8)


def pack_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """Parts of one file: ``ids`` of all documents in a row, ``counts`` tokens per document."""
    starts = np.r_[0, np.cumsum(counts)].astype("<u8")
    present = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    levels, rest = [], ids.astype(np.uint32)
    while True:
        low, high = (rest & 0xFF).astype(np.uint8), rest >> CHUNK_BITS
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bits.view("<u8")).reshape(-1, RANK_BITS // 64).sum(1, dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        ranks = np.r_[0, np.cumsum(ones)].astype("<u8")
        levels.append((len(rest), low.tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = high[more]
        if not len(rest):
            break
    out = [HEADER.pack(MAGIC, len(doc_ids), len(ids), len(levels)), named.tobytes(), present.tobytes(), _pad(len(present)), starts.tobytes()]
    for n, low, bits, ranks in levels:
        out += [LEVEL.pack(n), low, _pad(len(low)), bits, ranks]
    return out


class TokenFile:
    """Reader of one file; ``data`` may be a mapped buffer."""

    def __init__(self, data) -> None:  # noqa: ANN001
        magic, docs, self.tokens, levels = HEADER.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.present = np.frombuffer(data, np.uint8, docs, at)
        at += docs + len(_pad(docs))
        self.starts = np.frombuffer(data, "<u8", docs + 1, at)
        at += 8 * (docs + 1)
        self._levels = []
        for _ in range(levels):
            (n,) = LEVEL.unpack_from(data, at)
            at += LEVEL.size
            low = np.frombuffer(data, np.uint8, n, at)
            at += n + len(_pad(n))
            size = -(-n // RANK_BITS) * (RANK_BITS // 8)
            bits = np.frombuffer(data, "<u8", size // 8, at)
            at += size
            ranks = np.frombuffer(data, "<u8", size * 8 // RANK_BITS + 1, at)
            at += 8 * len(ranks)
            self._levels.append((low, bits, ranks))

    def take(self, index: np.ndarray) -> np.ndarray:
        """Ids of any tokens, in any order."""
        where = np.asarray(index, np.int64)
        out, live, shift = np.zeros(len(where), np.uint32), np.arange(len(where)), 0
        for low, bits, ranks in self._levels:
            out[live] |= low[where].astype(np.uint32) << np.uint32(shift)
            word, bit = where >> 6, (where & 63).astype(np.uint64)
            more = ((bits[word] >> bit) & np.uint64(1)).astype(bool)
            live, where, word, bit = live[more], where[more], word[more], bit[more]
            if not len(live):
                break
            block = where // RANK_BITS
            rank = ranks[block].astype(np.int64)
            first = block * (RANK_BITS // 64)
            for k in range(RANK_BITS // 64 - 1):  # whole words of the block before the bit
                inside = first + k < word
                rank += np.where(inside, np.bitwise_count(bits[np.minimum(first + k, word)]), 0)
            rank += np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            where, shift = rank, shift + CHUNK_BITS
        return out

    def _rank(self, level: int, at: int) -> int:
        """Ids before position ``at`` of a level that go on to the next one."""
        _, bits, ranks = self._levels[level]
        block, word = at // RANK_BITS, at >> 6
        ones = int(np.bitwise_count(bits[block * (RANK_BITS // 64) : word]).sum())
        if at & 63:
            ones += int(np.bitwise_count(bits[word] & np.uint64((1 << (at & 63)) - 1)))
        return int(ranks[block]) + ones

    def span(self, lo: int, hi: int) -> np.ndarray:
        """Ids of the tokens from ``lo`` to before ``hi``: their codes stand in a row on every level."""
        out, live = np.zeros(hi - lo, np.uint32), np.arange(hi - lo)
        for level, (low, bits, _) in enumerate(self._levels):
            out[live] |= low[lo:hi].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            more = np.unpackbits(bits[lo >> 6 : (hi + 63) >> 6].view(np.uint8), bitorder="little")[lo & 63 :][: hi - lo]
            live = live[more.view(bool)]
            if not len(live):
                break
            lo = self._rank(level, lo)
            hi = lo + len(live)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))


WRITTEN = "part int, seq int, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode whole texts in ascending ``doc_id`` order into files of about ``file_tokens`` tokens; one row per file.

    The order is a range partitioning by id, a hash of the text and the row, so rows that share an id, even whole copies, are cut
    into ranges like any others. Null ids come first, null texts count as empty, equal ids follow that hash. A file never holds
    part of a document.
    """
    bounded(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    place = ("doc_id", "_hash", "_row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(
        {"_hash": F.xxhash64(F.coalesce("text", F.lit(""))), "_row": F.monotonically_increasing_id()}
    )
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            counts = np.array([len(b) // 4 for b in held], np.int64)
            path = f"{folder}/part-{part:06d}-{seq:04d}.dac"
            shared.put(path, pack_file(names, counts, np.frombuffer(b"".join(held), "<u4")))
            row = ([part], [seq], [path], [len(names)], [int(counts.sum())])
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "path", "n_docs", "n_tokens"]
            )

        total = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                names.append(doc)
                held.append(ids + end)
                total += len(held[-1]) // 4
                if total >= file_tokens:
                    yield close()
                    names, held, total, seq = [], [], 0, seq + 1
        if names:
            yield close()

    return cut_lineage(ordered.mapInArrow(run, WRITTEN))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents of the written files: ``doc_id, start, n_tokens, ids_crc32``, every id read through its levels.

    The start of a file is the sum of the tokens of the files before it, over one short row per file.
    """
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    based = files.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    dealt = based.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(shared.get(path))
                count = len(file.doc_ids)
                starts = file.starts.astype(np.int64)
                lo = 0
                while lo < count:  # some thousand tokens at a time, documents whole
                    hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 18), "right")) - 1)
                    ids = file.span(int(starts[lo]), int(starts[hi])).astype("<u4").tobytes()
                    cut = 4 * (starts[lo : hi + 1] - starts[lo])
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    named = pa.array(file.doc_ids[lo:hi], mask=file.present[lo:hi] == 0)
                    columns = [named, pa.array(starts[lo:hi] + base), pa.array(np.diff(starts[lo : hi + 1])), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    lo = hi

    return dealt.mapInArrow(run, READ)
