"""Byte-pair encoding by a priority queue of merge ranks, and decoding by concatenating vocabulary strings.

A piece of text starts as a doubly linked list of one symbol per character. Every neighbouring pair that the merge table
knows stands in a heap, lowest rank and then leftmost place first. An entry is taken only if its pair is still there; else it
is stale and skipped. A merge links the new symbol to its neighbours and adds the two pairs it forms, so a piece of n symbols
takes n log n steps however long it is. Pieces repeat, so the worker remembers them in bounded memory.

Normalising and cutting into pieces follow the tokenizer file, by the library's own normaliser and pre-tokenizer.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagemill.llm.batches import bounded, select
from pagemill.llm.tokens import Encoder

_PLACE_BITS = 40


class Merges:
    """Vocabulary and merge table of a BPE file."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE files are understood")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.unknown: int | None = self.vocab.get(model.get("unk_token") or "")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._base = 1 + max([*self.vocab.values(), *self.added.values()], default=0)
        self._rank: dict[int, int] = {}
        self._made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._rank[self.vocab[left] * self._base + self.vocab[right]] = rank
            self._made.append(self.vocab[left + right])

    def symbols(self, piece: str) -> list[int]:
        """One symbol per character; the last carries the end-of-word suffix. What the vocabulary lacks is unknown, or nothing."""
        named = [*piece[:-1], piece[-1:] + self.suffix] if piece else []
        return [i for i in (self.vocab.get(c, self.unknown) for c in named) if i is not None]

    def encode(self, piece: str) -> list[int]:
        ids = self.symbols(piece)
        n, base, ranks, made = len(ids), self._base, self._rank, self._made
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            rank = ranks.get(ids[i] * base + ids[i + 1])
            if rank is not None:
                queue.append(rank << _PLACE_BITS | i)
        heapify(queue)
        place = (1 << _PLACE_BITS) - 1
        while queue:
            entry = heappop(queue)
            i, new = entry & place, made[entry >> _PLACE_BITS]
            j = after[i]
            if ids[i] < 0 or j < 0:
                continue  # stale: the symbol was swallowed, or nothing follows any more
            rank = ranks.get(ids[i] * base + ids[j])
            if rank is None or made[rank] != new:
                continue  # stale: another pair stands here now
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                rank = ranks.get(new * base + ids[k])
                if rank is not None:
                    heappush(queue, rank << _PLACE_BITS | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(ids[h] * base + new)
                if rank is not None:
                    heappush(queue, rank << _PLACE_BITS | h)
        return [i for i in ids if i >= 0]


class MergeEncoder(Encoder):
    """Ids of whole texts by our own merges; the memory of words and pieces is the shared helper's."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f))
        longest_first = sorted(self.merges.added, key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, longest_first)) or "(?!)")

    def _plain(self, text: str) -> Iterator[int]:
        if self._tokenizer.normalizer is not None:
            text = self._tokenizer.normalizer.normalize_str(text)
        cut = self._tokenizer.pre_tokenizer
        for piece in [p for p, _ in cut.pre_tokenize_str(text)] if cut is not None else [text]:
            yield from self.merges.encode(piece)

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            ids, at = [], 0
            for hit in self._added.finditer(text):
                ids += self._plain(text[at : hit.start()])
                ids.append(self.merges.added[hit.group()])
                at = hit.end()
            ids += self._plain(text[at:])
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out


def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Decoder:
    """Texts of ids: vocabulary strings in a row. A byte-level file joins bytes (what is no UTF-8 gives replacement
    characters), a file without a decoder puts a blank between two strings. Ids that the file does not have give nothing."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoder of type {kind}")
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        strings: list[bytes | None] = [None] * (1 + max(names.values(), default=0))
        byte_of = _byte_of()
        for name, i in names.items():
            plain = kind is None or any(c not in byte_of for c in name)
            strings[i] = name.encode() if plain else bytes(byte_of[c] for c in name)
        self._strings, self._joint = pa.array(strings, pa.large_binary()), b" " if kind is None else b""
        self._known, self._lossy = np.array([s is not None for s in strings]), kind is not None

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """UTF-8 of every text of ids."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
        known = self._known[np.minimum(ids, len(self._known) - 1)] & (ids < len(self._known))
        if not known.all():
            ends = np.r_[0, np.cumsum(known)][ends]
            ids = ids[known]
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self._strings.take(pa.array(ids)))
        texts = pc.binary_join(lists, pa.scalar(self._joint, pa.large_binary())).to_pylist()
        return [t.decode("utf-8", "replace").encode() for t in texts] if self._lossy else texts


_KEPT: dict[tuple[type, str], MergeEncoder | Decoder] = {}


def _kept(kind: type, path: str):  # noqa: ANN202
    """One encoder and one decoder per Python worker and file."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]


#: Texts decoded at once; a longer text is decoded alone.
DECODED_IDS = 1 << 20


def _decoded(decoder: Decoder, coded: list[bytes]) -> Iterator[bytes]:
    lo = 0
    while lo < len(coded):
        hi, total = lo + 1, len(coded[lo])
        while hi < len(coded) and total + len(coded[hi]) <= 4 * DECODED_IDS:
            total += len(coded[hi])
            hi += 1
        yield from decoder.decode(coded[lo:hi])
        lo = hi


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row, without special tokens of the file's own making. Null texts count as
    empty, null and repeated ``doc_id`` stay as they are, further columns do not travel."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _kept(MergeEncoder, tokenizer)
        for batch in batches:
            coded = enc.encode(batch.column(1))
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(coded), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``, special tokens included. Null ids count as none; a null id in an array, or one
    that the file does not have, gives nothing."""
    bounded(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _kept(Decoder, tokenizer)
        for batch in batches:
            ids = (np.array([i for i in row or () if i is not None and i >= 0], "<u4").tobytes() for row in batch.column(1).to_pylist())
            texts = [t.decode() for t in _decoded(dec, list(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return select(encoded, "doc_id", "ids").mapInArrow(run, encoded.select("doc_id").schema.add("text", "string"))


def _texts(docs: DataFrame) -> DataFrame:
    return select(docs.withColumn("doc_id", docs["doc_id"].cast("long")), "doc_id", "text")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of the ids (little-endian unsigned 32-bit) of every whole text and of the text that they decode to, in one pass
    over the scan: no shuffle. Edge cases are those of ``encode``; a very long text is one piece of work."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = _kept(MergeEncoder, tokenizer), _kept(Decoder, tokenizer)
        for batch in batches:
            coded = enc.encode(batch.column(1))
            columns = [
                batch.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                pa.array([hashlib.sha256(t).hexdigest() for t in _decoded(dec, coded)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, DIGESTS)
