"""Elias-Fano sequences as plain arrays: built once, mapped from a file, searched in bulk with numpy."""

from __future__ import annotations

import json
import struct

import numpy as np

BLOCK_WORDS = 8
_ONE = np.uint64(1)


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a sorted sequence of distinct unsigned values below ``universe``: about 2 + log2(universe / n) bits each."""
    n = len(values)
    width = min(56, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))
    values = values.astype(np.uint64)
    bits = [np.zeros(0, np.uint8)]
    if width:
        shifts = np.arange(width, dtype=np.uint64)
        step = 8 * max(1, (1 << 18) // width)  # whole bytes per part, some 16 MB on the way
        for k in range(0, n, step):
            bits.append(np.packbits(((values[k : k + step, None] >> shifts) & _ONE).astype(np.uint8).ravel(), bitorder="little"))
    low = np.concatenate([*bits, np.zeros(8, np.uint8)])
    upper = (values >> np.uint64(width)).astype(np.int64)
    top = int(upper[-1]) if n else 0
    flags = np.zeros(-(-(n + top + 2) // (64 * BLOCK_WORDS)) * 64 * BLOCK_WORDS, np.uint8)
    flags[upper + np.arange(n)] = 1
    high = np.packbits(flags, bitorder="little").view(np.uint64)
    free = (64 - np.bitwise_count(high).astype(np.int64)).reshape(-1, BLOCK_WORDS).sum(1)
    zeros = (np.cumsum(free) - free).astype(np.uint64)  # zeros before each block
    return {"low": low, "high": high, "zeros": zeros, "shape": np.array([n, width, top], np.uint64)}


class EliasFano:
    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, shape: np.ndarray) -> None:
        self.n, self.width, self.top = (int(s) for s in shape)
        self.high, self.zeros = high, zeros
        self._low = np.lib.stride_tricks.as_strided(low.view(np.uint8), (max(1, len(low) - 7), 8), (1, 1)) if self.width else None
        self._mask = np.uint64((1 << self.width) - 1)

    def lows(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.uint64)
        bit = index * self.width
        words = np.ascontiguousarray(self._low[bit >> 3]).view(np.uint64)[:, 0]
        return (words >> (bit & 7).astype(np.uint64)) & self._mask

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the upper bits."""
        block = np.searchsorted(self.zeros, k.astype(np.uint64), "right") - 1
        left = k - self.zeros[block].astype(np.int64)
        word = block * BLOCK_WORDS
        free = ~self.high[word]
        live = np.arange(len(k))
        while len(live):
            count = np.bitwise_count(free[live]).astype(np.int64)
            more = left[live] >= count
            live, count = live[more], count[more]
            left[live] -= count
            word[live] += 1
            free[live] = ~self.high[word[live]]
        place = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # the left-th set bit of a word, by halving
            count = np.bitwise_count(free & np.uint64((1 << step) - 1)).astype(np.int64)
            go = left >= count
            left -= np.where(go, count, 0)
            free = np.where(go, free >> np.uint64(step), free)
            place += np.where(go, step, 0)
        return (word << 6) + place

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value in the sequence, or -1: the zeros around its upper part bound the values to compare."""
        out = np.full(len(x), -1, np.int64)
        upper = (x >> np.uint64(self.width)).astype(np.int64)
        live = np.flatnonzero(upper <= self.top)
        if not self.n or not len(live):
            return out
        h, want = upper[live], x[live] & self._mask
        bit = np.zeros(len(live), np.int64)
        inner = h > 0
        bit[inner] = self._zero(h[inner] - 1) + 1
        # values whose upper part is h are the ones from here to the next zero
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        after = self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63))
        ones = (self.high[word] >> shift) | np.where(shift > 0, after, np.uint64(0))
        run = np.bitwise_count(ones ^ (ones + _ONE)).astype(np.int64) - 1
        long = np.flatnonzero((ones + _ONE) == 0)
        run[long] = self._zero(h[long]) - bit[long]
        lo = bit - h
        hi = lo + run
        while len(live):  # bisection; most ranges hold a value or two
            some = lo < hi
            live, want, lo, hi = live[some], want[some], lo[some], hi[some]
            mid = (lo + hi) >> 1
            value = self.lows(mid)
            same = value == want
            out[live[same]] = mid[same]
            live, want, lo, hi, mid, value = (a[~same] for a in (live, want, lo, hi, mid, value))
            right = value < want
            lo, hi = np.where(right, mid + 1, lo), np.where(right, hi, mid)
        return out


def build_ranks(values: np.ndarray) -> dict[str, np.ndarray]:
    """Bitmap of sorted distinct values that lie close together, with the ranks of its words."""
    lo = int(values[0]) if len(values) else 0
    flags = np.zeros((-(-(int(values[-1]) - lo + 1) // 64) if len(values) else 1) * 64, np.uint8)
    flags[values.astype(np.int64) - lo] = 1
    bits = np.packbits(flags, bitorder="little").view(np.uint64)
    count = np.bitwise_count(bits).astype(np.int64)
    return {"bits": bits, "ranks": (np.cumsum(count) - count).astype(np.uint64), "lo": np.array([lo], np.uint64)}


class Ranks:
    def __init__(self, bits: np.ndarray, ranks: np.ndarray, lo: np.ndarray) -> None:
        self._bits, self._ranks, self._lo = bits, ranks, int(lo[0])

    def find(self, x: np.ndarray) -> np.ndarray:
        """Rank of each value, or -1."""
        at = x.astype(np.int64) - self._lo
        inside = (at >= 0) & (at < 64 * len(self._bits))
        at = np.where(inside, at, 0)
        word, bit = self._bits[at >> 6], (at & 63).astype(np.uint64)
        rank = self._ranks[at >> 6].astype(np.int64) + np.bitwise_count(word & ((_ONE << bit) - _ONE))
        return np.where(inside & ((word >> bit) & _ONE).astype(bool), rank, -1)


def pack_arrays(arrays: dict[str, np.ndarray]) -> list[bytes]:
    """Parts of a file of named arrays, each aligned to 8 bytes behind a header that lists them."""
    listed, body, at = [], [], 0
    for name, a in arrays.items():
        raw = a.tobytes()
        listed.append([name, a.dtype.str, len(a), at])
        body += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + (-len(raw) % 8)
    head = json.dumps(listed).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return [struct.pack("<Q", len(head)), head, *body]


def open_arrays(data) -> dict[str, np.ndarray]:  # noqa: ANN001
    (size,) = struct.unpack_from("<Q", data, 0)
    return {
        name: np.frombuffer(data, np.dtype(kind), count, 8 + size + at)
        for name, kind, count, at in json.loads(bytes(memoryview(data)[8 : 8 + size]))
    }
