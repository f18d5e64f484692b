"""CRC-32 of any substring from two running CRCs.

A CRC is linear over GF(2): of a text AB, crc(AB) = crc(A) * x^(8|B|) + crc(B) modulo the polynomial. With the running CRC
before and after B known, crc(B) follows by moving the first |B| bytes on and cancelling it. Moving on by n bytes is one linear
map; maps for n below 64 and for 64 times each power of two are kept as tables of bytes.
"""

from __future__ import annotations

from itertools import accumulate
from zlib import crc32

import numpy as np

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
_NEAR = 64
_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


_BYTE = _byte_table()


def _one_on(crc: np.ndarray) -> np.ndarray:
    return _BYTE[crc & 0xFF] ^ (crc >> 8)


def _tables(basis: np.ndarray) -> np.ndarray:
    """Images of the 4 x 256 single bytes under the map that takes bit i to ``basis[i]``."""
    out = np.zeros((4, 256), np.uint32)
    for j in range(4):
        for bit in range(8):
            out[j] ^= np.where(np.arange(256) >> bit & 1, basis[8 * j + bit], np.uint32(0))
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


def _maps() -> tuple[np.ndarray, list[np.ndarray]]:
    basis, near = np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(_NEAR):
        near.append(_tables(basis))
        basis = _one_on(basis)
    far = []
    for _ in range(40):  # 64 bytes, 128, ... as far as any text goes
        far.append(_tables(basis))
        basis = _apply(far[-1], basis)
    return np.stack(near, axis=1).reshape(4, -1), far


_CLOSE, _FAR = _maps()


def moved_on(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``crc`` (uint32) times x^(8n), element by element."""
    at = (n & (_NEAR - 1)) << 8
    out = _CLOSE[0][at | (crc & 0xFF)] ^ _CLOSE[1][at | (crc >> 8 & 0xFF)] ^ _CLOSE[2][at | (crc >> 16 & 0xFF)] ^ _CLOSE[3][at | (crc >> 24)]
    rest = n >> 6
    if rest.any():
        for k in range(int(rest.max()).bit_length()):
            hit = np.flatnonzero(rest >> k & 1)
            out[hit] = _apply(_FAR[k], out[hit])
    return out


def substring_crcs(before: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of substrings from the running CRCs before and after them and their lengths in bytes."""
    return after ^ moved_on(before, length)


def _separators() -> bytes:
    """Letters in lower case, digits and bytes from 128 on stay; everything else separates."""
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


SEPARATED = _separators()


class Scanned:
    """Words of separator-normalised documents with the running CRCs at their borders.

    ``counts``: words per document; ``sizes``: bytes per word; ``starts`` and ``ends``: CRC of the normalised document up to
    where a word starts (after its separator) and ends. Only the running CRC itself is a loop, one step per word.
    """

    def __init__(self, texts: list[bytes]) -> None:
        counts, sizes, ends = [], [], []
        for text in texts:
            words = text.translate(SEPARATED).split()
            counts.append(len(words))
            if words:
                sizes += map(len, words)
                rest = [b" " + w for w in words[1:]]
                ends += accumulate(rest, lambda crc, piece: crc32(piece, crc), initial=crc32(words[0]))
        self.counts = np.array(counts, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.array(ends, np.uint32)
        last = np.r_[np.uint32(0), self.ends[:-1]] ^ _ALL  # then one separator further
        self.starts = _BYTE[(last ^ 32) & 0xFF] ^ (last >> 8) ^ _ALL
        first = (np.cumsum(self.counts) - self.counts)[self.counts > 0]
        self.starts[first] = 0
        self.place = np.arange(len(self.sizes)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """CRC of every run of ``n`` words joined by one space, and how many runs each document has."""
        left = np.repeat(self.counts, self.counts) - self.place
        first = np.flatnonzero(left >= n)
        reach = np.cumsum(np.r_[0, self.sizes + 1])
        length = reach[first + n] - reach[first] - 1
        return substring_crcs(self.starts[first], self.ends[first + n - 1], length), np.maximum(self.counts - n + 1, 0)
