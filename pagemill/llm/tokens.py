"""Token ids of whole texts by a public tokenizer file, with a memory of the words already encoded.

A text is cut before every single space that a visible character follows. For the two pre-tokenizers recognised below no
token reaches over such a cut, so the ids of a text are the ids of its cuts in a row. Words repeat, so most of them are
looked up; new ones go to the tokenizer. Any other tokenizer file is applied to whole texts.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pattern that the byte-level pre-tokenizer is defined by.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space before white space or the end is no cut; the zero byte marks cuts.
_NOT_A_CUT = r" ([\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)|\x00"
_CUT = re.compile(r"(?= \S)")
#: Beyond these code points Unicode versions may differ; the capital dotted I changes its length when lowered.
_FAR = re.compile("[^\x00-\u024f]|\u0130")
MOST_KNOWN = 900_000


def _kind(path: str) -> tuple[str, str]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    flags = [any(t[k] for k in ("single_word", "lstrip", "rstrip")) for t in spec.get("added_tokens", [])]
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if any(flags):
        return "other", ""
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "bytes", BYTE_LEVEL_PATTERN
    steps, norms = pre.get("pretokenizers", []), [n.get("type") for n in norm.get("normalizers", [])]
    if [s.get("type") for s in steps] == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
        split = steps[0]
        if split.get("behavior") == "Removed" and split.get("invert") and not steps[1].get("use_regex"):
            return "words", split["pattern"].get("Regex", "")
    return "other", ""


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, one instance per Python worker and tokenizer file.

    Words and the pieces that the pre-tokenizer cuts them into are remembered together, in two generations of bounded size:
    a full young one becomes the old one, and what is met again moves back, so frequent words are never forgotten.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.kind, pattern = _kind(path)
        self._pattern = regex.compile(pattern) if pattern else None
        with open(path, encoding="utf-8") as f:
            self._special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        done = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in done)]

    def _pieces(self, word: str) -> list[str]:
        """What the pre-tokenizer cuts a word into, or the word itself where that is not plain to see."""
        lowered = word if self.kind == "bytes" else word.lower()
        if word[:1] == " ":  # the common cases: letters, or letters and one closing mark
            if word[1:].isalpha() and (word.isascii() or not _FAR.search(word)):
                return [lowered]
            if word[-1:] in ".,:;" and word[1:-1].isalpha() and (word.isascii() or not _FAR.search(word)):
                return [lowered[:-1], word[-1]]
        if any(s in word for s in self._special) or _FAR.search(word):
            return [word]
        if self.kind == "words" and ("'" in word or not (word.isascii() or unicodedata.is_normalized("NFC", word))):
            return [word]
        return self._pattern.findall(lowered)

    def forget(self) -> None:
        """Give the memory back, for workers that go on with other work."""
        self._known, self._old = {}, {}

    def _recall(self, words: Iterable[str]) -> list[str]:
        """Move what the old generation has into the young one; the rest is new."""
        new, old, known = [], self._old, self._known
        for word in words:
            ids = old.get(word)
            if ids is None:
                new.append(word)
            else:
                known[word] = ids
        return new

    def _learn(self, words: list[str]) -> None:
        """Ids of words not met before; what their pieces need is encoded in one call."""
        known = self._known
        words = self._recall(words)
        cuts = [self._pieces(word) for word in words]
        new = self._recall(set(chain.from_iterable(cuts)).difference(known))
        known.update(zip(new, self._whole(new), strict=True))
        for word, pieces in zip(words, cuts, strict=True):
            if len(pieces) > 1:
                known[word] = b"".join([known[p] for p in pieces])
            elif not pieces:
                known[word] = b""
            elif pieces[0] != word:
                known[word] = known[pieces[0]]

    def _one(self, text: str) -> bytes:
        words = _CUT.split(text)
        self._learn(list(set(words).difference(self._known)))
        return b"".join([self._known[w] for w in words])

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of every text of a column; null reads as empty. Arrow cuts the texts and finds the distinct words of the
        batch, so that only these are looked up; their ids are then gathered in numpy."""
        column = column.fill_null("") if column.null_count else column
        if self.kind == "other":
            return self._whole(column.to_pylist())
        if len(self._known) > MOST_KNOWN:
            self._old, self._known = self._known, {}
        odd = pc.match_substring_regex(column, _NOT_A_CUT)
        usual = column.filter(pc.invert(odd))
        lists = pc.split_pattern(pc.replace_substring(usual, " ", "\0 "), "\0")
        coded = lists.flatten().dictionary_encode()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._learn([w for w in words if w not in self._known])
        ids = [self._known[w] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        count = size[index]
        end = np.cumsum(count)
        at = np.repeat(first[index] - end + count, count) + np.arange(count.sum())
        flat = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        cut = (4 * np.r_[0, end][lists.offsets.to_numpy()]).tolist()
        plain = iter(zip(cut, cut[1:], strict=False))
        out = []
        for strange, text in zip(odd.to_pylist(), column, strict=True):
            if strange:
                out.append(self._one(text.as_py()))
            else:
                lo, hi = next(plain)
                out.append(flat[lo:hi])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_file(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
