"""Language-model scores from an Elias-Fano n-gram trie that executors map from the shared folder.

Level 1 is the vocabulary: sorted 63-bit word hashes in shards by their leading bits, with counts; the rank of a word is
its id. Levels 2 and 3 hold bigrams and trigrams, in shards that are ranges of the first two words. A level is one Elias-Fano sequence of
parent rank x vocabulary + word id, which rises within a context and from context to context, so a word is searched
relative to its context; beside it stand quantised probabilities. Smoothing is interpolated absolute discounting: what the
stored entries of a context leave over goes to the shorter context, down to the unigram estimate.

All counts cover all training documents. They are summed inside map tasks and travel as sorted column blocks per shard.
The shards follow the unigram mass of the first word and, within a word, of the second, so a very frequent word is
cut into many shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import shared
from pagemill.llm.batches import bounded, flat
from pagemill.llm.elias_fano import EliasFano, Ranks, build, build_ranks, open_arrays, pack_arrays
from pagemill.llm.sampling import fold

DISCOUNT = 0.75
SHARD_TOKENS = 1_000_000
MOST_WORD_BITS = 12
HELD_TOKENS = 1_000_000
MERGED_GRAMS = 500_000  # n-grams of a shard that wait before they are merged into what is there
STEPS = 255 / 12.0  # quantisation of -log10 p, 8 bits for 12 decades
BATCH_ROWS = 1000

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.random.default_rng(42).integers(1, 2**63, 256, dtype=np.uint64)  # a fixed random word per byte
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_NEAR = 12  # bits of a place in a word whose powers are tabled; further powers are products
_POWERS = np.cumprod(np.full(1 << _NEAR, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
END = np.uint64(1)  # hash of the end token; words have the lowest bit cleared


def _powers(place: np.ndarray) -> np.ndarray:
    """The factor of a byte by its place in the word: a power of one odd number, different for every place."""
    far = int(place.max(initial=0)) >> _NEAR
    near = _POWERS[place & ((1 << _NEAR) - 1)]
    if not far:
        return near
    return near * np.cumprod(np.r_[np.uint64(1), np.full(far, _POWERS[-1], np.uint64)], dtype=np.uint64)[place >> _NEAR]


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all tokens of a batch, the end token of each text included, and the first token of each text."""
    data, offsets = flat(column)
    inside = ~_SPACE[data]
    before = np.r_[False, inside[:-1]] if len(data) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, starts)
    if len(starts):
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
        h = np.add.reduceat(_LETTER[data[at]] * _powers(place), begin)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) >> np.uint64(1) & ~np.uint64(1)
    else:
        h = np.zeros(0, np.uint64)
    words = np.searchsorted(starts, offsets[1:])  # words up to the end of each text
    rows = len(offsets) - 1
    tokens = np.insert(h, words, END)
    first = np.r_[0, words + np.arange(1, rows + 1)]
    return tokens, first


_LOW = np.uint64(0xFFFFFFFF)


def _sum(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    if count is None:
        key = np.sort(key)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        return key[new], np.diff(np.r_[new, len(key)])
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[new], (np.add.reduceat(count[order], new) if len(new) else count)


def _places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each first stands, and the place of every key among them."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]][: len(key)]
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (u.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64)


def word_bits(texts: DataFrame) -> int:
    """Leading hash bits that name a vocabulary shard: at least as many shards as shuffle partitions, from 64 to 4096."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_WORD_BITS, max(6, (partitions - 1).bit_length()))


def _shard_cuts(words: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among ascending hashes, and the end."""
    return np.searchsorted(words >> np.uint64(63 - (shards - 1).bit_length()), np.arange(shards + 1))


def count_words(texts: DataFrame, folder: str) -> list[tuple[int, int]]:
    """Write the vocabulary shards; (words, tokens) per shard in order."""
    shards = 1 << word_bits(texts)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        totals = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def merge() -> tuple[np.ndarray, np.ndarray]:
            words, n = _sum(np.concatenate([*held, np.zeros(0, np.uint64)]))
            return _sum(np.r_[totals[0], words], np.r_[totals[1], n])

        for batch in batches:
            held.append(token_hashes(batch.column(0))[0])
            if sum(map(len, held)) > HELD_TOKENS:
                totals, held = merge(), []
        words, n = merge()
        cut = _shard_cuts(words, shards)
        used = np.flatnonzero(np.diff(cut))
        columns = [pa.array(used, pa.int32())]
        columns += [pa.array([c[cut[s] : cut[s + 1]].tobytes() for s in used], pa.binary()) for c in (words, n)]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "words", "n"])

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        words = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in table.column("words")])
        n = np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table.column("n")])
        words, n = _sum(words, n)
        shared.put(f"{folder}/words-{shard:04d}", pack_arrays(build(words, 1 << 63) | {"sum": np.r_[0, np.cumsum(n)].astype(np.uint64)}))
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": [len(words)], "tokens": [int(n.sum())]})

    counted = texts.mapInArrow(local, "shard int, words binary, n binary")
    rows = counted.groupBy("shard").applyInArrow(write, "shard int, words long, tokens long").collect()  # one short row per shard
    by = {r["shard"]: (r["words"], r["tokens"]) for r in rows}
    return [by.get(s, (0, 0)) for s in range(shards)]


class Vocabulary:
    """Ids, counts and cumulated counts of words, from the mapped shards."""

    def __init__(self, folder: str, sizes: list[tuple[int, int]], documents: int) -> None:
        self.words = sum(w for w, _ in sizes)
        self.tokens = sum(t for _, t in sizes)
        self.documents = documents
        self.unknown, self.begin = self.words, self.words + 1
        if self.begin > 0xFFFFFFFF:
            raise ValueError("more than 2^32 - 2 distinct words: ids no longer fit the keys of n-grams")
        self._shards: list[tuple[EliasFano, np.ndarray] | None] = []
        for s, (n, _) in enumerate(sizes):
            if n:
                a = open_arrays(shared.get(f"{folder}/words-{s:04d}"))
                self._shards.append((EliasFano(a["low"], a["high"], a["zeros"], a["shape"]), a["sum"]))
            else:
                self._shards.append(None)
        self._words = np.cumsum([0, *[w for w, _ in sizes]])
        self._tokens = np.cumsum([0, *[t for _, t in sizes]])

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id, count and tokens of smaller words for each hash; unknown words have the id ``unknown`` and the count 0."""
        distinct, _, inverse = _places(hashes)
        ids = np.full(len(distinct), self.unknown, np.int64)
        count, below = np.zeros(len(distinct), np.int64), np.full(len(distinct), self.tokens, np.int64)
        cut = _shard_cuts(distinct, len(self._shards))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            shard, part = self._shards[s], slice(cut[s], cut[s + 1])
            if shard is None:
                continue
            found = shard[0].find(distinct[part])
            known = np.flatnonzero(found >= 0)
            at, where = found[known], known + part.start
            ids[where] = self._words[s] + at
            low = shard[1][at].astype(np.int64)
            count[where] = shard[1][at + 1].astype(np.int64) - low
            below[where] = self._tokens[s] + low
        return ids[inverse], count[inverse], below[inverse]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of known ids in ascending order."""
        out = np.zeros(len(ids), np.int64)
        cut = np.searchsorted(ids, self._words)
        for s, shard in enumerate(self._shards):
            if shard is not None and cut[s] < cut[s + 1]:
                at = ids[cut[s] : cut[s + 1]] - self._words[s]
                out[cut[s] : cut[s + 1]] = shard[1][at + 1].astype(np.int64) - shard[1][at].astype(np.int64)
        return out

    def shard_of(self, shards: int, below_u: np.ndarray, count_u: np.ndarray, below_v: np.ndarray) -> np.ndarray:
        """Shard of an n-gram by its first two words: their place in the cumulated unigram mass, the second within the first."""
        total = self.tokens + self.documents + 1
        x = (below_u + count_u * (below_v / (total + 1))) / total
        return np.minimum((x * shards).astype(np.int64), shards - 1)


def _padded(vocabulary: Vocabulary, column: pa.Array):  # noqa: ANN202
    """Ids, counts and cumulated counts of a batch with the begin symbol before each text; places of all tokens."""
    tokens, first = token_hashes(column)
    ids, count, below = vocabulary.look_up(tokens)
    pad = first[:-1]
    ids = np.insert(ids, pad, vocabulary.begin)
    count = np.insert(count, pad, vocabulary.documents)
    below = np.insert(below, pad, vocabulary.tokens)
    start = first[:-1] + np.arange(len(pad))  # places of the begin symbols
    is_token = np.ones(len(ids), bool)
    is_token[start] = False
    at = np.flatnonzero(is_token)
    inner = is_token.copy()
    inner[start + 1] = False  # tokens with two symbols before them
    return ids, count, below, at, np.flatnonzero(inner), first


def count_ngrams(texts: DataFrame, folder: str, sizes: list[tuple[int, int]], documents: int, shards: int) -> None:
    """Write the shards of the levels 2 and 3."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder, sizes, documents)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pairs, shard, last, words = (np.concatenate([p[k] for p in held]) for k in range(4))
            base = np.cumsum([0, *[len(p[0]) for p in held]])[:-1]
            context = last + np.repeat(base, [len(p[2]) for p in held])
            distinct, first, inverse = _places(pairs)
            n2 = np.bincount(inverse, minlength=len(distinct)).astype(np.uint32)
            grams, n3 = _sum(_pair(inverse[context], words))
            below = np.bincount((grams >> np.uint64(32)).astype(np.int64), minlength=len(distinct)).astype(np.uint32)
            cut = np.searchsorted(shard[first], np.arange(shards + 1))  # shards rise with the pairs
            child = np.r_[0, np.cumsum(below, dtype=np.int64)][cut]
            used = np.flatnonzero(np.diff(cut))
            u, v, w = (distinct >> np.uint64(32)).astype(np.uint32), (distinct & _LOW).astype(np.uint32), (grams & _LOW).astype(np.uint32)
            blocks = [pa.array([c[cut[s] : cut[s + 1]].tobytes() for s in used], pa.binary()) for c in (u, v, n2, below)]
            blocks += [pa.array([c[child[s] : child[s + 1]].tobytes() for s in used], pa.binary()) for c in (w, n3.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *blocks], names=["shard", "u", "v", "n2", "below", "w", "n3"])

        for batch in batches:
            ids, count, below, at, inner, _ = _padded(vocabulary, batch.column(0))
            shard = vocabulary.shard_of(shards, below[:-1], count[:-1], below[1:]).astype(np.int32)
            token = np.zeros(len(ids), np.int64)
            token[at] = np.arange(len(at))
            held.append((_pair(ids[at - 1], ids[at]), shard[at - 1], token[inner - 1], ids[inner].astype(np.uint32)))
            size += len(at)
            if size > HELD_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come in the order of their shards; only what a shard holds once, and a few blocks, are in memory."""
        vocabulary, done, grams = Vocabulary(folder, sizes, documents), [], None

        def close() -> None:
            shared.put(f"{folder}/grams-{done[-1]:05d}", pack_arrays(grams.trie(vocabulary)))

        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.column(0)[row].as_py()
                if not done or done[-1] != shard:
                    if done:
                        close()
                    done.append(shard)
                    grams = Grams()
                grams.add(*(np.frombuffer(batch.column(k)[row].as_buffer() or b"", np.uint32) for k in range(1, 7)))
        if done:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], names=["shard"])

    bounded(texts.sparkSession, BATCH_ROWS)
    counted = texts.mapInArrow(local, "shard int, u binary, v binary, n2 binary, below binary, w binary, n3 binary")
    counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(build_shards, "shard int").count()


class Grams:
    """Bigrams and trigrams of one shard with their counts, merged block by block.

    Blocks wait until they are as many as what is merged already, so each n-gram is moved a few times only, and memory follows
    the distinct n-grams of the shard, not the blocks that name them.
    """

    def __init__(self) -> None:
        self.pairs, self.n2 = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.grams, self.n3 = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # (rank of the pair, word)
        self._waiting: list[tuple[np.ndarray, ...]] = []
        self._size = 0

    def add(self, u: np.ndarray, v: np.ndarray, n2: np.ndarray, below: np.ndarray, w: np.ndarray, n3: np.ndarray) -> None:
        """A block: bigrams with counts and the number of their trigrams, then the last words of these with counts."""
        self._waiting.append((_pair(u, v), n2, below, w.copy(), n3.copy()))
        self._size += len(u) + len(w)
        if self._size > max(MERGED_GRAMS, len(self.pairs) + len(self.grams)):
            self._merge()

    def _merge(self) -> None:
        waiting, self._waiting, self._size = self._waiting, [], 0
        if not waiting:
            return
        pairs, _, inverse = _places(np.concatenate([self.pairs, *[b[0] for b in waiting]]))
        inverse = inverse.astype(np.uint32)
        self.n2 = np.bincount(inverse, np.concatenate([self.n2, *[b[1] for b in waiting]]), len(pairs)).astype(np.int64)
        keys, at = [], len(self.pairs)
        keys.append(_pair(inverse[:at][(self.grams >> np.uint64(32)).astype(np.int64)], self.grams & _LOW))
        for block, _, below, w, _ in waiting:
            keys.append(_pair(np.repeat(inverse[at : at + len(block)], below), w))
            at += len(block)
        del inverse
        counts = np.concatenate([self.n3, *[b[4] for b in waiting]])
        del waiting
        self.pairs, (self.grams, self.n3) = pairs, _sum(np.concatenate(keys), counts)

    def trie(self, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
        self._merge()
        return _trie(self.pairs, self.n2, self.grams, self.n3, vocabulary)


_LEVELS = 10 ** (-np.arange(256) / STEPS)


def _quantised(p: np.ndarray) -> np.ndarray:
    """The next stored probability from above in -log10, so that what is stored never exceeds what was counted."""
    return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-12)) * STEPS - 1e-9), 0, 255).astype(np.uint8)


def _trie(pairs: np.ndarray, n2: np.ndarray, grams: np.ndarray, n3: np.ndarray, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Arrays of one shard: first words, bigrams below them, trigrams below these. ``grams`` are (rank of the pair, word).

    A bigram keeps its discounted probability and what its trigrams, as stored, leave over; a first word keeps the sum of its
    bigrams, as stored in this shard, so that a word cut into several shards is added up by the reader. Probabilities are
    quantised before anything is subtracted from one: the model sums to one as it is read.
    """
    u, v = (pairs >> np.uint64(32)).astype(np.int64), pairs & _LOW
    base = np.uint64(vocabulary.words + 2)
    new = np.r_[True, u[1:] != u[:-1]][: len(u)]
    words, of_word = u[new], np.cumsum(new) - 1
    known = vocabulary.counts(np.minimum(words, max(0, vocabulary.words - 1)))
    count = np.where(words == vocabulary.begin, vocabulary.documents, known)
    p2 = _quantised((n2 - DISCOUNT) / count[of_word])
    out = {f"w.{k}": a for k, a in build_ranks(words).items()} | {"p2": p2, "sum": np.bincount(of_word, _LEVELS[p2], len(words))}
    out |= {f"b.{k}": a for k, a in build(of_word.astype(np.uint64) * base + v, (len(words) + 1) * int(base)).items()}
    parent = (grams >> np.uint64(32)).astype(np.int64)
    p3 = _quantised((n3 - DISCOUNT) / n2[parent])
    out |= {"p3": p3, "left": (1 - np.bincount(parent, _LEVELS[p3], len(pairs))).astype(np.float32)}
    out |= {f"t.{k}": a for k, a in build(parent.astype(np.uint64) * base + (grams & _LOW), (len(pairs) + 1) * int(base)).items()}
    return out


class Trie:
    """Probabilities from the mapped shards."""

    def __init__(self, folder: str, vocabulary: Vocabulary, shards: int) -> None:
        self._folder, self._vocabulary, self.shards = folder, vocabulary, shards
        self._base = np.uint64(vocabulary.words + 2)
        self._open: dict[int, tuple] = {}

    def _shard(self, s: int) -> tuple:
        if s not in self._open:
            try:
                a = open_arrays(shared.get(f"{self._folder}/grams-{s:05d}"))
            except FileNotFoundError:  # no n-gram fell into it
                self._open[s] = ()
            else:
                ef = [EliasFano(*[a[f"{k}.{n}"] for n in ("low", "high", "zeros", "shape")]) for k in "bt"]
                self._open[s] = (Ranks(a["w.bits"], a["w.ranks"], a["w.lo"]), *ef, a["sum"], a["p2"], a["left"], a["p3"])
        return self._open[s]

    def _each(self, shard: np.ndarray):  # noqa: ANN202
        """The shards in use and their slices of ascending shard numbers."""
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            parts = self._shard(s)
            if parts:
                yield parts, slice(cut[s], cut[s + 1])

    def kept_mass(self, u: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Summed probabilities of the stored bigrams after each of the ascending words, over its shards."""
        out = np.zeros(len(u))
        todo, shard = np.arange(len(u)), first.copy()
        while len(todo):
            for parts, part in self._each(shard[todo]):
                rank = parts[0].find(u[todo[part]])
                out[todo[part]] += np.where(rank >= 0, parts[3][rank], 0.0)
            shard[todo] += 1
            todo = todo[shard[todo] <= last[todo]]
            todo = todo[np.argsort(shard[todo], kind="stable")]
        return out

    def pairs(self, u: np.ndarray, v: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ascending pairs: the place in their shard or -1, the stored probability, and what they leave to shorter contexts."""
        rank, p, left = np.full(len(u), -1), np.zeros(len(u)), np.ones(len(u))
        for parts, part in self._each(shard):
            first = parts[0].find(u[part])
            hit = np.flatnonzero(first >= 0)
            found = parts[1].find(first[hit].astype(np.uint64) * self._base + v[part][hit].astype(np.uint64))
            hit, found = hit[found >= 0] + part.start, found[found >= 0]
            rank[hit], p[hit], left[hit] = found, _LEVELS[parts[4][found]], parts[5][found]
        return rank, p, left

    def triples(self, pair: np.ndarray, w: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Stored probability of words after pairs (places in their shard), by ascending pair; 0 if there is none."""
        p = np.zeros(len(pair))
        for parts, part in self._each(shard):
            found = parts[2].find(pair[part].astype(np.uint64) * self._base + w[part].astype(np.uint64))
            hit = np.flatnonzero(found >= 0)
            p[hit + part.start] = _LEVELS[parts[6][found[hit]]]
        return p


def score_batch(column: pa.Array, vocabulary: Vocabulary, trie: Trie) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score of each text. Pairs are looked up once per batch, in order."""
    ids, count, below, at, inner, first = _padded(vocabulary, column)
    smooth = vocabulary.tokens + 0.5 * (vocabulary.words + 1)
    p1 = (count[at] + 0.5) / smooth
    distinct, where, inverse = _places(_pair(ids[at - 1], ids[at]))
    place = at[where]
    u, v = distinct >> np.uint64(32), distinct & _LOW
    shard = vocabulary.shard_of(trie.shards, below[place - 1], count[place - 1], below[place])
    rank, p2, left = trie.pairs(u, v, shard)
    # the shards that hold a word: of its first and of its last follower
    new = np.r_[True, u[1:] != u[:-1]][: len(u)]
    of = place[new] - 1
    ends = (np.zeros(len(of), np.int64), np.full(len(of), vocabulary.tokens + vocabulary.documents))
    mass = trie.kept_mass(u[new], *[vocabulary.shard_of(trie.shards, below[of], count[of], end) for end in ends])
    rest = np.maximum(1 - mass, 1e-12)[np.cumsum(new) - 1]
    p = p2[inverse] + rest[inverse] * p1
    token = np.zeros(len(ids), np.int64)
    token[at] = np.arange(len(at))
    now, context = token[inner], inverse[token[inner] - 1]
    known = rank[context] >= 0
    known_now, known_context = now[known], context[known]
    order = np.argsort(_pair(known_context, ids[at[known_now]]))
    known_now, known_context = known_now[order], known_context[order]
    p3 = np.zeros(len(at))
    p3[known_now] = trie.triples(rank[known_context], ids[at[known_now]], shard[known_context])
    longer = left[context]
    p[now] = p3[now] + longer * p[now]
    rows = first[:-1]
    total = lambda x: np.add.reduceat(x, rows) if len(rows) else np.zeros(0)
    n_known = total((count[at] > 0).astype(np.int64)).astype(np.int64)
    return np.diff(first), n_known, total(np.log10(p1)), total(np.log10(p))


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, folds: int = 5, fold_out: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Train on the rows whose crc32(doc_id) modulo ``folds`` is not ``fold_out`` and score every document.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; a null or empty text is its end token alone.
    Repeated rows count and come back as often as they occur; null ids have remainder 0; further columns are ignored; an empty
    table gives no rows, and without training rows every token has the same probability.
    """
    spark = bounded(docs.sparkSession, BATCH_ROWS)
    folder = shared.new_folder(spark, "trie")
    training = docs.filter(fold("doc_id", folds) != fold_out).select("text")
    sizes = count_words(training, folder)
    documents = training.count()
    tokens = sum(t for _, t in sizes)
    shards = max(1, -(-tokens // shard_tokens))
    if tokens:
        count_ngrams(training, folder, sizes, documents, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder, sizes, documents)
        trie = Trie(folder, vocabulary, shards)
        for batch in batches:
            n, known, base, score = score_batch(batch.column(2), vocabulary, trie)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), tokens))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base), pa.array(score)], names=[c.split()[0] for c in OUT.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == fold_out).alias("held_out"), "text")
    return rows.mapInArrow(run, OUT)
