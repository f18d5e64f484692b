from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import EDGES
from pagemill.llm import elias_fano, ngram_lm

SMALL = "/root/testdata/sf0.001"


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**40), max_size=300) | st.sets(st.integers(0, 500), max_size=400), st.lists(st.integers(0, 2**40), max_size=50))
def test_elias_fano(values, others):
    kept = np.array(sorted(values), np.uint64)
    arrays = elias_fano.open_arrays(b"".join(elias_fano.pack_arrays(elias_fano.build(kept, 2**40 + 1))))
    ef = elias_fano.EliasFano(arrays["low"], arrays["high"], arrays["zeros"], arrays["shape"])
    asked = np.array(sorted(values) + others + [0], np.uint64)
    where = {int(x): k for k, x in enumerate(kept)}
    assert ef.find(asked).tolist() == [where.get(int(x), -1) for x in asked]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


def remainder(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def brute(pairs):
    train = [["\0begin", *tokens(t)] for i, t in pairs if remainder(i) != 1]
    c1 = Counter(w for t in train for w in t[1:])
    c2 = Counter(g for t in train for g in zip(t, t[1:], strict=False))
    c3 = Counter(g for t in train for g in zip(t, t[1:], t[2:], strict=False))
    n, v, d = sum(c1.values()), len(c1), ngram_lm.DISCOUNT
    context = c1 + Counter({"\0begin": len(train)})
    stored = lambda p: 10 ** (-math.ceil(-math.log10(p) * ngram_lm.STEPS - 1e-9) / ngram_lm.STEPS)
    p2, p3 = {g: stored((k - d) / context[g[0]]) for g, k in c2.items()}, {g: stored((k - d) / c2[g[:2]]) for g, k in c3.items()}
    mass2, mass3 = Counter(), Counter()
    for (a, _), p in p2.items():
        mass2[a] += p
    for (a, b, _), p in p3.items():
        mass3[a, b] += p
    out = {}
    for i, text in pairs:
        t = ["\0begin", *tokens(text)]
        base = score = 0.0
        for k in range(1, len(t)):
            p = (c1[t[k]] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            p = p2.get((t[k - 1], t[k]), 0) + max(1 - mass2[t[k - 1]], 1e-12) * p
            if k > 1 and c2[t[k - 2], t[k - 1]]:
                p = p3.get((t[k - 2], t[k - 1], t[k]), 0) + (1 - mass3[t[k - 2], t[k - 1]]) * p
            score += math.log10(p)
        out[i] = (remainder(i) == 1, len(t) - 1, sum(c1[w] > 0 for w in t[1:]), n, base, score)
    return out


def check(rows, pairs):
    want = brute(pairs)
    assert len(rows) == len(pairs)
    for r in rows:
        held, n, known, train, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score, rel=1e-5, abs=1e-5)


def test_edges(docs):
    pairs = EDGES + [(k, f"The cat number {k} sat on the mat, the cat sat") for k in range(20, 60)]
    check(ngram_lm.lm_scores(docs(pairs), shard_tokens=7000).collect(), pairs)
    assert ngram_lm.lm_scores(docs([])).count() == 0
    alone = ngram_lm.lm_scores(docs([(i, "a b") for i in range(40) if remainder(i) == 1])).collect()
    assert all(r.n_known == 0 and r.score == pytest.approx(0.0) for r in alone)


def test_given_documents(spark):
    from pagemill.llm.queries import QUERIES

    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = QUERIES["op7_lm_scores"](spark, SMALL).collect()
    check(rows, pairs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    cut = ngram_lm.lm_scores(spark.read.parquet(f"{SMALL}/documents.parquet"), shard_tokens=3000).collect()  # many shards
    check(cut, pairs)


def test_long_words_are_told_apart():
    import pyarrow as pa

    words = ["a" * 8192, "a" * 4096 + "b" + "a" * 4095, "b" + "a" * 8191, "a" * 8191 + "b", "ab" * 4096, "ba" * 4096, "a" * 4096]
    tokens, _ = ngram_lm.token_hashes(pa.array([" ".join(words)]))
    assert len(set(tokens.tolist())) == len(words) + 1
    swapped = ["x" * 4096 + "y" * 4096, "y" * 4096 + "x" * 4096]
    assert len(set(ngram_lm.token_hashes(pa.array(swapped))[0].tolist())) == 3


class _Words:
    words, documents, begin, unknown = 40, 50, 41, 40

    def counts(self, ids):
        return self._n[ids]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(1, 40))
def test_merged_blocks_and_what_is_left(rows, merged):
    """Blocks in any cut give the same counts, and stored probabilities and the rest sum to one."""
    counts, grams = Counter(), Counter()
    built = ngram_lm.Grams()
    saved, ngram_lm.MERGED_GRAMS = ngram_lm.MERGED_GRAMS, merged
    try:
        for row in rows:
            two = Counter(zip(row, row[1:], strict=False))
            three = Counter(zip(row, row[1:], row[2:], strict=False))
            counts, grams = counts + two, grams + three
            pairs = sorted(two)
            kids = {p: sorted((w, n) for (a, b, w), n in three.items() if (a, b) == p) for p in pairs}
            column = lambda x: np.array(x, np.uint32)
            built.add(
                column([a for a, _ in pairs]), column([b for _, b in pairs]), column([two[p] for p in pairs]), column([len(kids[p]) for p in pairs]),
                column([w for p in pairs for w, _ in kids[p]]), column([n for p in pairs for _, n in kids[p]]),
            )
        words = _Words()
        words._n = np.array([max(1, sum(n for (a, _), n in counts.items() if a == i)) for i in range(41)])
        arrays = built.trie(words)
    finally:
        ngram_lm.MERGED_GRAMS = saved
    pairs = [(int(p >> np.uint64(32)), int(p & np.uint64(0xFFFFFFFF))) for p in built.pairs]
    assert dict(zip(pairs, built.n2.tolist(), strict=True)) == dict(counts)
    got = {(*pairs[int(g >> np.uint64(32))], int(g & np.uint64(0xFFFFFFFF))): n for g, n in zip(built.grams, built.n3.tolist(), strict=True)}
    assert got == dict(grams)
    stored = np.bincount((built.grams >> np.uint64(32)).astype(int), ngram_lm._LEVELS[arrays["p3"]], len(pairs))
    assert np.allclose(stored + arrays["left"], 1, atol=1e-6) and (arrays["left"] > 0).all()
    assert (arrays["sum"] < 1).all()
