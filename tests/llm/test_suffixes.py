from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cases import EDGES
from pagemill.llm import suffixes

SMALL = "/root/testdata/sf0.001"


def brute(pairs, width=200):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in pairs]
    for _, raw in raws:
        seen.update(raw[s : s + width] for s in range(len(raw) - width + 1))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            if seen[raw[s : s + width]] > 1:
                gone[s : s + width] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((str(i), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def prose(rng, n):
    return " ".join(rng.choice(["la", "tion", "der", "été", "of", "the"]) + str(rng.randrange(30)) for _ in range(n))


def cases(seed, docs=24):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (30, 38, 60, 200)]
    pairs = []
    for i in range(docs):
        parts = [prose(rng, rng.choice([0, 3, 40]))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 3 + 1)
            parts += [p[cut:], prose(rng, rng.choice([0, 1, 30]))]
        pairs.append((i, " ".join(parts)))
    return [*pairs, (100, pairs[3][1]), (101, pairs[3][1]), (102, "ab" * 180), (103, "x" * 199), (104, "x" * 200), (105, "q" * 200 + "\0" * 300), (106, "\0" * 250)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    pairs = cases(seed)
    assert got(suffixes.remove_repeats(docs(pairs).repartition(3))) == brute(pairs)


def test_hot_grams(docs):
    pairs = cases(3, 16)
    assert got(suffixes.remove_repeats(docs(pairs), hot=2)) == brute(pairs)


def test_edges(docs):
    assert got(suffixes.remove_repeats(docs(EDGES))) == brute(EDGES)
    assert suffixes.remove_repeats(docs([])).count() == 0


def test_given_documents(spark):
    from pagemill.llm.queries import QUERIES

    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(QUERIES["op6_suffix_dedup"](spark, SMALL)) == brute(pairs)


def test_multikey_sort():
    rng = np.random.default_rng(0)
    for width in (5, 8, 21):
        rows = [bytes(rng.integers(0, 2, rng.integers(0, width + 1), np.uint8)) for _ in range(200)]
        size = np.array([len(r) for r in rows])
        matrix = np.zeros((200, width), np.uint8)
        for k, r in enumerate(rows):
            matrix[k, : len(r)] = list(r)
        order, shared = suffixes.multikey_sort(matrix, size)
        ranked = [rows[k] for k in order]
        assert ranked == sorted(rows)
        for a, b, n in zip(ranked, ranked[1:], shared[1:], strict=False):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
