from __future__ import annotations

import random

import numpy as np
import pytest

from cases import EDGES
from pagemill.llm import near_copies
from pagemill.llm.near_copies import fingerprint, layout


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def survivors(rows):
    """One row of each component of exact similarity 0.8 or more: the least id, null last; equal rows are one."""
    kept = list(dict.fromkeys(rows))
    sets = [shingles(t) for _, t in kept]
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for row, x in zip(kept, label, strict=True):
        groups.setdefault(x, []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def edited(rng, vocabulary, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.6:
            out[at] = rng.choice(vocabulary)
        elif kind < 0.8:
            out.insert(at, rng.choice(vocabulary))
        elif len(out) > 10:
            del out[at]
    return out


@pytest.mark.parametrize("rows", [1_000, 250_000, 1_000_000])
def test_recall_from_similarity_08_on(rows):
    """Share of pairs that meet in a band and lie within the radius, by exact similarity."""
    rng, (band, bands, words, radius) = random.Random(4), layout(rows)
    vocabulary = [f"w{k}" for k in range(2000)]
    met = {}
    for _ in range(500):
        a = [rng.choice(vocabulary) for _ in range(rng.choice((50, 120, 400)))]
        b = edited(rng, vocabulary, a, rng.uniform(0.002, 0.05))
        similarity = jaccard(shingles(" ".join(a)), shingles(" ".join(b)))
        x = np.bitwise_xor(*(np.frombuffer(fingerprint(" ".join(t), words), np.uint64) for t in (a, b)))
        bits = np.unpackbits(x.view(np.uint8), bitorder="little")
        near = bits.sum() <= radius and not bits[: band * bands].reshape(bands, band).any(1).all()
        met.setdefault("0.8" if 0.8 <= similarity < 0.85 else "0.85" if 0.85 <= similarity < 1 else "below 0.6" if similarity < 0.6 else "between", []).append(near)
    assert np.mean(met["0.8"]) >= 0.85 and np.mean(met["0.85"]) >= 0.98
    assert np.mean(met.get("below 0.6", [0])) < 0.1


def test_unrelated_texts_stay(spark, docs):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(400)]
    assert near_copies.one_of_each(docs(rows)).count() == 400


def test_edges(docs):
    got = near_copies.one_of_each(docs(EDGES).repartition(3)).collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=repr) == sorted(((i, t or "") for i, t in survivors(EDGES)), key=repr)
    assert near_copies.one_of_each(docs([])).count() == 0


def test_near_copies_against_exact_similarity(docs):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(1500)]
    rows = []
    for k in range(40):
        a = [rng.choice(vocabulary) for _ in range(150)]
        rows.append((10 * k, " ".join(a)))
        rows += [(10 * k + j, " ".join(edited(rng, vocabulary, a, 0.007))) for j in range(1, rng.randint(1, 5))]
    got = near_copies.one_of_each(docs(rows).repartition(4)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(survivors(rows))


def test_large_buckets_in_chunks(spark):
    """Links found in chunks equal those found in whole buckets."""
    rng = np.random.default_rng(3)
    band, bands, words, radius = 11, 23, 4, 44
    base = rng.integers(0, 2**63, (40, words), dtype=np.uint64)
    rows = []
    for k in range(400):
        x = base[k % 40].copy()
        for bit in rng.integers(0, 256, 6):
            x[bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
        rows.append((x.tobytes(),))
    df = spark.createDataFrame(rows, "fp binary").distinct()
    from pagemill.llm.components import components

    groups = []
    for hot in (10, 100_000):
        out = components(near_copies.near_links(df, band, bands, words, radius, hot)).collect()
        groups.append({bytes(r.node): bytes(r.root) for r in out})
    assert groups[0] == groups[1] and len(set(groups[0].values())) == 40
