from __future__ import annotations

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import EDGES
from pagemill.llm import simhash
from pagemill.llm.components import components

SMALL = "/root/testdata/sf0.001"


def plain(text: str) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def brute(pairs):
    fps = [plain(t or "") for _, t in pairs]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    ids = {}
    for i, (doc, _) in enumerate(pairs):
        ids.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return sorted([(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(pairs)], key=repr)


def got(df):
    return sorted([(r.doc_id, r.fingerprint, r.component_id) for r in df.select("doc_id", "fingerprint", "component_id").collect()], key=repr)


def test_edges(docs):
    assert got(simhash.near_duplicates(docs(EDGES))) == brute(EDGES)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_given_documents(spark):
    from pagemill.llm.queries import QUERIES

    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(QUERIES["op4_simhash"](spark, SMALL)) == brute(pairs)


def _brute_groups(values, radius):
    n = len(values)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(n)
    while True:
        best = np.where(near, label[None, :], n).min(1)
        if (best == label).all():
            return label
        label = best


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 5), st.integers(1, 300))
def test_bit_sliced_buckets(seed, radius, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    values = base[rng.integers(0, 5, n)]
    for _ in range(6):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * rng.integers(0, 2, n).astype(np.uint64)
    labels = simhash.link_buckets(values, np.array([0]), radius)
    assert (labels == _brute_groups(values, radius)).all()


def test_links_with_hot_buckets(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**62, 40)
    values = set(centre.tolist())
    for _ in range(3):
        values |= {int(v) ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))) for v in list(values)}
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for hot in (4096, 8):
        roots = {r.node: r.root for r in components(simhash.near_links(df, 4, hot)).collect()}
        label = _brute_groups(np.array(values, np.uint64), 4)
        assert [roots.get(v, v) for v in values] == [values[k] for k in label]


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (None, 3), (2000, 2001)], "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    assert roots == {i: 0 for i in range(1, 301)} | {2001: 2000}
