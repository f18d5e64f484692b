from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cases import EDGES
from pagemill.llm import decontaminate as d

WORDS = [f"{a}{b}" for a in ("tion", "er", "the", "ha", "st", "ou") for b in ("an", "in", "", "edly", "nt")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    for _ in range(edits):
        k, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:k] + ("" if kind == 0 else rng.choice("abcxyz ")) + text[k + (kind != 1) :]
    return text


def sellers(text, pattern):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (t != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=60), st.text("abc ", min_size=1, max_size=25))
def test_alignment(text, pattern):
    edits, start, stop = d.align(text, pattern, 100)
    assert edits == sellers(text, pattern) == d.least_edits(text, pattern)
    assert sellers(text[start:stop], pattern) == edits


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 2**31))
def test_every_region_within_the_budget_is_found(seed):
    rng = random.Random(seed)
    items = [(k, prose(rng, rng.choice([6, 15, 40]))) for k in range(6)]
    index = d.build_index(items)
    batch = []
    for _ in range(5):
        text = prose(rng, 30)
        for _, item in rng.sample(items, 2):
            text += " " + edited(rng, item.upper(), rng.choice([0, 2, 8, 14])) + "\n\t" + prose(rng, 20)
        batch.append(text)
    found = {(r, i) for r, i, *_ in d.find(batch, index)}
    want = {
        (r, int(index.item[s]))
        for r, t in enumerate(batch)
        for s, pattern in enumerate(index.segment)
        if sellers(d.normal(t), pattern) <= index.budget[s]
    }
    assert found == want


def test_documents(spark, docs):
    rng = random.Random(4)
    items = [(k, prose(rng, 40)) for k in range(5)] + [(9, None), (10, "short"), (None, prose(rng, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = EDGES + [(40 + k, f"{prose(rng, 50)} {t} {prose(rng, 9)}") for k, (_, t) in enumerate(items) if t] + [(60, prose(rng, 400)), (61, items[0][1] * 2 + items[1][1])]
    got = {(r.doc_id, r.item_id): r for r in d.leaks(docs(pairs), bench).collect()}
    assert set(got) == {(40, 0), (41, 1), (42, 2), (43, 3), (44, 4), (47, None), (61, 0), (61, 1)}
    assert all(r.edits == 0 for r in got.values())
    kept = d.without_leaks(docs(pairs), bench)
    assert kept.columns == docs([]).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in pairs if i not in (40, 41, 42, 43, 44, 47, 61))
    assert d.leaks(docs([]), bench).count() == 0
    assert d.leaks(docs(pairs), bench.limit(0)).count() == 0


def test_short_items_as_whole_words():
    items = [(1, "Who wrote Hamlet?"), (2, "art of"), (3, "the art"), (4, "\u8c01\u5199\u4e86\u54c8\u59c6\u96f7\u7279"), (5, "x" * 19)]
    index = d.build_index(items)
    batch = ["so: WHO  wrote Hamlet? Shakespeare", "who wrote a hamlet?", "bathe artist, breathe art", "See the art.", "\u95ee\u8c01\u5199\u4e86\u54c8\u59c6\u96f7\u7279\u5417", "x" * 20]
    found = [(r, index.items[i], edits, d.normal(batch[r])[a:b]) for r, i, a, b, edits in d.find(batch, index)]
    assert found == [(0, 1, 0, "who wrote hamlet?"), (3, 3, 0, "the art"), (4, 4, 0, items[3][1])]


def test_blocks_cover_the_benchmark(spark):
    bench = spark.createDataFrame([(k, f"item number {k} " * 5) for k in range(40)], "item_id long, text string")
    parts = list(d.blocks(bench, 500))
    assert len(parts) > 3 and sorted(i for p in parts for i, _ in p) == list(range(40))
