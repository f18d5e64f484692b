from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import EDGES
from pagemill.llm import importance
from pagemill.llm.prefix_crc import Scanned, moved_on, substring_crcs

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def grams(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute(docs, target, least_words=20, percent=25):
    def counts(rows):
        out = [0] * 10_000
        for text in rows:
            for g in grams(text):
                out[zlib.crc32(g.encode()) % 10_000] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        f = grams(text)
        weight = sum(gain[zlib.crc32(g.encode()) % 10_000] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    able = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return rows, drawn


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=700), st.data())
def test_crc_of_any_substring(text, data):
    lo = data.draw(st.integers(0, len(text)))
    hi = data.draw(st.integers(lo, len(text)))
    one = lambda x: np.array([x], np.uint32)
    got = substring_crcs(one(zlib.crc32(text[:lo])), one(zlib.crc32(text[:hi])), np.array([hi - lo]))
    assert got[0] == zlib.crc32(text[lo:hi])


def test_crc_moves_over_long_stretches():
    n = np.array([0, 1, 63, 64, 65, 4096, 100_000, 123_457])
    got = moved_on(np.full(len(n), zlib.crc32(b"start"), np.uint32), n)
    assert got.tolist() == [zlib.crc32(b"start" + b"\0" * k) ^ zlib.crc32(b"\0" * k) for k in n.tolist()]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aZ09 .-é中\U0001f600\x00\x7f", max_size=60), max_size=6), st.integers(1, 4))
def test_ngrams_of_documents(rows, n):
    crcs, runs = Scanned([r.encode() for r in rows]).ngrams(n)
    want = [[" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] for w in map(words, rows)]
    assert runs.tolist() == [len(x) for x in want]
    assert crcs.tolist() == [zlib.crc32(g.encode()) for x in want for g in x]


def check(got, docs, target, least_words=20):
    rows, drawn = brute(docs, target, least_words)
    assert sorted((repr(r.doc_id), r.n_features, r.weight, r.score) for r in got) == sorted((repr(r[0]), *r[1:4]) for r in rows)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[3]) for r in drawn]


def test_edges(spark, docs):
    target = spark.createDataFrame([("word a b",), (None,), ("été",)], "text string")
    texts = [r.text for r in target.collect()]
    check(importance.importance_sample(docs(EDGES).repartition(3), target, least_words=1).collect(), EDGES, texts, 1)
    check(importance.importance_sample(docs(EDGES), target.limit(0)).collect(), EDGES, [])
    assert importance.importance_sample(docs([]), target).count() == 0


def test_hot_id_and_repeated_rows_spread(spark, docs):
    """A third of all rows are one row: their ranks are spread over tasks and still without gaps."""
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(i, f"{text} {i}") for i in range(600)] + [(5, text)] * 300
    got = importance.importance_sample(docs(rows).repartition(4), spark.createDataFrame([("three four",)], "text string")).collect()
    check(got, rows, ["three four"])


@pytest.mark.parametrize("folder", [SMALL])
def test_query_on_given_documents(spark, folder):
    from pagemill.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    check(QUERIES["op11_importance_sample"](spark, folder).collect(), docs, target)
