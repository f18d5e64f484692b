from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cases import EDGES
from pagemill.llm import packing, shared, token_file
from pagemill.llm.tokens import encoder, public_file

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def direct(name: str, text: str) -> bytes:
    tokenizer = Tokenizer.from_file(public_file(name))
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", FILES)
def test_cuts_do_not_change_ids(name):
    tokenizer = Tokenizer.from_file(public_file(name))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from([" ", "  ", "\n", "\t ", "don't", "It's", "abc", "\u00c9t\u00e9", "e\u0301", "\u0130", "\u4e2d", "42", "!?", ".", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\u00a0", "\u03a3", "Word.", "\r\n"])))
    def check(parts):
        text = "".join(parts)
        assert encoder(public_file(name)).encode(pa.array([None, text, "x"]))[1] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    check()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=30), max_size=8))
def test_token_file_round_trip(rows):
    ids = np.array([i for r in rows for i in r], np.uint32)
    parts = token_file.pack_file([None if i == 1 else i for i in range(len(rows))], np.array([len(r) for r in rows], np.int64), ids)
    file = token_file.TokenFile(b"".join(parts))
    assert [file.document(k).tolist() for k in range(len(rows))] == rows
    pick = np.random.default_rng(0).permutation(len(ids))
    assert (file.take(pick) == ids[pick]).all()


def test_token_file_many_blocks():
    ids = np.random.default_rng(1).choice([3, 300, 70_000, 2**31], 20_000).astype(np.uint32)
    file = token_file.TokenFile(b"".join(token_file.pack_file([1], np.array([20_000]), ids)))
    for lo, hi in ((0, 20_000), (511, 513), (64, 64), (1, 19_999), (700, 5000)):
        assert (file.span(lo, hi) == ids[lo:hi]).all()
    pick = np.random.default_rng(2).permutation(20_000)
    assert (file.take(pick) == ids[pick]).all()


def test_token_file_edges(spark, docs):
    df = docs(EDGES).repartition(3)
    files = token_file.write_tokens(df, public_file("word_bpe_49k.json"), shared.new_folder(spark, "t"), file_tokens=100)
    got = [tuple(r) for r in token_file.read_tokens(files).collect()]
    want, start = [], 0
    for i, t in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = direct("word_bpe_49k.json", t or "") + np.array([2], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(got, key=lambda r: r[1]) == want
    empty = token_file.write_tokens(docs([]), public_file("word_bpe_49k.json"), shared.new_folder(spark, "t"))
    assert token_file.read_tokens(empty).count() == 0


def test_token_file_cuts_a_hot_id(spark, docs):
    """Two thirds of all rows under one id, half of them whole copies: no partition has much more than its share."""
    rows = [(i, f"text {i}") for i in range(1000)] + [(7, "the same text")] * 1000 + [(7, f"other text {i}") for i in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be put into one task
    try:
        files = token_file.write_tokens(docs(rows).repartition(4), public_file("word_bpe_49k.json"), shared.new_folder(spark, "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r.n_docs for r in files.collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1500 and len(sizes) >= 3
    got = [tuple(r) for r in token_file.read_tokens(files).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted(i for i, _ in rows)
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    tokenizer = Tokenizer.from_file(public_file("word_bpe_49k.json"))
    coded = tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False)
    want = [zlib.crc32(np.array([*c.ids, 2], "<u4").tobytes()) for c in coded]
    assert sorted(r[3] for r in got) == sorted(want)


def _valid(rows, want, capacity=1024):
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for inside in bins.values():
        at = 0
        for r in sorted(inside, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins)


def _pieces(pairs):
    want = []
    for i, t in pairs:
        ids = direct("byte_bpe_50k.json", t or "") + np.array([2], "<u4").tobytes()
        n = len(ids) // 4
        cuts = [0, *range((n - 1) % 1024 + 1, n + 1, 1024)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return want


def test_packing_edges(docs):
    rows = packing.pack_documents(docs(EDGES), public_file("byte_bpe_50k.json")).collect()
    _valid(rows, _pieces(EDGES))
    assert packing.pack_documents(docs([]), public_file("byte_bpe_50k.json")).count() == 0


def test_packing_given_documents(spark):
    from pagemill.llm.queries import QUERIES

    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = _pieces(pairs)
    used = _valid(QUERIES["op8_best_fit_packing"](spark, SMALL).collect(), want)
    assert used <= -(-sum(w[3] for w in want) // 1024) + 1


def test_local_search_empties_bins():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(150, 600, 300)
        first = packing.best_fit(lengths, 1024)
        last = packing.local_search(lengths, first, 1024)
        assert np.bincount(last, lengths).max() <= 1024
        assert len(np.unique(last)) <= len(np.unique(first))
