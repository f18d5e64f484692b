from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cases import EDGES
from pagemill.llm import bpe
from pagemill.llm.tokens import public_file

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
PARTS = [
    " ", "  ", "\n", "\t ", "don't", "It's", "abc", "Été", "é", "İ", "中文", "42", "!?", ".", "<|endoftext|>",
    "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "\x1c", " ", "ΣΣ", "Word.", "\r\n", "</w>", "\U0001f600", "ǅ", "\x00", "a" * 50,
]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_file(request.param)
    return Tokenizer.from_file(path), bpe.MergeEncoder(path), bpe.Decoder(path)


def _same(pair, text):
    library, encoder, decoder = pair
    want = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode(pa.array([None, text, "x"]))
    assert np.frombuffer(got[1], "<u4").tolist() == want
    assert got[0] == b""
    assert decoder.decode([b"", got[1]]) == [b"", library.decode(want, skip_special_tokens=False).encode()]


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS)))
def test_like_the_library_on_odd_parts(pair, parts):
    _same(pair, "".join(parts))


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_like_the_library_on_any_text(pair, text):
    _same(pair, text)


@pytest.mark.parametrize("text", ["ab" * 30_000, "x" * 100_000, "lower newest widest " * 5_000, "!?" * 20_000])
def test_like_the_library_on_long_pieces(pair, text):
    _same(pair, text)


def test_any_ids_decode_like_the_library(pair):
    library, _, decoder = pair
    rng = np.random.default_rng(3)
    for _ in range(50):
        ids = rng.integers(0, library.get_vocab_size(), 40).astype("<u4")
        assert decoder.decode([ids.tobytes()]) == [library.decode(ids.tolist(), skip_special_tokens=False).encode()]
    assert decoder.decode([np.array([5, 10_000_000, 6], "<u4").tobytes()]) == decoder.decode([np.array([5, 6], "<u4").tobytes()])


def _digests(path, pairs):
    library, out = Tokenizer.from_file(path), []
    for i, text in pairs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edges(docs):
    for name in FILES:
        path = public_file(name)
        got = bpe.round_trip_digests(docs(EDGES).repartition(3), path).collect()
        assert sorted(map(tuple, got), key=repr) == _digests(path, EDGES)
        assert bpe.round_trip_digests(docs([]), path).count() == 0


def test_operators_round_trip(spark, docs):
    path = public_file("byte_bpe_50k.json")
    texts = [(1, "Plain  text,\n twice."), (2, None), (None, "été \U0001f600"), (2, "<|endoftext|>x")]
    back = bpe.decode(bpe.encode(docs(texts), path), path).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((i, t or "") for i, t in texts), key=repr)
    odd = spark.createDataFrame([(1, None), (2, [1, None, -4, 70_000]), (3, [1])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, path).collect()} == {1: "", 2: '"', 3: '"'}


def test_query_on_given_documents(spark):
    from pagemill.llm.queries import QUERIES

    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op12_bpe"](spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == _digests(public_file("word_bpe_49k.json"), pairs)
