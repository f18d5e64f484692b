from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cases import EDGES
from pagemill.llm import langid, toxicity

GIVEN = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def test_ngrams_against_brute_force():
    batch = ["Hello, World 42", "", "Ünïcödé x", None or "", "a", "123"]
    buckets, starts = langid.ngram_buckets(batch)
    for k, text in enumerate(batch):
        clean = " " + langid.LETTERS.sub(" ", text.lower()).strip(" ") + " "
        want = sum(max(0, len(clean) - n + 1) for n in langid.ORDERS) if len(clean) > 2 else 0
        assert starts[k + 1] - starts[k] == want
    alone = [langid.ngram_buckets([t])[0].tolist() for t in batch]
    assert [sorted(buckets[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)] == [sorted(a) for a in alone]


def test_bayes_against_brute_force(docs):
    from pyspark.sql import functions as F

    texts = {"en": "the cat and the dog", "de": "der hund und die katze", "fr": "le chien et la souris"}
    pairs = [(k, f"{texts[lang]} {k}") for k, lang in enumerate(list(texts) * 20)]
    lang = F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("doc_id") % 3 + 1).cast("int"))
    df = docs(pairs).withColumn("lang", lang)
    langs, matrix = langid.train(df.filter("doc_id % 5 != 0"))
    counts, rows = defaultdict(Counter), Counter()
    for i, t in pairs:
        if i % 5:
            counts[list(texts)[i % 3]].update(langid.ngram_buckets([t])[0].tolist())
            rows[list(texts)[i % 3]] += 1
    assert langs == sorted(texts)
    for c, name in enumerate(langs):
        total = sum(counts[name].values()) + 0.5 * langid.BUCKETS
        for b, n in counts[name].items():
            assert matrix[b, c] == pytest.approx(np.log((n + 0.5) / total), rel=1e-5)
        assert matrix[-1, c] == pytest.approx(np.log((rows[name] + 1) / (sum(rows.values()) + 3)), rel=1e-5)
    out = {r.doc_id: r for r in langid.language_id(df).collect()}
    assert all(out[i].lang_pred == list(texts)[i % 3] and out[i].held_out == (crc(i) % 5 == 0) for i, _ in pairs)


def test_language_edges(docs):
    out = langid.language_id(docs(EDGES)).collect()
    assert len(out) == len(EDGES) and all(r.lang_pred == "und" and r.score == 0 for r in out)  # nothing is labelled
    from pyspark.sql import functions as F

    some = docs([*EDGES, *[(k, "plain english words here") for k in range(20, 40)]]).withColumn("lang", F.when(F.col("doc_id") >= 20, "en"))
    by = {r.doc_id: r for r in langid.language_id(some).collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[4].lang_pred == "und" and by[5].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in by.values())
    assert langid.language_id(docs([])).count() == 0


def test_language_held_out(spark):
    from pagemill.llm.queries import QUERIES

    rows = QUERIES["op2_language_id"](spark, GIVEN).join(spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 100 and sum(held) >= 0.98 * len(held)


def test_words_and_pairs_against_brute_force():
    batch = pa.array(["Ab ab, cd", None, "x", "ab" + "\n" + "cd ef gh ij"])
    words, row = toxicity.word_hashes(batch)
    assert row.tolist() == [0, 0, 0, 2, 3, 3, 3, 3, 3]
    assert words[0] == words[1] == words[4] and words[2] == words[5] and len(set(words.tolist())) == 6
    bucket, at = toxicity.features(batch)
    assert Counter(at.tolist()) == {0: 3 + 2 + 1, 2: 1, 3: 5 + 4 + 3 + 2}
    whole = set(zip(*[x.tolist() for x in toxicity.present(batch)], strict=True))
    apart = {(k, b) for k in range(4) for b in toxicity.present(batch.slice(k, 1))[1].tolist()}
    assert whole == apart


def test_ftrl_against_plain_updates():
    rng = np.random.default_rng(0)
    model, z, n = toxicity.Ftrl(), defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0 if i == 1 << toxicity.BITS else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + np.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(300):
        at, label = rng.choice(20, 5, replace=False), int(rng.integers(0, 2))
        model.learn(at, label)
        both = [*at.tolist(), 1 << toxicity.BITS]
        w = {i: weight(i) for i in both}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in both:
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert model.weights(np.arange(20)) == pytest.approx([weight(i) for i in range(20)])


def test_toxicity_learns_and_takes_edges(spark, docs):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    pairs = [(k, " ".join(rng.choice(words, 40)) + (" you idiot" if k % 4 == 0 else "")) for k in range(20, 620)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i, _ in pairs] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    by = {r.doc_id: r for r in toxicity.toxicity(docs([*EDGES, *pairs]), labels).collect()}
    held = [by[i] for i, _ in pairs if crc(i) % 4 == 2]
    assert all(r.held_out for r in held) and len(held) > 80
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in by.values())
    assert by[1].score == by[2].score == by[4].score
    none = toxicity.toxicity(docs(EDGES), labels.limit(0)).collect()
    assert len(none) == len(EDGES) and all(r.score == 0.5 for r in none)
    assert toxicity.toxicity(docs([]), labels).count() == 0


def test_toxicity_held_out(spark):
    from pagemill.llm.queries import QUERIES

    rows = QUERIES["op3_toxicity"](spark, GIVEN).join(spark.read.parquet(f"{GIVEN}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    clean = [r for r in held if not r.toxic]
    assert clean and sum(r.predicted for r in clean) <= 0.03 * len(clean)
    order = sorted(held, key=lambda r: -r.score)
    ranks = [k for k, r in enumerate(order) if r.toxic]
    auc = 1 - (sum(ranks) - len(ranks) * (len(ranks) - 1) / 2) / (len(ranks) * len(clean))
    assert auc > 0.7  # about 300 labelled rows are learned here
