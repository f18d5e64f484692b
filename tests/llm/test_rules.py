from __future__ import annotations

import re
from collections import Counter

import pytest

from cases import EDGES
from pagemill.llm import rules

ODD = [
    (20, "a b c a b c a b"), (21, "x\nx\n\n \nx\ny"), (22, "a a a a a"), (23, "#|<> $ &&"), (24, "one two"), (25, "\x1cword\x85next \xa0 z"),
    (26, "l1 a b\r\nl1 a b\r\n" * 40), (27, " ".join(f"w{i}" for i in range(200))), (28, "a b c " * 10),
]


def brute(text: str):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(docs):
    pairs = EDGES + ODD
    got = rules.quality(docs(pairs)).collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == sorted((str(i), *brute(t or "")) for i, t in pairs)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in got if r.kept} == {27}
    assert rules.quality(docs([])).count() == 0


def test_policies_and_ablations(docs):
    rows = rules.ledger(docs(EDGES + ODD)).cache()
    loose = rules.Policy("loose", ("many_symbols", "few_words"))
    all_rows = rows.collect()
    kept = rules.apply_policy(rows, loose).filter("kept").count()
    assert kept == sum(1 for r in all_rows if r.n_words >= 50 and r.n_symbols * 10 <= r.n_words)
    by = {r.rule: r for r in rules.ablations(rows, loose).collect()}
    assert by["few_words"].failed == sum(r.n_words < 50 for r in all_rows)
    assert by["many_symbols"].failed_alone == sum(r.n_words >= 50 and r.n_symbols * 10 > r.n_words for r in all_rows)
    assert by["few_words"].kept_without == sum(r.n_symbols * 10 <= r.n_words for r in all_rows)


def test_native_plan(docs):
    plan = rules.quality(docs(ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


@pytest.mark.parametrize("words", [3, 4, 60])
def test_overlapping_windows(docs, words):
    text = "a b a b a b " + " ".join(f"u{i}" for i in range(words)) + " a b a"
    assert rules.quality(docs([(1, text)])).first()["n_repeat_words"] == brute(text)[4]
