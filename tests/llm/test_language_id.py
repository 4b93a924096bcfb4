import itertools
import random
import zlib

import numpy as np
import pytest
from conftest import make, sentence

from frameloom.llm import language_id as L

PARTS = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "eit", "ung", "ver"], "cc": ["ció", "ñez", "dad", "los"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, "abc"[i % 3] * 2, 50), "abc"[i % 3] * 2, "s") for i in range(240)]
    return make(spark, rows), rows


def test_posteriors_match_enumeration():
    rng = np.random.default_rng(2)
    scores, bounds = rng.normal(0, 1, (9, 3)), np.array([0, 4, 4, 9])
    step, start = rng.normal(0, 1, (3, 3)), np.zeros(3)
    got = L.posteriors(scores, bounds, step, start)
    for a, b in ((0, 4), (4, 9)):
        total = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(sum(scores[a + t, y] for t, y in enumerate(path)) + sum(step[x, y] for x, y in itertools.pairwise(path)))
            for t, y in enumerate(path):
                total[t, y] += w
        assert np.allclose(got[a:b], total / total.sum(axis=1, keepdims=True))


def test_held_out_accuracy_and_switches(spoken, spark):
    docs, rows = spoken
    field = L.train(docs)
    got = {r["doc_id"]: r for r in L.identify(docs, field).select("row.doc_id", "lang_pred", "score").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.98 * len(held)
    rng = random.Random(1)
    half = make(spark, [(0, text(rng, "aa", 60) + " " + text(rng, "bb", 40), None, "s")])
    r = L.identify(half, field).collect()[0]
    assert r["lang_pred"] == "aa" and 0.5 < r["score"] < 0.7


def test_odd_texts(spoken, docs, rows, none):
    field = L.train(spoken[0])
    got = L.identify(docs, field).select("row.text", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert L.identify(none, field).count() == 0
    assert L.train(none) is None
    assert {r["lang_pred"] for r in L.identify(docs, None).collect()} == {"und"}


def test_held_out_rows_are_not_learned(spark):
    rng = random.Random(3)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert L.train(make(spark, [(i, sentence(rng, 20, ["a", "b"]), "xx", "s") for i in held])) is None


def test_short_texts_are_learned_and_null_ids_are_not(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, "aa" if i % 2 else "bb", 1 + i % 9), "aa" if i % 2 else "bb", "s") for i in range(600)]
    docs = make(spark, rows)
    field = L.train(docs)
    got = L.identify(docs, field).select("row.doc_id", "lang_pred").collect()
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in got) >= 0.9 * len(got)
    assert L.train(make(spark, [(None, t, la, "s") for _, t, la, _ in rows])) is None


def test_a_hot_row_does_not_fill_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "fit", lambda texts, langs, **_: seen.append(texts))
    L.train(make(spark, [(3, "one hot text", "xx", "s")] * 500 + [(4 + i, f"text number {i}", "xx", "s") for i in range(100)]), per_lang=40)
    assert 10 <= len(seen[0]) <= 90 and len(set(seen[0])) == len(seen[0])
