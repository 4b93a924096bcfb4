import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import make

from frameloom.llm import pseudo_likelihood as P
from frameloom.llm.textbytes import parts


def small():
    rng = np.random.default_rng(0)
    net = P.Network({k: rng.normal(0, 0.3, s) for k, s in P._SHAPES.items()})
    ids = rng.integers(0, P.VOCABULARY, 30)
    return net, ids, P.contexts(ids, np.array([0, 12, 12, 13, 30]))


def test_contexts_stay_inside_a_text():
    around = P.contexts(np.arange(5), np.array([0, 3, 3, 5]))
    pad = P.PAD
    assert around.T.tolist() == [[pad, pad, 1, 2], [pad, 0, 2, pad], [0, 1, pad, pad], [pad, pad, 4, pad], [pad, 3, pad, pad]]


def test_conditional_probabilities_add_up_to_one():
    net, _, around = small()
    for t in (0, 7, 29):
        every = np.arange(P.VOCABULARY)
        assert np.exp(net.log_probability(every, np.repeat(around[:, t: t + 1], len(every), axis=1))).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_match_differences():
    net, ids, around = small()
    grads = net.gradients(ids, around)
    rng = np.random.default_rng(1)
    for name, g in grads.items():
        for flat in rng.choice(np.flatnonzero(g), 5):
            place, old = np.unravel_index(flat, g.shape), net.p[name].flat[flat]
            values = []
            for e in (1e-3, -1e-3):
                net.p[name][place] = old + e
                values.append(net.log_probability(ids, around).mean())
            net.p[name][place] = old
            assert (values[0] - values[1]) / 2e-3 == pytest.approx(g[place], rel=2e-2, abs=1e-4)


def test_scores_match_the_sum_over_words_and_order_counts(spark):
    rng = random.Random(6)
    cycle = [f"c{i}" for i in range(12)]
    rows = []
    for i in range(400):
        s = rng.randrange(12)
        rows.append((i, " ".join(cycle[(s + k) % 12] for k in range(60)), "en", "a"))
    docs = make(spark, rows)
    lexicon, net = P.train(docs)
    probe = make(spark, [(0, rows[0][1], "en", "a"), (1, " ".join(rng.sample(rows[0][1].split(), 60)), "en", "a"), (2, None, "en", "a"), (3, "", "en", "a")])
    got = {r["doc_id"]: (r["n_words"], r["log_likelihood"]) for r in P.score(probe, (lexicon, net)).select("row.doc_id", "n_words", "log_likelihood").collect()}
    assert got[0][1] > got[1][1] + 20 and got[2] == got[3] == (0, 0.0)
    for words in parts(pa.array([rows[0][1]]), lower=True):
        ids = lexicon.ids(words.hashes())
        one = [net.log_probability(ids[t: t + 1], P.contexts(ids, words.bounds)[:, t: t + 1])[0] for t in range(60)]
    assert got[0][1] == pytest.approx(sum(one), rel=1e-5)


def test_odd_texts_and_empty(docs, rows, none):
    got = P.score(docs, P.train(docs))
    assert got.count() == len(rows) and got.where("log_likelihood is null or isnan(log_likelihood)").count() == 0
    assert P.score(none, P.train(none)).count() == 0


def _many(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "of", f"q{rng.randrange(3000)}", f"q{rng.randrange(30)}"]) for _ in range(60)), "en", "a") for i in range(300)]
    return make(spark, rows), rows


def test_shared_entries_are_divided_among_their_words(spark):
    docs, rows = _many(spark)
    words = sorted({w for r in rows for w in r[1].split()})
    lexicon, net = P.train(docs)
    hashes = next(parts(pa.array([" ".join(words)]), lower=True)).hashes()
    rare = [k for k in range(len(words)) if lexicon.ids(hashes[k: k + 1])[0] >= P.FREQUENT]
    known = lexicon.counts
    assert len(rare) == len(words) - P.FREQUENT == len(known.words)
    for e in range(P.SHARED):
        n = known.n[(known.words % np.uint64(P.SHARED)).astype(int) == e]
        inside = np.exp(known.log_share(np.full(len(n), e), n)).sum()
        never = np.exp(known.log_share(np.array([e]), np.array([0])))[0]
        assert inside + never * 2.0**64 / P.SHARED == pytest.approx(1)
    seen = {}
    for k in rare:
        seen.setdefault(int(hashes[k] % np.uint64(P.SHARED)), words[k])
    # a word never met scores below one of the same entry
    odd = next(w for w in (f"zzz{i}" for i in range(100)) if int(next(parts(pa.array([w]))).hashes()[0] % np.uint64(P.SHARED)) in seen)
    twin = seen[int(next(parts(pa.array([odd]))).hashes()[0] % np.uint64(P.SHARED))]
    probe = make(spark, [(0, f"the {twin} of", "en", "a"), (1, f"the {odd} of", "en", "a")])
    got = {r["doc_id"]: r["log_likelihood"] for r in P.score(probe, (lexicon, net)).select("row.doc_id", "log_likelihood").collect()}
    assert got[0] > got[1] + 5


def test_joined_counts_give_the_scores_of_broadcast_ones(spark, monkeypatch):
    docs, rows = _many(spark)
    probe = docs.union(make(spark, [(900, "the never met of never q1", "en", "a"), (901, None, "en", "a"), (901, None, "en", "a")])).union(docs.limit(1))
    got = []
    for head in (P.HEAD, 40, 0):
        monkeypatch.setattr(P, "HEAD", head)
        lexicon = P.vocabulary(docs)
        assert lexicon.counts.every == (head > 40) and len(lexicon.counts.words) <= head
        scored = P.score(probe, (lexicon, P.Network.fresh()))
        assert scored.columns == ["row", "n_words", "log_likelihood"]
        got.append(sorted((r["doc_id"], r["n_words"], round(r["log_likelihood"], 6)) for r in scored.select("row.doc_id", "n_words", "log_likelihood").collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows) + 4


def test_every_position_is_trained_once(spark, monkeypatch):
    docs, rows = _many(spark)
    weights, copies = [], P.stage

    def watched(df, name):
        out = copies(df, name)
        if name == "copies":
            weights.append(sum(r["words"] for r in out.select("words").collect()))
        return out

    monkeypatch.setattr(P, "stage", watched)
    P.train(docs)
    assert len(weights) == P.ROUNDS and min(weights) > 0
    assert sum(weights) == sum(len(r[1].split()) for r in rows)
    words = next(parts(pa.array([r[1] for r in rows[:9]]), lower=True))
    alone = [P.round_of(w.hashes(), w.bounds, 2) for r in rows[:9] for w in parts(pa.array([r[1]]), lower=True)]
    assert (P.round_of(words.hashes(), words.bounds, 2) == np.concatenate(alone)).all()
