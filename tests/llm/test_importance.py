import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import make, sentence

from frameloom.llm.importance import grams, kth_greatest, models, resample
from frameloom.llm.textbytes import parts


def test_models_and_weights_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randrange(0, 40), ["a", "b", "c", "d"] if i % 2 else ["a", "x", "y"]), "en", "a") for i in range(60)]
    docs = make(spark, rows)
    got = {r["doc_id"]: r["log_weight"] for r in resample(docs, docs.where("doc_id % 2 = 1"), 0.5).collect()}
    raw, goal, own = np.zeros(1 << 16), np.zeros(1 << 16), {}
    for i, t, _, _ in rows:
        for words in parts(pa.array([t])):
            one, two = grams(words)
            own[i] = [*one, *[x for x in two if x >= 0]]
            assert len(own[i]) == max(2 * len(t.split()) - 1, 0)
            np.add.at(raw, own[i], 1)
            if i % 2:
                np.add.at(goal, own[i], 1)
    ratio = np.log((goal + 1) / (goal.sum() + (1 << 16))) - np.log((raw + 1) / (raw.sum() + (1 << 16)))
    for i, g in own.items():
        assert got[i] == pytest.approx(ratio[g].sum() if g else 0, abs=1e-9)


@pytest.mark.parametrize("values", [list(range(50)), [1.0] * 50, [0.0, 1e300, -1e300, *[0.5 + i * 1e-12 for i in range(40)]], [5.0]])
def test_kth_greatest(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in {1, 2, len(values) // 2 or 1, len(values)}:
        if k <= len(values):
            assert kth_greatest(df, "v", k) == sorted(map(float, values), reverse=True)[k - 1]


def test_kth_greatest_refines(spark):
    df = spark.range(60_000).selectExpr("pow(id, 3) as v")
    assert kth_greatest(df, "v", 20_000) == 40_000.0**3


def test_target_like_texts_are_kept(spark, docs, rows, none):
    rng = random.Random(4)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows2 = [(i, sentence(rng, 80, bad if i % 5 == 0 else good), "en", "a") for i in range(200)]
    two = make(spark, rows2)
    kept = {r["doc_id"] for r in resample(two, two.where("doc_id % 5 = 1"), 0.8).where("kept").collect()}
    assert kept == {i for i in range(200) if i % 5}
    got = resample(docs, docs.where("doc_id < 50"), 0.8)
    assert got.count() == len(rows) and got.where("log_weight is null or draw is null").count() == 0
    assert got.where("kept").count() >= round(0.8 * len(rows))
    assert resample(none, none, 0.8).count() == 0
    assert {r["log_weight"] for r in resample(two, none, 0.8).collect()} == {0.0}
