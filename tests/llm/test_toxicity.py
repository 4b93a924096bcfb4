import random
import zlib

import pyarrow as pa
import pytest
from conftest import make, sentence
from pyspark.sql import functions as F

from frameloom.llm.toxicity import Table, _known, _toxic_given, differences, keep_civil, remainder, score, train

RUDE = ["zonk", "blarg", "frump"]


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(5)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(2000)]
    rows, labels = [], []
    for i in range(500):
        t = sentence(rng, 120, words).split()
        if i % 8 == 0:
            for _ in range(4):
                t[rng.randrange(len(t))] = rng.choice(RUDE)
        rows.append((i, " ".join(t), "en", "a"))
        labels.append((i, 1, int(i % 8 == 0)))
    return make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(marked):
    docs, labels = marked
    model = train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in score(docs, model).select("row.doc_id", "score").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 60
    assert sum((got[i] >= 0.5) == (i % 8 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())


def test_held_out_labels_are_not_used(marked):
    docs, labels = marked
    turned = labels.withColumn("toxic", F.when(remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = (sorted(tuple(r) for r in score(docs, train(docs, x)).select("row.doc_id", "score").collect()) for x in (labels, turned))
    assert a == b


def test_odd_texts_and_no_labels(docs, rows, none, marked, spark):
    model = train(*marked)
    got = score(docs, model)
    assert got.count() == len(rows)
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert score(none, model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert train(docs, empty) is None
    assert {r["score"] for r in score(docs, None).select("score").collect()} == {0.0}
    assert keep_civil(docs, empty).count() == len(rows)


def test_toxic_documents_go(marked):
    docs, labels = marked
    kept = keep_civil(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len([i for i in ids if i % 8 == 0]) <= 3 and len([i for i in ids if i % 8]) >= 430


def test_rare_and_folded_forms_count(spark):
    rng = random.Random(4)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(300)]
    rows = [(i, sentence(rng, 60, words) + (f" Scum*** w{i}" if i in (8, 16, 24, 32, 48, 56) else ""), "en", "a") for i in range(400)]
    model = train(make(spark, rows), spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400)], "doc_id long, quality int, toxic int"))
    table = Table(model.keys, model.ratio)
    scum, other, never, symbols, empty = differences(pa.array(["Scum***", "(SCUM!", "qqq", "!!!", None]), table)
    assert scum > 0.5 and other > 0.5 and never == symbols == empty == 0


def test_counts_back_off_and_leave_out_the_text_itself(spark):
    one = spark.createDataFrame([(3, 3, 0.2), (0, 1, 0.2), (1, 1, 0.2), (2, 5, 0.2), (0, 0, 0.2)], "t long, c long, up double")
    got = [r["p"] for r in one.select(_toxic_given(F.col("t"), F.col("c"), F.col("up")).alias("p")).collect()]
    for p, own in zip(got, [(2.25 + 0.15) / 3, 0.15, 0.25 + 0.15, (1.25 + 1.5 * 0.2) / 5, 0.2], strict=True):
        assert p == own == 0.2 or min(own, 0.2) < p < max(own, 0.2)  # between the next form and the discounted counts
    assert 0.5 < got[0] and got[1] < 0.2 < got[2]
    left = one.select(*_known(0.2)).collect()
    assert left[2]["less_t"] == left[1]["less_o"] == pytest.approx(0.2)
