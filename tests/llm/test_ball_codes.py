import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from frameloom.llm import ball_codes

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
    # names that the operator uses itself
    T.StructField("id", T.StringType()), T.StructField("v", T.StringType()), T.StructField("code", T.StringType()), T.StructField("n", T.StringType()),
    T.StructField("_label", T.StringType()), T.StructField("error", T.StringType()), T.StructField("total", T.StringType()),
])


def make(spark, rows):
    return spark.createDataFrame([(i, v, la, *["x"] * 7) for i, v, la in rows], SCHEMA).repartition(3)


def expected(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Everything by comparing every part with every entry, in Python integers."""
    kept = [(i, [math.floor(x * scale) for x in v], la, v) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _, _ in kept), default=0)
    width = -(-width // parts) * parts
    w = width // parts
    cut = [[(v + [0] * width)[p * w: (p + 1) * w] for p in range(parts)] for _, v, _, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][3]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for j, members in groups.items():
                books[p][j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    final = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = Counter()
    for (_, _, la, _), e in zip(kept, errors, strict=True):
        by_label[la] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, "".join(f"{j:02x}" for _, j in f), e, by_label[la], sha) for (i, _, la, _), f, e in zip(kept, final, errors, strict=True))


def rows_of(df):
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    rows = [(i, [round(rng.gauss(i % 3, 0.4), 3) for _ in range(8)], rng.choice([1, 2, None])) for i in range(260)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, 1) for i in range(120)]  # a third are one vector
    rows += [(5, rows[9][1], 2), (5, rows[9][1], 2), (None, rows[3][1], None), (2000, None, 1), (2001, [1.0, None] * 4, 1), (2002, [math.nan] * 8, 2),
             (2003, [math.inf] + [0.0] * 7, 2), (2004, [0.5, -0.25], 3), (2005, [], 3), (-7, [0.0] * 8, 3)]
    return rows


def test_codes_are_those_of_comparing_all(spark, vectors):
    got = rows_of(ball_codes.encode(make(spark, vectors)))
    assert got == expected(vectors)


def test_small_codebooks_move_and_unused_entries_stay(spark, vectors):
    got = rows_of(ball_codes.encode(make(spark, vectors), entries=6, rounds=3))
    assert got == expected(vectors, entries=6, rounds=3)


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 2.0**14 for _ in range(8)], i % 2) for i in range(60)]
    rows += [(100 + i, [rng.random() * 2.0**17 for _ in range(8)], 1) for i in range(20)]
    got = rows_of(ball_codes.encode(make(spark, rows), entries=9))
    assert got == expected(rows, entries=9)


def test_components_beyond_a_long_are_held(spark):
    rows = [(1, [1e300, 0.0, 0.0, 0.0], 1), (2, [-1e300, 0.0, 0.0, 0.0], 1), (3, [1e300, 0.0, 0.0, 0.0], None)]
    got = {r["vec_id"]: (r["code"], r["error"]) for r in ball_codes.encode(make(spark, rows)).collect()}
    assert got == {1: ("00000000", 0), 2: ("01000000", 0), 3: ("00000000", 0)}


def test_few_rows_and_none(spark):
    few = [(3, [1.0, 2.0, 3.0, 4.0], None), (1, [1.0, 2.0, 3.0, 4.0], None)]
    assert rows_of(ball_codes.encode(make(spark, few))) == expected(few)
    assert ball_codes.encode(make(spark, [])).collect() == []
    assert ball_codes.encode(make(spark, [(1, None, 1), (2, [None], 1)])).collect() == []


def test_cores_and_rings_save_comparisons():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (64, 4)).astype(float)
    code = rng.integers(0, 64, 5000)
    x = centres[code] + rng.integers(-40, 40, (5000, 4))
    balls = ball_codes.Balls(centres)
    near, best = balls.assign(x, code)
    want, square = ball_codes.nearest(x, centres)
    assert (near == want).all() and (best == square).all()
    assert balls.compared < 5000 * 64 / 10


@pytest.mark.parametrize("seed", range(4))
def test_ties_go_to_the_lower_entry(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 3, (20, 2)).astype(float)  # many equal entries
    x = rng.integers(0, 4, (300, 2)).astype(float)
    near, _ = ball_codes.Balls(centres).assign(x, rng.integers(0, 20, 300))
    assert (near == ball_codes.nearest(x, centres)[0]).all()
