import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from frameloom.llm import graph_search

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    # names that the operator uses itself
    T.StructField("id", T.StringType()), T.StructField("v", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("score", T.StringType()),
])


def make(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 6) for i, v in rows], SCHEMA).repartition(3)


def cosine(a, b):
    n = max(len(a), len(b))
    a, b = (list(x) + [0.0] * (n - len(x)) for x in (a, b))
    p, q = max(map(abs, a)), max(map(abs, b))
    a, b = [x / p for x in a], [x / q for x in b]
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def lists(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_row"], r["rank"])):
        out[r["query_row"], r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.5) for c in centres[i % 12]]) for i in range(900)]
    hot = rows[4][1]
    rows += [(2000 + i, hot) for i in range(400)]  # a third are one vector
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [1.0, None] * 8), (3003, [math.nan] * 16), (3004, [math.inf] + [1.0] * 15), (None, hot),
             (3005, [1.0, -2.0]), (3006, []), (7, rows[20][1]), (3007, [x * 1e200 for x in rows[30][1]]), (3008, [x * 1e-200 for x in rows[31][1]])]
    return rows


def test_finds_the_nearest(spark, vectors):
    rows = [(i, v) for i, v in vectors if i is not None and usable(v)]
    asked = [(i, v) for i, v in vectors if i is None or i % 25 == 0 or i > 2990]
    graphs = graph_search.index(make(spark, vectors), shard_rows=400)
    assert graphs.count() == 4
    assert sorted(i for r in graphs.collect() for i in r["ids"]) == sorted(i for i, _ in rows)
    got = lists(graph_search.search(graphs, make(spark, asked), k=5))
    assert sorted(q for _, q in got) == sorted(i for i, v in asked if i is not None and usable(v))
    own = dict(asked)
    hits = total = 0
    for (_, q), found in got.items():
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        want = sorted((-round(cosine(own[q], v), 12), i) for i, v in rows if i != q)[:5]
        for _, i, s in found:
            assert i != q and any(j == i and math.isclose(s, cosine(own[q], v), abs_tol=1e-12) for j, v in rows)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i in want} & {i for _, i, _ in found})
        total += 5
    assert hits >= 0.95 * total


def test_equal_vectors_come_by_id(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50, 0, -1)] + [(100 + i, [2.0, float(i)]) for i in range(5)]
    graphs = graph_search.index(make(spark, rows), shard_rows=20)
    (_, found), = lists(graph_search.search(graphs, make(spark, [(2, [1.0, 2.0])]), k=6)).items()
    assert [i for _, i, _ in found] == [1, 3, 4, 5, 6, 7] and {s for _, _, s in found} == {found[0][2]}


def test_repeated_queries_have_their_own_lists(spark):
    rows = [(i, [1.0, float(i)]) for i in range(20)]
    graphs = graph_search.index(make(spark, rows))
    got = lists(graph_search.search(graphs, make(spark, [(3, [1.0, 3.0]), (3, [1.0, 3.0]), (3, [1.0, 0.0])]), k=4))
    assert len(got) == 3 and all(len(f) == 4 for f in got.values())
    assert sorted(f[0][1] for f in got.values()) == [0, 4, 4] or sorted(f[0][1] for f in got.values()) == [0, 2, 2]


def test_few_rows_and_none(spark):
    graphs = graph_search.index(make(spark, [(1, [1.0]), (2, [-1.0])]))
    got = graph_search.search(graphs, make(spark, [(1, [1.0, 0.0])]), k=5).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 2, -1.0)]
    assert graph_search.search(graphs, make(spark, [])).collect() == []
    empty = graph_search.index(make(spark, []))
    assert graph_search.search(empty, make(spark, [(1, [1.0])])).collect() == []
    alone = graph_search.index(make(spark, [(1, [1.0])]))
    assert graph_search.search(alone, make(spark, [(1, [1.0])])).collect() == []


def test_pruning_keeps_nearest_and_diverse_edges():
    rng = np.random.default_rng(0)
    vectors = graph_search.units(rng.normal(size=(60, 5)))
    own, proposed = np.arange(60), np.tile(np.arange(60), (60, 1))
    out = graph_search.prune(vectors, own, proposed, 8, 1.2)
    for p in range(60):
        far = ((vectors - vectors[p]) ** 2).sum(axis=1)
        left, want = [i for i in np.argsort(far) if i != p], []
        while left and len(want) < 8:
            want.append(left.pop(0))
            left = [i for i in left if 1.44 * ((vectors[i] - vectors[want[-1]]) ** 2).sum() > far[i]]
        assert [i for i in out[p] if i >= 0] == want
