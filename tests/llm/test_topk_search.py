import math
import random

import numpy as np
import pytest

from frameloom.llm import topk_search
from frameloom.llm.topk_search import search


def brute(rows, k, wanted):
    ok = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[n] = (i, [min(max(math.floor(64 * x), -(2**63)), 2**63 - 1) for x in v])
    out = []
    for i, v in ok.values():
        if wanted(i):
            best = sorted((-min(max(sum(a * b for a, b in zip(v, u, strict=False)), -(2**63)), 2**63 - 1), j) for j, u in ok.values() if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def rows_of(n, seed=1, width=8):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(width)]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(30)]  # a very common vector


@pytest.mark.parametrize(("shard_rows", "query_rows", "pivots"), [(8192, 512, 48), (50, 7, 5), (33, 100, 1)])
def test_matches_brute_force(spark, shard_rows, query_rows, pivots):
    rows = rows_of(300)
    rows += [(1000, None), (1020, [0.1, None] * 4), (1040, [math.nan] * 8), (1060, [math.inf] * 8), (None, [1.0] * 8), (1080, [0.0] * 8), (1100, [0.5]), (1120, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as shard", "2 as score", "3 as id")
    got = search(table, table.where("vec_id % 20 = 0"), shard_rows=shard_rows, query_rows=query_rows, pivots=pivots)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 20, lambda i: i % 20 == 0)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(3**i), -(2.0**40) * (i % 3), 1e300 if i == 7 else 0.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(table, table, k=5)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5, lambda i: True)


def test_fewer_rows_than_k_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id long, embedding array<float>")
    got = search(table, table)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == [(0, 1, 20, 64 * 128), (20, 1, 0, 64 * 128)]
    assert search(table.limit(0), table).count() == 0
    assert search(table, table.limit(0)).count() == 0


def test_every_query_row_has_its_own_list(spark):
    rows = spark.createDataFrame([(i, [i / 8, 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = search(rows, asked, k=4).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == sorted(2 * [(1, 29), (2, 28), (3, 27), (4, 26)] + [(1, 0), (2, 1), (3, 2), (4, 4)])


def test_no_side_is_broadcast(spark):
    table = spark.createDataFrame(rows_of(200), "vec_id long, embedding array<double>")
    found = search(table, table.where("vec_id % 20 = 0"), shard_rows=20, query_rows=3)
    assert found.count() > 0
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_sample_stays_small_where_one_id_has_most_rows(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(topk_search, "SAMPLE", 100)
    monkeypatch.setattr(topk_search, "choose_pivots", lambda sample, n, pick=topk_search.choose_pivots: sizes.append(len(sample)) or pick(sample, n))
    rows = [(7, [i / 64, 1.0]) for i in range(4000)] + [(i, [1.0, i / 64]) for i in range(100, 140)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(table, table.where("vec_id % 20 = 0"), k=3)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 3, lambda i: i % 20 == 0)
    assert 50 <= sizes[0] <= 200


def test_tiles_hold_a_bounded_number_of_shards_and_blocks():
    for shards, blocks, tasks in [(1, 1, 8), (7, 6, 12), (76, 61, 25), (1883, 1507, 600), (5, 4000, 4), (9000, 1, 2)]:
        groups, lanes = topk_search.tiles(shards, blocks, tasks)
        assert 1 <= groups <= shards and 1 <= lanes <= blocks
        assert -(-shards // groups) <= topk_search.GROUP and -(-blocks // lanes) <= topk_search.LANE
        assert groups * lanes >= min(tasks, blocks)


@pytest.mark.parametrize(("group", "lane"), [(1, 1), (3, 2), (1, 100), (100, 1)])
def test_groups_and_lanes_together_find_the_best(spark, monkeypatch, group, lane):
    monkeypatch.setattr(topk_search, "GROUP", group)
    monkeypatch.setattr(topk_search, "LANE", lane)
    rows = rows_of(300, seed=4)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(table, table.where("vec_id % 4 = 0"), shard_rows=30, query_rows=9, pivots=6)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 20, lambda i: i % 4 == 0)


@pytest.mark.parametrize("kind", [np.float32, np.float64, object])
def test_bounds_spare_most_of_a_clustered_shard(kind):
    rng = np.random.default_rng(2)
    n = 2000 if kind is object else 6000
    rows = rng.normal(0, 1, (30, 16))[rng.integers(0, 30, n)] + rng.normal(0, 0.03, (n, 16))
    rows = np.floor(64 * rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.int64)
    norm = float((rows**2).sum(axis=1).max())
    lifted = np.concatenate([rows, np.sqrt(norm - (rows**2).sum(axis=1))[:, None]], axis=1)
    ids, asked = np.arange(n) // 2, rows[:40]
    shard, best = topk_search.Shard(ids, rows, topk_search.choose_pivots(lifted, 48), norm, kind), topk_search.Best(40, 10)
    shard.search(ids[:40], asked, best)
    assert shard.compared < n * 40 / 3
    for q in range(40):
        want = sorted((-int(s), int(i)) for s, i in zip(rows @ asked[q], ids, strict=True) if i != ids[q])[:10]
        assert [(-s, i) for s, i in zip(best.scores[best.who == q], best.ids[best.who == q], strict=True)] == want
