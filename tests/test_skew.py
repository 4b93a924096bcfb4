"""Operators that split heavy keys, against plain loops, with chunks small enough to matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import assignment, dedup, ordered, signal, timeline
from frameloom.operators.ordered import exact_quantiles, sequence_index, with_halo


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_sequence_index_of_a_heavy_key(spark):
    rng = random.Random(1)
    data = [("hot", rng.randrange(40), k) for k in range(900)] + [(f"k{k % 7}", rng.randrange(40), k) for k in range(100)]
    df = spark.createDataFrame(data, "key string, a int, b int")
    out = sequence_index(df, ["key"], ["a", "b"], [F.floor(F.col("a") / 4)], "pos")
    want, seen = [], {}
    for key, a, b in sorted(data):
        want.append((key, a, b, seen.setdefault(key, 0)))
        seen[key] += 1
    assert rows_of(out, "key", "a", "b", "pos") == sorted(want)


def test_sequence_index_spreads_a_heavy_key_that_arrives_in_one_partition(spark):
    df = spark.range(4000).withColumn("key", F.lit("hot")).repartition(8, "key")
    out = sequence_index(df, ["key"], ["id"], [F.floor(F.col("id") / 50)], "pos")
    assert out.where("id = pos").count() == 4000
    assert "RoundRobin" not in out._jdf.queryExecution().toString()
    assert "_chunk" in out._jdf.queryExecution().executedPlan().toString()


def test_halo_covers_both_sides(spark):
    df = spark.range(30).select(F.col("id").alias("i"))
    out = with_halo(df, "i", 10, 2, 3)
    chunks = {c: sorted(r.i for r in out.where(F.col("_chunk") == c).collect()) for c in range(3)}
    assert chunks[1] == list(range(8, 23))
    assert out.where("_core").count() == 30


@pytest.mark.parametrize("scale", [1.0, 1000.0])
def test_exact_quantiles_with_ties_and_tails(spark, scale):
    rng = np.random.default_rng(2)
    v = np.concatenate([np.zeros(300), rng.normal(0, 1, 500), rng.pareto(1.0, 200) * scale])
    df = spark.createDataFrame([("s", float(x)) for x in v] + [("one", 4.0)], "src string, v double")
    got = {r.src: r for r in exact_quantiles(df, ["src"], "v", {"a": 0.1, "b": 0.5, "c": 0.99, "d": 1.0}, 64).collect()}
    for name, p in [("a", 0.1), ("b", 0.5), ("c", 0.99), ("d", 1.0)]:
        assert got["s"][name] == pytest.approx(np.quantile(v, p), abs=1e-9)
        assert got["one"][name] == 4.0


def greedy(items, workers, memory):
    load, out = [0] * workers, {}
    for idx, size in sorted(items, key=lambda t: (-t[1], t[0])):
        w = min(range(workers), key=lambda k: (load[k] / memory[k], k))
        out[idx] = w
        load[w] += size
    return out


@pytest.mark.parametrize("memory", [[1, 1, 1], [24, 12, 48]])
def test_lpt_of_a_heavy_job_with_equal_and_empty_sizes(spark, memory):
    rng = random.Random(3)
    jobs = {1: [(k, rng.choice([0, 5, 5, 7, 100, 1000])) for k in range(400)], 2: [(k, 9) for k in range(50)], 3: [(0, 0)], 4: [(k, k * k) for k in range(30)]}
    df = spark.createDataFrame([(j, i, s) for j, items in jobs.items() for i, s in items], "job_id long, idx long, size long")
    out = assignment.lpt_assign(df, 3, memory)
    got = {(r.job_id, r.idx): r.worker for r in out.collect()}
    assert len(got) == df.count()
    assert got == {(j, i): w for j, items in jobs.items() for i, w in greedy(items, 3, memory).items()}


def test_clip_cursor_over_chunks(spark):
    rng = random.Random(4)
    data = [(1, k, rng.choice([0.0, rng.random() * 300]), rng.random() * 5) for k in range(300)] + [(2, 0, 5.0, 1.0)]
    df = spark.createDataFrame(data, "job_id int, ord int, start double, dur double")
    got = {(r.job_id, r.ord): (r.begin, r.end) for r in timeline.clip_cursor(df, [F.floor(F.col("start") / 10)]).collect()}
    cursor = {}
    for job, k, start, dur in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        begin = max(cursor.get(job, 0.0), start)
        cursor[job] = begin + dur
        assert got[job, k] == pytest.approx((begin, begin + dur), abs=1e-9)


@pytest.mark.parametrize("step,chunk", [(2, 16), (3, 8), (5, 64), (9, 16)])
def test_peaks_when_blocking_runs_across_chunks(spark, step, chunk):
    rng = random.Random(step)
    v = [0.0] * 300
    for k in range(1, 299, step):
        v[k] = 1.0 + rng.random()
    for k in range(120, 150):
        v[k] = 0.0
    gap = 7
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(v)], "src string, i long, v double")
    thr = spark.createDataFrame([("s", 0.5)], "src string, thr double")
    want, last = [], -10**9
    for k in range(1, len(v) - 1):
        if k - last >= gap and v[k] >= 0.5 and v[k] >= v[k - 1] and v[k] >= v[k + 1]:
            want.append(k)
            last = k
    assert [r.i for r in signal.peaks(df, thr, gap, chunk).orderBy("i").collect()] == want


def test_peaks_of_a_strictly_periodic_source(spark):
    """A million samples of one source whose chunks all hand their block on: composed in groups, never gathered."""
    n, step, gap = 1_000_000, 3, 7
    df = spark.range(n).select(F.lit("s").alias("src"), F.col("id").alias("i"), F.when(F.col("id") % step == 1, 1.0).otherwise(0.0).alias("v"))
    thr = spark.createDataFrame([("s", 0.5)], "src string, thr double")
    got = signal.peaks(df, thr, gap)
    assert got.agg(F.min("i"), F.max("i"), F.count("*"), F.sum((F.col("i") % 9 == 1).cast("int"))).first() == (1, 1 + 9 * ((n - 3) // 9), (n - 3) // 9 + 1, (n - 3) // 9 + 1)


@pytest.mark.parametrize("seed", range(3))
def test_blocks_carried_through_gaps(spark, seed):
    rng = random.Random(seed)
    gap = 5
    chunks = {(src, c): [rng.choice([0, e, (e + 2) % gap]) for e in range(gap)] for src in "ab" for c in range(3000) if rng.random() < 0.9}
    df = spark.createDataFrame([(s, c, e) for (s, c), e in chunks.items()], "src string, c long, ends array<long>")
    got = {(r.src, r.c): r.start for r in signal.carried_blocks(df, gap).collect()}
    want, block = {}, {}
    for src, c in sorted(chunks):
        want[src, c] = block.get(src, 0) if (src, c - 1) in chunks else 0
        block[src] = chunks[src, c][want[src, c]]
    assert got == want


def test_near_hashes_with_salted_buckets(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET_ROWS", 10)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set()
    for b in base:
        for _ in range(15):
            h = b
            for bit in rng.sample(range(64), rng.randrange(8)):
                h ^= 1 << bit
            values.add(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in sorted(values)]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(signed)], "img_id long, hash long")
    for limit in (3, 7, 10):
        got = {(r.a_id, r.b_id, r.dist) for r in dedup.near_hashes(dedup.distinct_hashes(df), limit).collect()}
        want = {
            (i, j, d) for i in range(len(signed)) for j in range(i + 1, len(signed))
            if (d := bin((signed[i] ^ signed[j]) & ((1 << 64) - 1)).count("1")) <= limit
        }
        assert got == want


def test_copies_never_meet(spark):
    df = spark.range(500).select(F.col("id").alias("img_id"), F.lit(77).cast("long").alias("hash"))
    assert dedup.near_hashes(dedup.distinct_hashes(df), 10).count() == 0
    out = dedup.nearest_earlier(df, 10)
    assert out.where("min_dist = 0").count() == 499
    assert dedup.duplicate_clusters(df, 10).collect()[0].pictures == 500


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(k, k + 1) for k in range(39)] + [(50, 45)], "a long, b long")
    label = {r.node: r.label for r in dedup.components(nodes, edges).collect()}
    assert all(label[k] == 0 for k in range(40))
    assert label[50] == 45 and label[59] == 59


def hot_job(spark):
    """A third of the rows on one key, the others on keys of their own."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    return df, spark.range(-1, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("fact"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_heavy_key_meets_its_facts_in_every_task(spark, how):
    df, facts = hot_job(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ordered.join_split(df.repartition(8), facts, ["k"], how)
        got = sorted(((r.k, r.id, r.fact) for r in out.collect()), key=repr)
        rows = out.select(F.spark_partition_id().alias("p"), (F.col("k") == -1).alias("hot")).groupBy("p", "hot").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(k, i, k * 10 if k % 2 or k == -1 else None) for i in range(9000) for k in [-1 if i % 3 == 0 else i]]
    assert got == sorted((w for w in want if how == "left" or w[2] is not None), key=repr)
    hot = sorted(r["count"] for r in rows if r["hot"])
    assert len(hot) == 8 and hot[-1] <= 2 * hot[len(hot) // 2]  # the heavy key stays where its rows were


def test_counts_known_from_the_facts(spark):
    df, facts = hot_job(spark)
    sized = facts.join(df.groupBy("k").agg(F.count("*").alias("n")), "k", "left").na.fill(0, ["n"])
    key = lambda d: sorted((r.k, r.id, r.fact) for r in d.collect())
    out = ordered.join_split(df, sized, ["k"], many="n")
    assert out.columns == ["k", "id", "fact"] and key(out) == key(df.join(facts, "k"))


def test_quantile_buckets_of_a_source_with_one_far_outlier(spark):
    """One value of 1e300 must not put all others into one bucket."""
    df = spark.range(40_000).select(F.lit("s").alias("k"), F.when(F.col("id") == 7, 1e300).otherwise(F.rand(3)).alias("v"))
    df = df.union(spark.createDataFrame([("t", None), ("u", 2.0)], "k string, v double")).persist()
    got = {r.k: r.q for r in ordered.exact_quantiles(df, ["k"], "v", {"q": 0.25}).collect()}
    values = np.array([r.v for r in df.where("k = 's'").collect()])
    assert got == {"s": pytest.approx(np.quantile(values, 0.25), abs=1e-12), "u": 2.0}
    edges = df.where("k = 's'").agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)], 10_000)).first()[0]
    sizes = df.where("k = 's'").select(ordered._bucket(F.col("v"), F.array(*[F.lit(e) for e in edges])).alias("b")).groupBy("b").count().collect()
    assert len(sizes) == 64 and max(r["count"] for r in sizes) < 2 * 40_000 / 64
    assert {r["b"] for r in sizes} == set(range(64))
    df.unpersist()
