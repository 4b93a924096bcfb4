"""Plans: what is aggregated by hash, how often a source is read, how rows multiply."""

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import ordered, timeline
from frameloom.plans import load_all
from frameloom.plans.catalog import QUERIES

load_all()
SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["transfer_summary", "best_profile", "resolve_effects", "attempt_resolution", "primary_output"])
def test_no_group_is_sorted_to_be_aggregated(spark, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, SF_DIR))


def test_first_rows_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.randrange(4), rng.randrange(3), rng.choice("abc")) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, a int, b int, c string")
    got = sorted(tuple(r) for r in ordered.first_rows(df, ["k"], [("a", True), ("b", False)]).collect())
    assert got == sorted(min((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2], r[3])) for k in {r[0] for r in rows})


def test_dyadic_nodes_cover_each_bucket_once(spark):
    rng = random.Random(5)
    spans = [(lo, lo + rng.choice([0, 1, 2, 7, 8, 63, 1000, 123_456])) for lo in [rng.randrange(-2000, 2000) for _ in range(60)]] + [(3, 2), (None, 4), (4, None)]
    df = spark.createDataFrame(spans, "lo long, hi long")
    for r in df.select("lo", "hi", timeline.dyadic_nodes(F.col("lo"), F.col("hi")).alias("n")).collect():
        if r["lo"] is None or r["hi"] is None or r["hi"] < r["lo"]:
            assert not r["n"]
            continue
        parts = sorted((n["node"] << n["level"], (n["node"] + 1) << n["level"]) for n in r["n"])
        assert parts[0][0] == r["lo"] and parts[-1][1] == r["hi"] + 1 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * (r["hi"] - r["lo"] + 1).bit_length()


def test_overlays_of_any_length_meet_their_frames(spark):
    rng = random.Random(7)
    overlays = [(j, i, s, s + rng.choice([0.0, 0.3, 5.0, 400.0, 90_000.0])) for i in range(120) for j, s in [(rng.randrange(3), rng.uniform(-50, 2000))]]
    frames = [(rng.randrange(3), rng.choice([rng.uniform(-60, 2500), rng.uniform(0, 95_000), overlays[rng.randrange(120)][2]])) for _ in range(300)]
    frames += [(o[0], o[3]) for o in overlays[:20]]
    got = timeline.active_overlays(spark.createDataFrame(frames, "job_id int, t double").distinct(), spark.createDataFrame(overlays, 'job_id int, id int, start double, "end" double'.replace('"', "`")))
    want = sorted((j, t, o[1]) for j, t in set(frames) for o in overlays if o[0] == j and o[2] <= t <= o[3])
    assert sorted((r["job_id"], r["t"], r["id"]) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["hue_shift", "channel_mix", "yuv_round_trip", "vibrance"])
def test_bands_of_a_pixel_never_part(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF_DIR))


def test_wide_pixels_are_those_of_the_long_table(spark):
    from frameloom.operators import raster
    from frameloom.plans import fixtures

    key = lambda df: sorted(tuple(r) for r in df.select("img_id", "y", "x", "r", "g", "b").collect())
    assert key(fixtures.wide(spark, SF_DIR)) == key(raster.to_wide(fixtures.rgb(spark, SF_DIR)))


def test_cell_draws_are_normal_and_unrelated(spark):
    from frameloom.functions import keyed as K

    grid = spark.range(1 << 16).select(F.floor(F.col("id") / 256).alias("y"), (F.col("id") % 256).alias("x"))
    keyed = grid.withColumn("k", K.cell_key(F.lit(-(1 << 60) - 5), "p", F.col("y"), F.col("x")))
    z = keyed.select("y", "x", "k", K.cell_normal(F.col("k")).alias("a"), K.cell_normal(F.col("k"), 1).alias("b"))
    near = z.select((F.col("y") + 1).alias("y"), "x", F.col("a").alias("c"))
    r = z.join(near, ["y", "x"], "left").agg(
        F.avg("a"), F.stddev("a"), F.kurtosis("a"), F.corr("a", "b"), F.corr("a", "c"), F.max(F.abs("a")), F.count_distinct("k"), F.min("k"), F.max("k")).first()
    assert abs(r[0]) < 0.02 and abs(r[1] - 1) < 0.02 and abs(r[2]) < 0.1 and abs(r[3]) < 0.02 and abs(r[4]) < 0.02
    assert r[5] < 6.7 and r[6] > 65_500 and r[7] >= 0 and r[8] < K.PRIME


@pytest.mark.parametrize(("name", "scans"), [("clip_cursor", 0), ("effect_stacks", 0), ("assign_fallback_source", 2)])
def test_parsed_rows_are_stored_before_they_branch(spark, name, scans):
    """Scans of files that are left in the plan: those of other inputs only."""
    assert plan(QUERIES[name](spark, SF_DIR)).count("FileScan") <= scans


def test_augment_noise_is_drawn_from_a_digest_of_seed_and_pixel(spark):
    """Every pixel has its own digest, with two draws of 32 bits for each band."""
    import hashlib
    import math

    from frameloom.operators import augment as A

    rows = [(img, y, x, 128.0, 90.0, 40.0) for img in (1, 2) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "img_id long, y int, x int, r double, g double, b double")
    base = {"noise": 6.0}
    params = {(p["img_id"], p["variant"]): p for p in A.variant_params(
        spark.createDataFrame([(1, 4, 4), (2, 4, 4)], "img_id long, w int, h int"), 2, base, "strong", "t").collect()}
    out = A.augment(df, 2, base, "strong", "t").collect()
    assert len(out) == 2 * 2 * 16 * 3
    for o in out:
        p, v = params[o["img_id"], o["variant"]], (128.0, 90.0, 40.0)[o["band"]]
        digits = hashlib.sha256(f"{p['seed']}_noise.{o['y']}.{o['x']}".encode()).hexdigest()[o["band"] * 16:]
        a, b = int(digits[:8], 16) / 2**32, int(digits[8:16], 16) / 2**32
        z = math.sqrt(-2.0 * math.log(1.0 - a)) * math.cos(2.0 * math.pi * b)
        assert abs(o["v"] - (v + z * p["noise"] * 2.0 - 0.5)) <= 1.6 or o["v"] in (0.0, 255.0)


def test_tasks_of_a_numbering_follow_the_rows(spark, monkeypatch):
    """More rows are more tasks, counts of chunks included; the session has eight."""
    monkeypatch.setattr(ordered, "TASK_ROWS", 50)
    df = spark.range(2_000).select((F.col("id") % 400).alias("key"), F.col("id").alias("at"))
    out = ordered.sequence_index(df, ["key"], ["at"], [F.floor(F.col("at") / 1_000)])
    held = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(held) > 30 and max(r.n for r in held) < 150
    assert {(r.key, r.at): r.idx for r in out.collect()} == {(k % 400, k): k // 400 for k in range(2_000)}


def test_tasks_of_the_effect_fold_follow_the_rows(spark, monkeypatch):
    made = spark.range(900).select(
        (F.col("id") % 300).alias("clip"), F.col("id").alias("at"), F.lit(2.0).alias("dur"),
        F.create_map(F.lit("type"), F.lit("gamma"), F.lit("value"), (F.col("id") / 1_000).cast("string")).alias("effect"))
    plain = sorted(timeline.resolve_effects(made, ["clip"]).collect())
    monkeypatch.setattr(ordered, "TASK_ROWS", 30)
    out = timeline.resolve_effects(made, ["clip"], rows=900)
    assert "hashpartitioning(clip" in plan(out) and ", 30), REPARTITION_BY_NUM" in plan(out)
    assert sorted(out.collect()) == plain and len(plain) == 300


def test_archives_come_to_python_in_small_batches(spark):
    """An Arrow batch would hold 10,000 texts and their archives at once."""
    text = plan(QUERIES["expand_archives"](spark, SF_DIR))
    assert "BatchEvalPython" in text and "MapInPandas" not in text and text.count("members(") == 1
