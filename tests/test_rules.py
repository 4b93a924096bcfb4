"""Hand-worked cases for rules that are easy to get wrong, and properties of the operators."""

import io
import json
import math
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.functions import config as C
from frameloom.functions import geometry as G
from frameloom.functions import keyed as K
from frameloom.functions import text as X
from frameloom.functions import timing as T
from frameloom.functions import urls as U
from frameloom.operators import raster as R
from frameloom.operators import signal as S
from frameloom.operators import timeline as L
from frameloom.registry import apply_tool, tool_chain
from frameloom.functions.urls import variant_url
from frameloom.operators.assignment import balanced_assign
from frameloom.operators.ledger import validate_batches
from frameloom.sources.archives import expand_archives
from frameloom.sources.objects import scan_objects
from frameloom.sources.requests import read_requests
from frameloom.streaming import items as stream


def one(spark, *columns, **values):
    """Evaluate columns on one row of values."""
    df = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {kind(v)}" for k, v in values.items()) or "_ int")
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0])


def kind(v):
    return {bool: "boolean", int: "long", float: "double", str: "string", dict: "map<string,string>"}.get(type(v), "string")


@pytest.mark.parametrize("value,want", [
    ("5", 5.0), (" 12 ", 10.0), ("-3", 0.0), ("1e1", 10.0), ("abc", 7.0), ("5d", 7.0), ("", 7.0), (None, 7.0), ("inf", 10.0), ("-Infinity", 0.0),
])
def test_clamp(spark, value, want):
    assert one(spark, C.clamp_number(F.col("v"), 0, 10, 7), v=value) == (want,)


def test_nan_passes_the_clamp(spark):
    assert math.isnan(one(spark, C.clamp_number(F.col("v"), 0, 10, 7), v="NaN")[0])


@pytest.mark.parametrize("url,want", [
    ("https://a.com/x/b.MP4?sig=1", ".mp4"), ("https://a.com", ".jpg"), ("https://a.com/.mp4", ".jpg"), ("https://a.com/a.tar.zip", ".zip"),
    ("https://a.com/a.mp4#t", ".jpg"), ("https://a.com/x.exe", ".jpg"),
])
def test_extension(spark, url, want):
    assert one(spark, U.classify_extension(F.col("u")), u=url) == (want,)


@pytest.mark.parametrize("url,want", [
    ("https://ok.com/a", None), ("HTTPS://ok.com/a", None), ("ftp://ok.com", "scheme"), ("http:///a", "missing host"), ("", "required"),
    ("http://LOCALHOST:80/", "localhost"), ("http://127.9.9.9/", "localhost"), ("http://[::1]:8/", "localhost"), ("http://u@10.0.0.1/", "private network"),
    ("http://172.16.0.1/", "private network"), ("http://172.31.0.1/", "private network"), ("http://172.32.0.1/", None), ("http://169.254.1.1/", "private network"),
])
def test_unsafe_urls(spark, url, want):
    assert one(spark, U.unsafe_reason(F.col("u")), u=url) == (want,)


@pytest.mark.parametrize("member,want", [
    ("a/b.jpg", False), ("../b.jpg", True), ("a/../b.jpg", False), ("a/../../b.jpg", True), ("/etc/b.jpg", True), ("a/../../a/b.jpg", True), ("..b/c.jpg", False),
])
def test_traversal(spark, member, want):
    assert one(spark, U.traverses(F.col("m")), m=member) == (want,)


def test_variant_and_manifest_urls(spark):
    got = one(spark, U.variant_url(F.col("a"), F.lit(7)), U.variant_url(F.col("b"), F.lit(12)), U.manifest_url(F.col("c")), a="x/y.z.jpg", b="plain", c="h/f.mp4?a=1?b=2")
    assert got == ("x/y.z_v0007.jpg", "plain_v0012", "h/f.mp4.manifest.json?a=1")


@pytest.mark.parametrize("value,want", [("#FFF", "#ffffff"), (" 12aB3c ", "#12ab3c"), ("12345", "#000000"), ("#ggg", "#000000"), (None, "#000000")])
def test_hex_colour(spark, value, want):
    assert one(spark, C.hex_colour(F.col("v")), v=value) == (want,)


def test_caption_format(spark):
    got = one(spark, X.parse_caption(F.col("t")), t='##A b## say "hi" &&&it\'s')[0]
    assert (got.title, got.body) == ("A b", "say “hi” \nit‘s")
    assert one(spark, X.parse_caption(F.col("t"), False), t="##A## b")[0].title is None


def test_emoji_clusters(spark):
    text = "a👩‍💻b🇫🇷🇩🇪c👍🏽☀️."
    assert one(spark, X.emoji_tokens(F.col("t")), t=text)[0] == ["a", "👩‍💻", "b", "🇫🇷", "🇩🇪", "c", "👍🏽", "☀️", "."]


def test_word_chunks_and_blank_text(spark):
    assert one(spark, X.word_chunks(F.col("t"), F.lit(2)), X.word_chunks(F.col("b"), F.lit(2)), t=" a  b\nc ", b="  ") == (["a b", "c"], [])


def test_wrap_keeps_blank_lines(spark):
    assert one(spark, X.wrap(F.col("t"), F.lit(10), F.lit(12)), t="aa bb\n\ncc")[0] == "aa\nbb\n\ncc"


@pytest.mark.parametrize("rate", [0.1, 0.25, 0.3, 0.5, 1.0, 2.0, 3.3, 4.0, 9.0])
def test_tempo_factors_multiply_to_the_rate(spark, rate):
    factors = one(spark, T.tempo_factors(F.col("r")), r=rate)[0]
    assert math.prod(factors) == pytest.approx(min(4.0, max(0.25, rate))) and all(0.5 <= f <= 2.0 for f in factors)


def test_unknown_transition_is_none_and_missing_type_is_fade(spark):
    got = one(spark, T.transition(F.col("a")), T.transition(F.col("b")), a={"type": "nope", "duration": "2"}, b={"duration": "9"})
    assert (got[0].type, got[0].seconds, got[1].type, got[1].seconds) == ("none", 0.0, "fade", 5.0)


def test_layout_of_a_wide_picture(spark):
    args = [F.lit(x) for x in (1920, 1080, 1080, 1920)]
    plain, zones = one(spark, G.layout_by_frame(*args, F.lit(0), F.lit(0), F.lit(0)), G.layout_by_frame(*args, F.lit(50), F.lit(30), F.lit(0)))
    assert (plain.scaled_w, plain.scaled_h, plain.blur_top, plain.blur_bottom) == (1080, 606, 657, 657)
    assert (zones.blur_top, zones.blur_bottom, zones.scaled_h) == (960, 576, 384)


def test_draws_are_in_range_and_keyed(spark):
    df = spark.range(500).select(K.unit_draw(F.col("id"), "a").alias("a"), K.unit_draw(F.col("id"), "b").alias("b"))
    r = df.agg(F.min("a"), F.max("a"), F.avg("a"), F.count_if(F.col("a") == F.col("b"))).collect()[0]
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.06 and r[3] == 0


def test_last_valid_effect_wins_and_bad_angle_resets(spark):
    rows = [(1, 0, {"type": "brightness", "value": "0.1"}), (1, 1, {"type": "brightness", "value": "bad"}), (1, 2, {"type": "brightness", "enabled": "false", "value": "0.2"}),
            (1, 3, {"type": "rotate", "value": "90"}), (1, 4, {"type": "rotate", "value": "45"}), (2, 0, {"type": "rotate", "value": "90"}), (2, 1, {"type": "rotate", "value": "x"}),
            (2, 2, {"type": "fade_in", "params": json.dumps({"duration": 9})})]
    df = spark.createDataFrame(rows, "clip int, at int, effect map<string,string>").withColumn("dur", F.lit(2.0))
    got = {r.clip: r for r in L.resolve_effects(df, ["clip"]).collect()}
    assert (got[1].brightness, got[1].rotateDeg) == (0.1, 90)
    assert (got[2].rotateDeg, got[2].fadeInSec, got[2].volume) == (0, 2.0, 1.0)


def test_timeline_shapes_agree(spark):
    clips, effects, text = [{"id": "a"}, 7, {"id": "b"}], [{"clipId": "a"}], [{"text": "t"}]
    shapes = [
        {"tracks": {"video": clips, "effects": effects, "captions": text}},
        {"tracks": [{"type": "media", "segments": clips}, {"kind": "FX", "items": effects}, {"name": "Title", "titles": text}, "x"]},
        {"segments": clips, "effects": effects, "overlays": text},
    ]
    df = spark.createDataFrame([(k, json.dumps(s)) for k, s in enumerate(shapes)] + [(9, "{bad")], "job_id int, json string")
    got = {r.job_id: (len(r.video), len(r.effects), len(r.text), r.error) for r in L.shred_timeline(df).collect()}
    assert got == {0: (2, 1, 1, None), 1: (2, 1, 1, None), 2: (2, 1, 1, None), 9: (0, 0, 0, "Invalid timeline JSON")}


@pytest.fixture(scope="module")
def picture(spark):
    rng = np.random.default_rng(6)
    px = [(1, y, x, b, float(rng.integers(0, 256))) for y in range(5) for x in range(7) for b in range(3)]
    return R.with_size(spark.createDataFrame(px, "img_id long, y int, x int, band int, v double")).cache()


def cells(df):
    return {(r.y, r.x, r.band): r.v for r in df.collect()}


def test_flips_and_turns_undo_themselves(picture):
    same = cells(picture)
    assert cells(R.flip(R.flip(picture, True), True)) == same
    assert cells(R.rotate_quarter(R.rotate_quarter(picture, 90), 270)) == same
    assert cells(R.rotate_quarter(R.rotate_quarter(picture, 180), 180)) == same


def test_blur_against_numpy(picture):
    src = cells(picture)
    got = cells(R.box_blur(picture, 1))
    for (y, x, b), v in got.items():
        near = [np.mean([src[yy, xx, b] for xx in range(max(0, x - 1), min(7, x + 2))]) for yy in range(max(0, y - 1), min(5, y + 2))]
        assert v == math.floor(np.mean(near) + 1e-9)


def test_border_and_resize_shapes(picture):
    assert R.border(picture, 2, 1, 2, 3).count() == 9 * 11 * 3
    assert R.resize_nearest(picture, 3, 11).count() == 3 * 11 * 3
    assert R.resize_area(picture, 3, 2).count() == 3 * 2 * 3


def test_unknown_tool_gives_rows_not_an_error(picture):
    out, failed = apply_tool(picture, "bg_remove", {})
    assert out.count() == 0 and [r.error for r in failed.collect()] == ["Unknown tool: bg_remove"]
    out, failed = tool_chain(picture, [("flip", {}), ("nope", {}), ("flip", {})])
    assert failed.count() == 1


def reference_profile(v, rate, frame, hop):
    """The rhythm analysis as one loop over one signal."""
    v = v - v.mean()
    n = 1 + (len(v) - frame) // hop
    env = np.array([np.sqrt(np.mean(v[k * hop:k * hop + frame] ** 2) + 1e-9) for k in range(n)])
    on = np.maximum(np.diff(env, prepend=env[0]), 0)
    kern = np.array([0.08, 0.12, 0.16, 0.28, 0.16, 0.12, 0.08])
    on = np.convolve(on, kern / kern.sum(), mode="same")
    on = (on - on.mean()) / on.std()
    er = rate / hop
    lo, hi = int(er * 60 / 176), int(er * 60 / 68)
    ac = np.array([np.sum(on[:len(on) - k] * on[k:]) for k in range(lo, hi + 1)])
    lag = lo + int(np.argmax(ac))
    conf = min(1.0, max(0.0, (ac.max() - np.median(ac)) / max(1e-6, np.percentile(ac, 90) - np.median(ac))))
    beats = max(8, len(on) // lag)
    score = [sum(on[p + k * lag] for k in range(beats) if p + k * lag < len(on)) for p in range(lag)]
    punch = max(0.0, np.percentile(on, 95) - np.percentile(on, 50))
    amount = max(0.12, min(0.95, 0.16 + 0.54 * conf + 0.18 * min(1.0, punch / 2.5)))
    return round(60 * er / lag, 2), round(amount, 3), round(int(np.argmax(score)) / er, 4), round(conf, 3)


def test_rhythm_profile_against_a_loop(spark):
    rate, frame, hop = 400.0, 8, 4
    rng = np.random.default_rng(7)
    t = np.arange(6000)
    v = rng.normal(0, 0.05, t.size) + np.where(t % 200 < 12, 1.0, 0.0) * np.sin(t)
    df = spark.createDataFrame([("a", int(i), float(x)) for i, x in enumerate(v)] + [("flat", int(i), 1.0) for i in range(2000)], "src string, i long, v double")
    got = S.rhythm_profile(df, rate, frame, hop, 64, 256).collect()
    assert [r.src for r in got] == ["a"]
    assert (got[0].bpm, got[0].amount, got[0].phase_s, got[0].confidence) == pytest.approx(reference_profile(v, rate, frame, hop), abs=2e-3)


def test_requests_objects_and_archives(spark, tmp_path):
    lines = [{"job_id": "1", "tool": "Resize", "inputUrl": "a", "outputUrl": "b"}, {"job_id": "2", "inputUrl": "a"}, {"job_id": "3", "tool": "flip", "outputUrl": "b"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r.job_id: (r.tool, r.error) for r in read_requests(spark, str(tmp_path / "r.json")).collect()}
    assert got == {"1": ("resize", None), "2": ("", "Missing 'tool' parameter"), "3": ("flip", "Missing 'inputUrl' parameter")}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/a.JPG", b"12")
        z.writestr("../x.png", b"3")
        z.writestr("n.txt", b"4")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    found = scan_objects(spark, str(tmp_path), "*.zip", content=True).withColumnRenamed("path", "key")
    assert [(r.member, r.size, r.safe) for r in expand_archives(found, [".jpg", ".png"]).orderBy("pos").collect()] == [("d/a.JPG", 2, True), ("../x.png", 1, False)]
    assert scan_objects(spark, str(tmp_path), "*.zip").columns == ["path", "length", "modificationTime"]


def test_tracker_over_several_batches_and_timeouts(spark, tmp_path):
    src = tmp_path / "in"
    schema = "item_id long, ts timestamp, seq long, code string, retryable boolean"
    batches = [
        [(1, "2024-01-01 00:00:00", 1, "TIMEOUT", True), (2, "2024-01-01 00:00:00", 1, None, True), (3, "2024-01-01 00:00:00", 1, "TIMEOUT", True)],
        [(1, "2024-01-01 00:01:00", 2, "TIMEOUT", True), (1, "2024-01-01 00:02:00", 3, "NETWORK_ERROR", True), (2, "2024-01-01 00:03:00", 2, "TIMEOUT", True)],
        [(4, "2024-01-01 05:00:00", 1, "NOT_FOUND", False)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "item_id long, ts string, seq long, code string, retryable boolean").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(src))
    table_schema = spark.createDataFrame([], schema).schema
    items = stream.stream_items(spark, str(src), table_schema, "*.parquet", files_per_batch=1)
    with stream.rocksdb_state(spark):
        out = stream.run_to_table(stream.attempt_tracker(items), "tracked")
    got = {r.item_id: (r.status, r.attempts, r.code) for r in out.collect()}
    assert got == {1: ("failed", 3, "NETWORK_ERROR"), 2: ("completed", 1, None), 3: ("failed", 1, "TIMEOUT"), 4: ("failed", 1, "NOT_FOUND")}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "..", ".", "", "b"]), max_size=6), st.booleans())
def test_normal_path_is_idempotent_and_matches(spark, parts, rooted):
    import posixpath

    path = ("/" if rooted else "") + "/".join(parts)
    got = one(spark, L.normal_path(F.col("p")), p=path)[0]
    assert got == posixpath.normpath("/" + path.lstrip("/") if path.startswith("/") else path)


def test_long_variant_numbers_stay_whole(spark):
    df = spark.createDataFrame([("a.jpg", k) for k in (0, 7, 1234, 12340, 12345)], "url string, k int")
    got = [r[0] for r in df.select(variant_url(F.col("url"), F.col("k"))).collect()]
    assert got == ["a_v0000.jpg", "a_v0007.jpg", "a_v1234.jpg", "a_v12340.jpg", "a_v12345.jpg"]


def test_first_refused_address_of_a_batch(spark):
    ok, bad = "https://a.example.com/x", "http://10.0.0.1/x"
    rows = [(1, 0, 0, ok), (1, 1, 0, bad), (1, 0, 7, ""), (2, 1, 3, bad), (2, 1, 2, "ftp://a/x"), (2, 0, 0, ok), (3, 0, 0, ok)]
    got = validate_batches(spark.createDataFrame(rows, "job_id long, side int, idx long, url string")).collect()
    assert {r["job_id"]: (r["side"], r["idx"], r["reason"]) for r in got} == {1: ("input", 7, "required"), 2: ("output", 2, "scheme"), 3: (None, None, None)}


@pytest.mark.parametrize("steps", [2, 6])
def test_a_chain_of_tools_reads_its_source_once(spark, steps):
    from frameloom.plans import fixtures
    from frameloom.registry import tool_chain

    chain = [("tone", {"brightness": 5}), ("flip", {}), ("resize", {"width": 6, "height": 9}), ("blur", {"radius": 1}), ("vignettes", {}), ("flip", {"horizontal": False})]
    out, failed = tool_chain(fixtures.sized(fixtures.rgb(spark, "/root/testdata/sf0.001")), chain[:steps])
    assert failed is None and out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert out.columns == ["img_id", "y", "x", "band", "v"]


def test_balanced_loads_of_a_heavy_job(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 5, 5, 7, 100, 1000]) for _ in range(997)]
    out = balanced_assign(spark.createDataFrame([(1, k, s) for k, s in enumerate(sizes)], "job_id int, idx long, size long"), 4).collect()
    load = [sum(r["size"] for r in out if r["worker"] == w) for w in range(4)]
    assert len(out) == 997 and max(load) - min(load) <= 1000
