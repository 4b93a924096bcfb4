"""Queries on edit timelines, effects and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import dimensions as D
from ..functions import templates as M
from ..functions import timing as T
from ..operators import timeline as L
from ..session import cut_lineage
from . import fixtures as fx
from .catalog import query, table
from .intake import sql_list, sql_values
from .settings import clamp_sql, num, raw_value, RAW

MEDIA = ["video", "image", "audio", "Video"]
LENGTHS = ["3.5", "0.01", "bad", "12"]
DUR_VALUES = [3.5, 0.1, 8.0, 12.0]


def _timelines(spark, sf_dir):
    """A timeline per order, written in one of three shapes."""
    job = F.col("o_orderkey")
    text = lambda c: c.cast("string")

    def clip(k):
        case = (job + k) % 3
        return F.struct(
            F.when(k != 2, F.concat(F.lit("c"), text(k))).alias("id"),
            fx.choose(k % 4, MEDIA).alias("mediaType"),
            F.when(case == 0, F.concat(F.lit("https://s.example.com/"), text(k), F.lit(".mp4"))).when(case == 1, "").alias("sourceUrl"),
            (k * 2 - job % 3).alias("startSec"), fx.choose((job + k) % 4, LENGTHS).alias("durationSec"),
            k.alias("trimInSec"), F.when(job % 2 == 0, job % 5).alias("trimOutSec"), F.when(k == 1, 9).alias("speed"),
            F.when(k % 2 == 0, F.struct(F.lit("Cross-Fade").alias("type"), F.lit(0.5).alias("duration"))).alias("transitionIn"),
        )

    clips = F.transform(F.sequence(F.lit(0).cast("long"), job % 4), clip)
    effects = F.transform(F.sequence(F.lit(0).cast("long"), job % 3), lambda k: F.struct(
        F.concat(F.lit(" c"), text(k)).alias("clipId"), F.lit("Hue_Rotate").alias("type"), (job % 400 - 200).alias("degrees")))
    titles = F.array(F.struct(F.concat(F.lit("title "), text(job)).alias("text"), F.lit(1).alias("startSec")))
    track = lambda label, key, rows: F.to_json(F.struct(F.lit(label).alias("type"), rows.alias(key)))
    as_object = F.to_json(F.struct(F.struct(clips.alias("video"), effects.alias("effects"), titles.alias("titles")).alias("tracks")))
    as_list = F.concat(F.lit('{"tracks": ['), track("Main", "clips", clips), F.lit(","), track("FX", "items", effects), F.lit(","),
                       track("Caption", "captions", titles), F.lit("]}"))
    at_root = F.to_json(F.struct(clips.alias("clips"), effects.alias("effects"), titles.alias("captions")))
    json = F.when(job % 50 == 49, "{broken").when(job % 3 == 0, as_object).when(job % 3 == 1, as_list).otherwise(at_root)
    return fx.spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(job.alias("job_id"), json.alias("json"))


_GOOD = "job_id % 50 <> 49"
_TL = f"""WITH o AS (SELECT o_orderkey AS job_id FROM orders), k AS (SELECT job_id, unnest(range(job_id % 4 + 1)) AS ord FROM o WHERE {_GOOD}),
clips AS (SELECT job_id, ord, CASE WHEN ord = 2 THEN 'clip-3' ELSE 'c' || ord END AS clip_id, lower({fx.sql_choose('ord % 4', MEDIA)}) AS media_type,
  CASE WHEN (job_id + ord) % 3 = 0 THEN 'https://s.example.com/' || ord || '.mp4' END AS source, greatest(0, ord * 2 - job_id % 3)::DOUBLE AS start,
  {fx.sql_choose('(job_id + ord) % 4', DUR_VALUES)}::DOUBLE AS dur, ord::DOUBLE AS trim_in,
  CASE WHEN job_id % 2 = 0 AND job_id % 5 > ord THEN (job_id % 5)::DOUBLE END AS trim_out, CASE WHEN ord = 1 THEN 4.0 ELSE 1.0 END::DOUBLE AS speed,
  CASE WHEN ord % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS fade_in, 0.0::DOUBLE AS fade_out FROM k WHERE ord % 4 <> 2)"""


@query("shred_timeline", f"""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 50 = 49 THEN 0 ELSE o_orderkey % 4 + 1 END::INTEGER AS clips,
  CASE WHEN o_orderkey % 50 = 49 THEN 0 ELSE o_orderkey % 3 + 1 END::INTEGER AS effects, CASE WHEN o_orderkey % 50 = 49 THEN 0 ELSE 1 END::INTEGER AS texts,
  CASE WHEN o_orderkey % 50 = 49 THEN 'Invalid timeline JSON' END AS error FROM orders""")
def shred_timeline(spark, sf_dir):
    df = L.shred_timeline(_timelines(spark, sf_dir))
    return df.select("job_id", F.size("video").alias("clips"), F.size("effects").alias("effects"), F.size("text").alias("texts"), "error")


@query("collect_tracks", f"""WITH o AS (SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % 50 <> 49)
SELECT job_id, 'video' AS kind, k::INTEGER AS ord, CASE WHEN k <> 2 THEN 'c' || k END AS label FROM (SELECT job_id, unnest(range(job_id % 4 + 1)) AS k FROM o)
UNION ALL SELECT job_id, 'effects', k::INTEGER, ' c' || k FROM (SELECT job_id, unnest(range(job_id % 3 + 1)) AS k FROM o)
UNION ALL SELECT job_id, 'text', 0, 'title ' || job_id FROM o""")
def collect_tracks(spark, sf_dir):
    df = L.shred_timeline(_timelines(spark, sf_dir))
    tagged = lambda kind: F.transform(kind, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), m.alias("entry")))
    rows = df.select("job_id", F.inline_outer(F.concat(*[tagged(k) for k in ("video", "effects", "text")]))).where("kind is not null")
    rows = rows.withColumn("entry", F.from_json("entry", L.MAP))
    m = F.col("entry")
    return rows.select("job_id", "kind", "ord", F.coalesce(C.get(m, "clipId"), C.get(m, "text"), C.get(m, "id")).alias("label"))


def _clips(spark, sf_dir, shredded=None):
    return L.normalise_clips(L.entry_rows(L.shred_timeline(_timelines(spark, sf_dir)) if shredded is None else shredded, "video"))


@query("normalise_clips", _TL + "SELECT job_id, ord::INTEGER AS ord, clip_id, media_type, source, start, dur, trim_in, trim_out, speed, fade_in, fade_out FROM clips")
def normalise_clips(spark, sf_dir):
    return _clips(spark, sf_dir)


@query("assign_fallback_source", _TL + """, lack AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1 AS k FROM clips WHERE source IS NULL)
SELECT job_id, ord::INTEGER AS ord, clip_id, source FROM clips WHERE source IS NOT NULL UNION ALL
SELECT * FROM (SELECT job_id, ord::INTEGER AS ord, clip_id, CASE WHEN k < job_id % 3 THEN 'https://f.example.com/' || job_id || '/' || k WHEN ord = 0 THEN 'input/' || job_id END AS source FROM lack) WHERE source IS NOT NULL""")
def assign_fallback_source(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    text = F.col("job_id").cast("string")
    urls = jobs.where("job_id % 3 > 0").select("job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("job_id") % 3 - 1)).alias("k"))
    urls = urls.withColumn("url", F.concat(F.lit("https://f.example.com/"), text, F.lit("/"), F.col("k").cast("string")))
    inputs = jobs.withColumn("input_path", F.concat(F.lit("input/"), text))
    return L.assign_fallback_source(_clips(spark, sf_dir), urls, inputs).select("job_id", "ord", "clip_id", "source")


@query("effect_stacks", _TL + f""", tracked AS (SELECT job_id, 'c' || k AS clip_id, k FROM (SELECT job_id, unnest(range(job_id % 3 + 1)) AS k FROM o WHERE {_GOOD}))
SELECT c.job_id, c.clip_id, 0 AS track, s.e::BIGINT AS ord, 'own' AS type FROM clips c, (SELECT unnest([0, 1]) AS e) s WHERE c.ord % 2 = 0
UNION ALL SELECT c.job_id, c.clip_id, 1, t.k, 'Hue_Rotate' FROM clips c JOIN tracked t USING (job_id, clip_id)
UNION ALL SELECT c.job_id, c.clip_id, NULL, NULL, NULL FROM clips c WHERE c.ord % 2 = 1 AND NOT EXISTS (SELECT 1 FROM tracked t WHERE t.job_id = c.job_id AND t.clip_id = c.clip_id)""")
def effect_stacks(spark, sf_dir):
    shredded = cut_lineage(L.shred_timeline(_timelines(spark, sf_dir)))  # parsed once for three branches
    tracked = L.entry_rows(shredded, "effects").withColumnRenamed("entry", "effect")
    tracked = tracked.withColumn("target", C.first_set(F.col("effect"), "clipId", "clip_id"))
    clips = _clips(spark, sf_dir, shredded)
    own = clips.where("ord % 2 = 0").select("job_id", "clip_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"),
                                            F.create_map(F.lit("type"), F.lit("own")).alias("effect"))
    out = L.effect_stacks(own, tracked, clips)
    own_first = (F.col("at") >= L.TRACKED).cast("int").alias("track")
    return out.select("job_id", "clip_id", own_first, (F.col("at") % L.TRACKED).alias("ord"), C.get(F.col("effect"), "type").alias("type"))


_TYPES = ["brightness", "Contrast", "SAT", "gamma", "Hue-Rotate", "bw", "gaussian_blur", "hqdn3d", "unsharp", "rotate", "h_flip",
          "mute", "fade-in", "FadeOut", "ken_burns", "shake", "auto-zoom", "beat", "speed", "volume", "nonsense"]
_VALS = ["0.25", "bad", "90", "-3", "1.4", "", "no", "2.0"]
_KEYS = ["value", "amount", "degrees", "strength", "preset"]


def _effects(spark, sf_dir):
    """Effects of clips read off the items: type, key and value vary with the line's part and supplier."""
    it = fx.items(spark, sf_dir)
    key = fx.choose(F.col("l_suppkey") % len(_KEYS), _KEYS)
    val = fx.choose((F.col("l_partkey") + F.col("idx")) % len(_VALS), _VALS)
    kind = fx.choose(F.col("l_partkey") % len(_TYPES), _TYPES)
    nested = F.col("l_partkey") % 2 == 0
    on = F.when(F.col("l_suppkey") % 9 == 0, "false").otherwise("true")
    effect = F.when(nested, F.create_map(F.lit("type"), kind, F.lit("enabled"), on, F.lit("params"), F.to_json(F.create_map(key, val)))).otherwise(
        F.create_map(F.lit("effect_type"), kind, F.lit("enabled"), on, key, val))
    return it.select("job_id", (F.col("l_linenumber") % 3).cast("long").alias("clip"), F.col("idx").alias("at"), effect.alias("effect"),
                     (F.col("job_id") % 4).cast("double").alias("dur"))


def _fold_sql():
    e = fx.with_parts("items") + f""", alias(name, setting) AS ({sql_values(D.EFFECT_ALIASES.items())}),
e AS (SELECT job_id, l_linenumber % 3 AS clip, idx, {fx.sql_choose(f'l_suppkey % {len(_KEYS)}', _KEYS)} AS key, {fx.sql_choose(f'(l_partkey + idx) % {len(_VALS)}', _VALS)} AS val,
  replace(replace(lower({fx.sql_choose(f'l_partkey % {len(_TYPES)}', _TYPES)}), '_', ''), '-', '') AS name, l_partkey % 2 = 0 AS nested, (job_id % 4)::DOUBLE AS d
  FROM items WHERE l_suppkey % 9 <> 0),
f AS (SELECT e.*, a.setting, {num('val')} AS n, lower(val) AS word FROM e JOIN alias a USING (name))"""
    cols, outer, num_of = [], [], {}
    for n, names, lo, hi, d in D.EFFECT_NUMBERS:
        full = ", ".join(f"'{x}'" for x in names[:-1])
        num_of[n] = (n, f"(key IN ({full}) OR (key = '{names[-1]}' AND NOT nested))", None, lo, hi, d)
    for p, n, names, lo, hi, absent, d in D.EFFECT_PARTS:
        num_of[n] = (p, f"key IN ({', '.join(repr(x) for x in names)})", absent, lo, hi, d)
    for n, (setting, cond, absent, lo, hi, d) in num_of.items():
        v = f"CASE WHEN {cond} THEN n {'' if absent is None else f'ELSE {absent}'} END"
        last = f"arg_max({v}, idx) FILTER (setting = '{setting}' AND ({v}) IS NOT NULL)"
        cols.append(f"{last} AS \"{n}\"")
        outer.append(f'CASE WHEN "{n}" IS NULL THEN {d} ELSE greatest({float(lo)}, least({float(hi)}, "{n}")) END::DOUBLE AS "{n}"')
    for n in D.EFFECT_FADES:
        v = "CASE WHEN key = 'value' THEN n ELSE 0 END"
        last = f"arg_max({v}, idx) FILTER (setting = '{n}' AND ({v}) IS NOT NULL)"
        cols.append(f"{last} AS \"{n}\"")
        outer.append(f'CASE WHEN "{n}" IS NULL THEN 0.0 ELSE greatest(0.0, least("{n}", least(5.0, dmax))) END::DOUBLE AS "{n}"')
    for n in D.EFFECT_FLAGS:
        v = "CASE WHEN key <> 'value' THEN true WHEN word IN ('1', 'true', 'yes', 'y', 'on') THEN true WHEN word IN ('0', 'false', 'no', 'n', 'off', '') THEN false END"
        cols.append(f"coalesce(arg_max({v}, idx) FILTER (setting = '{n}' AND ({v}) IS NOT NULL), false) AS \"{n}\"")
    v = "CASE WHEN key IN ('degrees', 'value') THEN coalesce(round_even(n, 0), 0) ELSE 0 END"
    cols.append(f"coalesce(arg_max({v}, idx) FILTER (setting = 'rotateDeg' AND {v} IN (0, 90, 180, 270)), 0)::INTEGER AS \"rotateDeg\"")
    v = "CASE WHEN key IN ('preset', 'value') THEN nullif(val, '') ELSE 'dynamic' END"
    cols.append(f"coalesce(arg_max({v}, idx) FILTER (setting = 'motion' AND ({v}) IS NOT NULL), 'none') AS \"motionPreset\"")
    rest = ", ".join(f'"{n}"' for n in [*D.EFFECT_FLAGS, "rotateDeg", "motionPreset"])
    fold = f"SELECT job_id, clip::BIGINT AS clip, max(d) AS dmax, {', '.join(cols)} FROM f GROUP BY job_id, clip"
    return e + f" SELECT job_id, clip, {', '.join(outer)}, {rest} FROM ({fold})"


@query("resolve_effects", _fold_sql())
def resolve_effects(spark, sf_dir):
    return L.resolve_effects(_effects(spark, sf_dir), ["job_id", "clip"], rows=table(spark, sf_dir, "lineitem").count())


@query("effect_value", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'inner' ELSE 'none' END AS v FROM events""")
def effect_value(spark, sf_dir):
    case = F.col("event_id") % 3
    top = F.when(case == 0, F.create_map(F.lit("k"), F.lit("top"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    inner = F.when(case != 2, F.create_map(F.lit("k"), F.lit("inner")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(L.effect_value(top, inner, "k"), F.lit("none")).alias("v"))


def _item_clips(spark, sf_dir):
    return fx.items(spark, sf_dir).select(
        "job_id", F.col("idx").alias("ord"), (F.col("l_linenumber") * 2.0).alias("start"), (F.col("process_s") / 10).alias("dur"))


_CLIPS = fx.with_parts("items") + ", clips AS (SELECT job_id, idx AS ord, l_linenumber * 2.0::DOUBLE AS start, process_s / 10 AS dur FROM items)"


@query("clip_cursor", _CLIPS.replace("WITH", "WITH RECURSIVE", 1) + """, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start, ord) AS k FROM clips),
walk AS (SELECT job_id, k, ord, start AS b, start + dur AS e FROM r WHERE k = 1
  UNION ALL SELECT r.job_id, r.k, r.ord, greatest(w.e, r.start), greatest(w.e, r.start) + r.dur FROM walk w JOIN r ON r.job_id = w.job_id AND r.k = w.k + 1)
SELECT job_id, ord, round(b, 4) AS "begin", round(e, 4) AS "end" FROM walk""")
def clip_cursor(spark, sf_dir):
    out = L.clip_cursor(_item_clips(spark, sf_dir), [F.col("start"), F.floor(F.col("ord") / 65536)])
    return out.select("job_id", "ord", F.round("begin", 4).alias("begin"), F.round("end", 4).alias("end"))


@query("timeline_duration", _CLIPS + """SELECT job_id, round(greatest(8.0, max(start + greatest(0.1, dur))), 4)::DOUBLE AS duration, round(sum(dur), 4) AS joined FROM clips GROUP BY job_id""")
def timeline_duration(spark, sf_dir):
    it = fx.bare_items(spark, sf_dir).select("job_id", (F.col("l_linenumber") * 2.0).alias("start"), (F.col("process_s") / 10).alias("dur"))
    out = L.timeline_duration(it, 8.0)
    return out.select("job_id", F.round("duration", 4).alias("duration"), F.round("joined", 4).alias("joined"))


@query("order_timeline", _CLIPS + "SELECT job_id, ord, start, dur FROM clips ORDER BY job_id, start, ord")
def order_timeline(spark, sf_dir):
    return L.order_timeline(_item_clips(spark, sf_dir))


@query("clip_window", """WITH c AS (SELECT event_id, (event_id % 9)::DOUBLE AS a, CASE WHEN event_id % 3 = 0 THEN (event_id % 14)::DOUBLE END AS z, 0.5::DOUBLE + event_id % 4 AS d, value / 50 AS s FROM events),
v AS (SELECT *, greatest(0.25, least(4.0, s * 1.5::DOUBLE)) AS speed FROM c)
SELECT event_id, round(speed, 6) AS speed, round(CASE WHEN z IS NULL THEN a + greatest(0.1, d * speed) ELSE greatest(a + 0.05::DOUBLE, z) END, 6) AS trim_end FROM v""")
def clip_window(spark, sf_dir):
    e = F.col("event_id")
    w = T.clip_window((e % 9).cast("double"), F.when(e % 3 == 0, (e % 14).cast("double")), 0.5 + e % 4, F.col("value") / 50, F.lit(1.5))
    df = table(spark, sf_dir, "events").select("event_id", w.alias("w"))
    return df.select("event_id", F.round("w.speed", 6).alias("speed"), F.round("w.trim_end", 6).alias("trim_end"))


@query("beat_phase", "SELECT event_id, round(fmod(0.2::DOUBLE + value, 60.0::DOUBLE / (80.37::DOUBLE + event_id % 90)), 6) AS phase FROM events")
def beat_phase(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(T.beat_phase(F.lit(0.2), F.col("value"), 80.37 + F.col("event_id") % 90), 6).alias("phase"))


@query("overlay_timing", """WITH o AS (SELECT event_id, value / 10 AS s, greatest(0.15, (event_id % 40) / 20.0::DOUBLE) AS d FROM events), t AS (SELECT *, least(12.0, s + d) AS e FROM o)
SELECT event_id, round(e, 6) AS "end", round(greatest(0.03, least(least(0.35, greatest(0.06, d * 0.22::DOUBLE)), d / 2)), 6) AS fade_in,
  round(greatest(0.03, least(least(0.35, greatest(0.08, d * 0.22::DOUBLE)), d / 2)), 6) AS fade_out FROM t WHERE e > s""")
def overlay_timing(spark, sf_dir):
    o = T.overlay_timing(F.col("value") / 10, (F.col("event_id") % 40) / 20.0, F.lit(12.0))
    df = table(spark, sf_dir, "events").select("event_id", o.alias("o")).where(F.col("o").isNotNull())
    return df.select("event_id", *[F.round(f"o.{c}", 6).alias(c) for c in ("end", "fade_in", "fade_out")])


_KINDS = ["Cross-Fade", "wipe_left", "", "unknown", "SLIDE-UP", "glow", "zoompan", "hblur", None]


@query("transition", f"""WITH t AS (SELECT event_id, {fx.sql_choose('event_id % 9', _KINDS)} AS kind, {RAW} AS raw FROM events),
u AS (SELECT *, coalesce(nullif(replace(replace(lower(kind), '_', ''), '-', ''), ''), 'fade') AS k FROM t), v AS (SELECT *, k IN ({sql_list(D.TRANSITION_TYPES)}) AS known FROM u)
SELECT event_id, CASE WHEN known THEN k ELSE 'none' END AS type, CASE WHEN known THEN {clamp_sql("CASE WHEN regexp_full_match(raw, '0(\\.0*)?') OR nullif(raw, '') IS NULL THEN '0.3' ELSE raw END", 0.0, 5.0, 0.3)} ELSE 0.0 END::DOUBLE AS seconds,
  CASE WHEN known AND event_id % 2 = 0 THEN 'up' ELSE 'left' END AS direction, CASE WHEN known AND event_id % 3 = 0 THEN '#aabbcc' ELSE '#000000' END AS color, 'linear' AS easing FROM v""")
def transition(spark, sf_dir):
    e = F.col("event_id")
    m = F.create_map(F.lit("name"), fx.choose(e % 9, _KINDS), F.lit("duration_sec"), raw_value(), F.lit("dir"), F.when(e % 2 == 0, "UP"), F.lit("dipColor"), F.when(e % 3 == 0, "ABC"))
    df = table(spark, sf_dir, "events").select("event_id", m.alias("m"))
    return df.select("event_id", T.transition(F.col("m")).alias("t")).select("event_id", "t.*")


_ALL = list(D.TRANSITION_TARGETS) + ["Nothing", "FADE"]
_PRESETS = ["Auto", "push_in", "whipleft", "none", "impact", "spin", None, " Drift_Left "]


@query("transition_target", f"""WITH a(name, target) AS ({sql_values(D.TRANSITION_TARGETS.items())}), e AS (SELECT event_id, lower({fx.sql_choose(f'event_id % {len(_ALL)}', _ALL)}) AS name FROM events)
SELECT e.event_id, coalesce(a.target, 'fade') AS target FROM e LEFT JOIN a USING (name)""")
def transition_target(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.transition_target(fx.choose(F.col("event_id") % len(_ALL), _ALL)).alias("target"))


@query("motion_preset", f"""WITH a(name, target) AS ({sql_values(D.MOTION_ALIASES.items())}), e AS (SELECT event_id, replace(lower(trim({fx.sql_choose('event_id % 8', _PRESETS)})), '_', '-') AS name FROM events)
SELECT event_id, CASE WHEN coalesce(a.target, e.name) IN ({sql_list(D.MOTION_PRESETS)}) THEN coalesce(a.target, e.name) ELSE 'none' END AS preset FROM e LEFT JOIN a USING (name)""")
def motion_preset(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.motion_preset(fx.choose(F.col("event_id") % 8, _PRESETS)).alias("preset"))


_STYLE = ["Captioner_TikTok", "neon", None]


@query("normalise_overlays", f"""WITH c AS (SELECT conv_id AS job_id, turn AS ord, {fx.sql_choose('turn % 3', _STYLE)} AS st, text, (5 + conv_id % 20)::DOUBLE AS total FROM conversations WHERE turn % 5 <> 4),
d AS (SELECT *, st = 'Captioner_TikTok' AND st IS NOT NULL AS cap FROM c)
SELECT job_id, ord::BIGINT AS ord, CASE WHEN ord % 2 = 0 THEN 'o' || ord ELSE 'txt-' || (ord + 1) END AS id, trim(text) AS text, coalesce(replace(lower(st), '_', '-'), 'default') AS style, cap AS captioner,
  least(ord * 4.0, total)::DOUBLE AS "startSec", CASE WHEN ord % 2 = 0 THEN 1.5 ELSE least(30.0, total) END::DOUBLE AS "durationSec", 'bottom' AS position, CASE WHEN ord % 2 = 0 THEN 'left' ELSE 'center' END AS align,
  0.8::DOUBLE AS "yPercent", CASE WHEN ord % 3 = 0 THEN 190 ELSE 64 END AS "fontSize", CASE WHEN cap THEN 'TikTokBold.otf' END AS font, true AS bold, ord % 2 = 1 AS uppercase,
  CASE WHEN cap THEN '#000000' ELSE '#ffffff' END AS color, '#000000' AS "strokeColor", CASE WHEN cap THEN 0.0 ELSE 4.0 END::DOUBLE AS "strokeWidth", true AS box, CASE WHEN cap THEN '#ffffff' ELSE '#000000' END AS "boxColor",
  CASE WHEN cap THEN 1.0 ELSE 0.38 END::DOUBLE AS "boxOpacity", CASE WHEN cap THEN 18 ELSE 12 END AS "boxBorderW", 'pop' AS animation, 0.9::DOUBLE AS "motionStrength", false AS "wordByWord",
  CASE WHEN ord % 2 = 1 THEN 5 ELSE 1 END AS "maxWordsPerChunk", 0.28::DOUBLE AS "wordDurationSec", 0.03::DOUBLE AS "wordGapSec" FROM d""")
def normalise_overlays(spark, sf_dir):
    turn = F.col("turn")
    entry = F.create_map(
        F.lit("value"), F.when(turn % 5 == 4, "  ").otherwise(F.col("text")), F.lit("id"), F.when(turn % 2 == 0, F.concat(F.lit("o"), turn.cast("string"))),
        F.lit("textStyle"), fx.choose(turn % 3, _STYLE), F.lit("start_sec"), (turn * 4).cast("string"), F.lit("durationSec"), F.when(turn % 2 == 0, "bad").otherwise("30"),
        F.lit("alignment"), F.when(turn % 2 == 0, "left"), F.lit("font_size"), F.when(turn % 3 == 0, "500"), F.lit("uppercase"), F.when(turn % 2 == 1, "Yes"),
        F.lit("max_words_per_chunk"), F.when(turn % 2 == 1, "9"))
    df = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), turn.alias("ord"), entry.alias("entry"))
    return L.normalise_overlays(df, (5 + F.col("job_id") % 20).cast("double"))


_STYLES = ["UGC", "tiktok-v6", "tiktok_ads_v7", "remotion-v6", "plain", "problem-solution", "direct-response"]


def _template_jobs(spark, sf_dir):
    job = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        job.alias("job_id"), (1.5 * (job % 30)).alias("duration"), fx.choose(job % 7, _STYLES).alias("style_preset"), (job % 2 == 0).alias("enabled"),
        F.when(job % 3 == 0, F.concat(F.lit("HOOK "), job.cast("string"))).when(job % 3 == 1, "  ").alias("hook"),
        F.lit(None).cast("string").alias("offer"), F.lit("PROOF").alias("proof"), F.lit(None).cast("string").alias("cta"))


_TEMPLATE_SQL = f"""WITH t({", ".join(c.split()[0] for c in M.TEMPLATE_COLUMNS.split(", "))}) AS ({sql_values(M.TEMPLATES)}),
sv(style, variant) AS ({sql_values(M.STYLE_VARIANTS.items())}),
j AS (SELECT o_orderkey AS job_id, greatest(3.0, 1.5 * (o_orderkey % 30))::DOUBLE AS total, coalesce(sv.variant, CASE WHEN o_orderkey % 2 = 0 THEN 'default' END) AS variant,
  CASE WHEN o_orderkey % 3 = 0 THEN 'HOOK ' || o_orderkey ELSE 'STOP THE SCROLL' END AS hook FROM orders LEFT JOIN sv ON sv.style = lower({fx.sql_choose('o_orderkey % 7', _STYLES)})),
x AS (SELECT j.job_id, j.total, j.hook, t.*, least(len_cap, greatest(len_floor, total * len_share::DOUBLE))::DOUBLE AS len FROM j JOIN t ON t.variant = j.variant),
templ AS (SELECT job_id, variant, pos, id, replace(replace(replace(replace(template, '{{hook}}', hook), '{{offer}}', 'THIS WORKS FOR TIKTOK ADS'), '{{proof}}', 'PROOF'), '{{cta}}', 'TRY IT NOW') AS text,
  least(total, CASE WHEN from_end THEN greatest(0.0, total - len) ELSE greatest(start_floor, total * start_share::DOUBLE) END)::DOUBLE AS start, greatest(0.15, least(total, len))::DOUBLE AS dur,
  position, font_size, animation, strength::DOUBLE AS strength, per_chunk, word_dur::DOUBLE AS word_dur, word_by_word FROM x)"""


@query("template_overlays", _TEMPLATE_SQL + "SELECT * REPLACE (round(start, 6) AS start, round(dur, 6) AS dur) FROM templ")
def template_overlays(spark, sf_dir):
    out = L.template_overlays(_template_jobs(spark, sf_dir))
    return out.withColumn("start", F.round("start", 6)).withColumn("dur", F.round("dur", 6))


@query("merge_overlays", _TEMPLATE_SQL + """SELECT conv_id AS job_id, 'turn' || turn AS id, turn * 0.5::DOUBLE AS start, 0 AS origin FROM conversations
UNION ALL SELECT conv_id, 'extra', 1.0, 1 FROM conversations WHERE turn = 0 UNION ALL SELECT job_id, id, round(start, 6), 2 FROM templ""")
def merge_overlays(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    a = conv.select(F.col("conv_id").alias("job_id"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("id"), (F.col("turn") * 0.5).alias("start"))
    b = conv.where("turn = 0").select(F.col("conv_id").alias("job_id"), F.lit("extra").alias("id"), F.lit(1.0).alias("start"))
    c = L.template_overlays(_template_jobs(spark, sf_dir)).select("job_id", "id", F.round("start", 6).alias("start"))
    return L.merge_overlays(a, b, c)


_PATHS = ["/a//b/./c{}.mp4", "/a/x/../b/c{}.mp4", "a/b{}", "./a/b{}", "/../a/b/c{}.mp4", "../q{}", "a/.."]


@query("distinct_sources", f"""WITH s AS (SELECT l_orderkey AS job_id, l_partkey % 7 AS c, l_suppkey % 3 AS n, l_linenumber AS ord FROM lineitem),
n AS (SELECT job_id, ord, CASE c WHEN 0 THEN '/a/b/c' || n || '.mp4' WHEN 1 THEN '/a/b/c' || n || '.mp4' WHEN 2 THEN 'a/b' || n WHEN 3 THEN 'a/b' || n WHEN 4 THEN '/a/b/c' || n || '.mp4' WHEN 5 THEN '../q' || n ELSE '.' END AS source FROM s)
SELECT job_id, source, min(ord) AS ord FROM n GROUP BY job_id, source""")
def distinct_sources(spark, sf_dir):
    pattern = fx.choose(F.col("l_partkey") % 7, _PATHS)
    path = F.replace(pattern, F.lit("{}"), (F.col("l_suppkey") % 3).cast("string"))
    return L.distinct_sources(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("ord"), path.alias("path")))


@query("best_profile", fx.with_parts("items") + """SELECT job_id, idx AS ord, l_discount AS confidence, process_s AS bpm FROM items WHERE l_discount > 0
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY l_discount DESC, idx) = 1""")
def best_profile(spark, sf_dir):
    df = fx.items(spark, sf_dir).select("job_id", F.col("idx").alias("ord"), F.col("l_discount").alias("confidence"), F.col("process_s").alias("bpm"))
    return L.best_profile(df)


@query("active_overlays", """WITH o AS (SELECT conv_id AS job_id, turn AS id, turn * 0.5::DOUBLE AS a, turn * 0.5::DOUBLE + 1.0 + conv_id % 3 AS z FROM conversations),
f AS (SELECT conv_id AS job_id, unnest(range(0, (count(*) * 3)::BIGINT)) / 4.0::DOUBLE AS t FROM conversations GROUP BY conv_id)
SELECT f.job_id, f.t, count(*) AS active, min(o.id) AS first_id FROM f JOIN o ON o.job_id = f.job_id AND f.t BETWEEN o.a AND o.z GROUP BY f.job_id, f.t""")
def active_overlays(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    overlays = conv.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("id"), (F.col("turn") * 0.5).alias("start"),
                           (F.col("turn") * 0.5 + 1.0 + F.col("conv_id") % 3).alias("end"))
    frames = conv.groupBy(F.col("conv_id").alias("job_id")).agg(F.count("*").alias("n")).select(
        "job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") * 3 - 1)).alias("f"))
    frames = frames.select("job_id", (F.col("f") / 4.0).alias("t"))
    return L.active_overlays(frames, overlays).groupBy("job_id", "t").agg(F.count("*").alias("active"), F.min("id").alias("first_id"))
