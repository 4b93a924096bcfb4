"""Queries on configuration values and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import dimensions as D
from ..functions import geometry as G
from ..functions import keyed as K
from ..functions import timing as T
from ..operators import config as O
from . import fixtures as fx
from .catalog import query, table
from .intake import sql_list, sql_values
from .ledger import SEED, draw

POOL = ["abc", "", "NaN", " 12 ", "1e2", None, "-5", "0x10", "inf"]
# the SQL form of a number read from text
NUM = "CASE WHEN regexp_matches({v}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') OR lower(trim({v})) IN ('nan', 'inf', '-inf') THEN TRY_CAST(trim({v}) AS DOUBLE) END"
# value text of an event: its own number, or an awkward one
RAW = f"CASE WHEN event_id % 3 = 0 THEN {fx.sql_choose(f'(event_id // 3) % {len(POOL)}', POOL)} ELSE value::VARCHAR END"


def num(v: str) -> str:
    return NUM.format(v=v)


def clamp_sql(v: str, lo, hi, default) -> str:
    n = f"({num(v)})"
    return f"coalesce(CASE WHEN isnan({n}) THEN {n} WHEN {n} < {lo} THEN {lo} WHEN {n} > {hi} THEN {hi} ELSE {n} END, {default})::DOUBLE"


def raw_value():
    odd = fx.choose(F.floor(F.col("event_id") / 3) % len(POOL), POOL)
    return F.when(F.col("event_id") % 3 == 0, odd).otherwise(F.col("value").cast("string"))


def config_of(camel: str, snake: str):
    """A one-key map per event, camel-case for even ids, snake-case for odd ones."""
    key = F.when(F.col("event_id") % 2 == 0, camel).otherwise(snake)
    return F.create_map(key, raw_value())


KEYS = {
    "font_size": "fontSize", "line_2_gap": "line2Gap", "a_long_name_of_words": "aLongNameOfWords", "x_y": "xY",
    "tilt_range_max": "tiltRangeMax", "is_HD_ready": "isHdReady",
}


@query("normalise_keys", f"""WITH k AS (SELECT *, row_number() OVER (ORDER BY rowid) - 1 AS pos FROM
  (SELECT unnest([{sql_list(KEYS)}]) AS snake, unnest([{sql_list(KEYS.values())}]) AS camel, unnest(range({len(KEYS)})) AS rowid))
SELECT event_id, camel AS key, 'new' AS value FROM events JOIN k ON k.pos = event_id % {len(KEYS)}
UNION ALL SELECT event_id, 'some' || upper(event_type[1]) || substr(event_type, 2) || 'Value', 'x' FROM events
UNION ALL SELECT event_id, 'plain', value::VARCHAR FROM events""")
def normalise_keys(spark, sf_dir):
    snake, camel = list(KEYS), list(KEYS.values())
    pos = F.col("event_id") % len(snake)
    # the camel-case form comes first, so the later snake-case value has to replace it where both differ
    entries = F.array(
        F.struct(F.when(fx.choose(pos, snake) == fx.choose(pos, camel), "unused").otherwise(fx.choose(pos, camel)).alias("k"), F.lit("old").alias("v")),
        F.struct(fx.choose(pos, snake).alias("k"), F.lit("new").alias("v")),
        F.struct(F.concat(F.lit("some_"), "event_type", F.lit("_value")).alias("k"), F.lit("x").alias("v")),
        F.struct(F.lit("plain").alias("k"), F.col("value").cast("string").alias("v")),
    )
    events = fx.spread(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")
    df = events.select("event_id", C.normalise_keys(F.map_from_entries(entries)).alias("m"))
    return df.select("event_id", F.explode("m").alias("key", "value"))


_NAMES = list(KEYS.values()) + ["HTTPServer2Go", "already_snake", "x", "aB", "topBlurPercent", "parseXMLDoc"]


@query("camel_to_snake", f"""SELECT event_id, name, lower(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake
FROM (SELECT event_id, {fx.sql_choose(f'event_id % {len(_NAMES)}', _NAMES)} AS name FROM events)""")
def camel_to_snake(spark, sf_dir):
    name = fx.choose(F.col("event_id") % len(_NAMES), _NAMES)
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"), C.camel_to_snake(name).alias("snake"))


@query("config_value", f"""SELECT event_id, coalesce(nullif(raw, ''), 'fallback') AS first_set, coalesce(raw, 'fallback') AS either_case
FROM (SELECT event_id, {RAW} AS raw FROM events)""")
def config_value(spark, sf_dir):
    m = config_of("fontSize", "font_size")
    return table(spark, sf_dir, "events").select(
        "event_id", C.first_set(m, "fontSize", "font_size", default=F.lit("fallback")).alias("first_set"),
        C.either_case(m, "fontSize", F.lit("fallback")).alias("either_case"))


@query("clamp_number", f"SELECT event_id, {clamp_sql('raw', 1.5, 90.0, 7.0)} AS n FROM (SELECT event_id, {RAW} AS raw FROM events)")
def clamp_number(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.clamp_number(raw_value(), 1.5, 90.0, 7.0).alias("n"))


_WORDS = ["1", "TRUE", " yes ", "y", "On", "0", "false", "NO", "n", "off", "", "maybe", None]


@query("as_flag", f"""SELECT event_id, CASE WHEN lower(trim(w)) IN ('1', 'true', 'yes', 'y', 'on') THEN true
  WHEN lower(trim(w)) IN ('0', 'false', 'no', 'n', 'off', '') THEN false ELSE event_id % 2 = 0 END AS flag, k <> 0 AS number_flag
  FROM (SELECT event_id, {fx.sql_choose(f'event_id % {len(_WORDS)}', _WORDS)} AS w, event_id % 3 AS k FROM events)""")
def as_flag(spark, sf_dir):
    word = fx.choose(F.col("event_id") % len(_WORDS), _WORDS)
    return table(spark, sf_dir, "events").select(
        "event_id", C.as_flag(word, F.col("event_id") % 2 == 0).alias("flag"), C.number_flag(F.col("event_id") % 3).alias("number_flag"))


_COLOURS = ["#FFF", "abc", "  #A1b2C3 ", "123456", "#12345", "#ggg", "", None, "##fff", "#1234567"]
_HEX = "regexp_replace(regexp_replace(lower(trim(c)), '^#', ''), '^(.)(.)(.)$', '\\1\\1\\2\\2\\3\\3')"


@query("hex_colour", f"""SELECT event_id, CASE WHEN regexp_full_match({_HEX}, '[0-9a-f]{{6}}') THEN '#' || {_HEX} ELSE '#000000' END AS colour
  FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {fx.sql_choose(f'(event_id // 2) % {len(_COLOURS)}', _COLOURS)}
  ELSE substr(md5(event_id::VARCHAR), 1, 6) END AS c FROM events)""")
def hex_colour(spark, sf_dir):
    odd = fx.choose(F.floor(F.col("event_id") / 2) % len(_COLOURS), _COLOURS)
    text = F.when(F.col("event_id") % 2 == 0, odd).otherwise(F.substring(F.md5(F.col("event_id").cast("string")), 1, 6))
    return table(spark, sf_dir, "events").select("event_id", C.hex_colour(text).alias("colour"))


@query("hex_to_rgb", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN fb ELSE ('0x' || substr(wide, 1, 2))::INTEGER END AS r,
  CASE WHEN event_id % 4 = 3 THEN fb ELSE ('0x' || substr(wide, 3, 2))::INTEGER END AS g,
  CASE WHEN event_id % 4 = 3 THEN fb ELSE ('0x' || substr(wide, 5, 2))::INTEGER END AS b FROM (SELECT event_id, 255 AS fb,
  CASE WHEN event_id % 4 = 2 THEN h[1] || h[1] || h[2] || h[2] || h[3] || h[3] ELSE h END AS wide FROM (SELECT event_id, substr(md5(event_id::VARCHAR), 1, 6) AS h FROM events))""")
def hex_to_rgb(spark, sf_dir):
    digits = F.substring(F.md5(F.col("event_id").cast("string")), 1, 6)
    case = F.col("event_id") % 4
    text = F.when(case == 0, F.concat(F.lit("#"), digits)).when(case == 1, digits).when(case == 2, F.substring(digits, 1, 3)).otherwise("nope")
    df = table(spark, sf_dir, "events").select("event_id", C.hex_to_rgb(text, 255).alias("c"))
    return df.select("event_id", "c.*")


_ASPECTS = ["9:16", "[4, 5]", "21:9", "16:9", "x:y", "", "0:5", "1:1", "3:4", "5", "4:3", "2.5:1"]
_NAMED = [(k, w, h) for k, (w, h) in D.ASPECT_SIZES.items()]


@query("parse_aspect", f"""WITH named(aspect, w, h) AS ({sql_values(_NAMED)}), a AS (SELECT event_id, CASE raw WHEN '' THEN '9:16' WHEN '[4, 5]' THEN '4:5' ELSE raw END AS aspect
  FROM (SELECT event_id, {fx.sql_choose(f'event_id % {len(_ASPECTS)}', _ASPECTS)} AS raw FROM events)),
r AS (SELECT a.event_id, a.aspect, n.w AS nw, n.h AS nh, CASE WHEN a.aspect = '21:9' THEN 462 WHEN a.aspect IN ('4:3', '3:4') THEN CASE a.aspect WHEN '4:3' THEN 810 ELSE 1440 END END AS rh
  FROM a LEFT JOIN named n USING (aspect))
SELECT event_id, aspect, coalesce(nw, 1080)::BIGINT AS w, coalesce(nh, rh, 1920)::BIGINT AS h,
  CASE WHEN aspect IN ('4:3', '3:4') THEN 1080 ELSE coalesce(nw, 1080) END::BIGINT AS short_w, CASE WHEN aspect IN ('4:3', '3:4') THEN rh ELSE coalesce(nh, rh, 1920) END::BIGINT AS short_h FROM r""")
def parse_aspect(spark, sf_dir):
    m = F.create_map(F.lit("aspect_ratio"), fx.choose(F.col("event_id") % len(_ASPECTS), _ASPECTS))
    df = table(spark, sf_dir, "events").select("event_id", G.parse_aspect(m).alias("aspect"))
    return df.select(
        "event_id", "aspect", G.aspect_size(F.col("aspect"))["w"].alias("w"), G.aspect_size(F.col("aspect"))["h"].alias("h"),
        G.aspect_size(F.col("aspect"), True)["w"].alias("short_w"), G.aspect_size(F.col("aspect"), True)["h"].alias("short_h"))


@query("logo_position", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.25 WHEN 1 THEN (event_id % 10) / 10.0 WHEN 2 THEN 0.5 ELSE 0.5 END::DOUBLE AS x,
  CASE event_id % 4 WHEN 0 THEN (event_id % 7) / 10.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.75 ELSE 0.85 END::DOUBLE AS y FROM events""")
def logo_position(spark, sf_dir):
    case = F.col("event_id") % 4
    tenth = lambda n: ((F.col("event_id") % n) / 10.0).cast("string")
    m = (
        F.when(case == 0, F.create_map(F.lit("logo_position_x"), F.lit("0.25"), F.lit("logoPositionY"), tenth(7)))
        .when(case == 1, F.create_map(F.lit("logoPosition"), F.concat(F.lit('{"x": '), tenth(10), F.lit("}"))))
        .when(case == 2, F.create_map(F.lit("logoPositionX"), F.lit("0.5"), F.lit("logo_position"), F.lit('{"x": 0.1, "y": 0.75}')))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return table(spark, sf_dir, "events").select("event_id", G.logo_position(m).alias("p")).select("event_id", "p.*")


# picture and target sizes of an event
_W, _H = "(200 + user_id * 13)", "(150 + (event_id % 97) * 17)"
_SIZES = [(1080, 1920), (1080, 1350), (1080, 1080), (1920, 1080), (1440, 1080), (720, 1280)]
_TW = fx.sql_choose("event_id % 6", [w for w, _ in _SIZES])
_TH = fx.sql_choose("event_id % 6", [h for _, h in _SIZES])
SIZED = f"sized AS (SELECT event_id, user_id, value, {_W} AS w, {_H} AS h, {_TW}::BIGINT AS tw, {_TH}::BIGINT AS th, (event_id % 4) * 12 AS top, (event_id % 3) * 9 AS bottom, (event_id % 5) * 11 AS force FROM events)"


def sized(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", (200 + F.col("user_id") * 13).alias("w"), (150 + (e % 97) * 17).alias("h"),
        fx.choose(e % 6, [w for w, _ in _SIZES]).cast("long").alias("tw"), fx.choose(e % 6, [h for _, h in _SIZES]).cast("long").alias("th"),
        ((e % 4) * 12).alias("top"), ((e % 3) * 9).alias("bottom"), ((e % 5) * 11).alias("force"))




@query("crop_to_aspect", f"""WITH {SIZED}, n AS (SELECT *, CASE WHEN w * th > tw * h THEN floor(tw / th * h)::BIGINT ELSE w END AS nw,
  CASE WHEN w * th < tw * h THEN floor(w / (tw / th))::BIGINT ELSE h END AS nh FROM sized)
SELECT event_id, (w - nw) // 2 AS "left", (h - nh) // 2 AS top, nw AS w, nh AS h FROM n""")
def crop_to_aspect(spark, sf_dir):
    df = sized(spark, sf_dir).select("event_id", G.crop_to_aspect(*[F.col(c) for c in ("w", "h", "tw", "th")]).alias("c"))
    return df.select("event_id", "c.*")


@query("fit", f"""WITH {SIZED}, m AS (SELECT *, {fx.sql_choose('event_id % 4', D.FIT_MODES + ['other'])} AS mode, tw / w AS sx, th / h AS sy FROM sized),
k AS (SELECT *, CASE mode WHEN 'stretch' THEN sx WHEN 'contain' THEN least(sx, sy) ELSE greatest(sx, sy) END AS kx,
  CASE mode WHEN 'stretch' THEN sy WHEN 'contain' THEN least(sx, sy) ELSE greatest(sx, sy) END AS ky FROM m)
SELECT event_id, mode, round(kx, 6) AS scale_x, round(ky, 6) AS scale_y, round((tw - w * kx) / 2, 4) + 0.0 AS dx, round((th - h * ky) / 2, 4) + 0.0 AS dy FROM k""")
def fit(spark, sf_dir):
    mode = fx.choose(F.col("event_id") % 4, D.FIT_MODES + ["other"])
    df = sized(spark, sf_dir).select("event_id", mode.alias("mode"), G.fit(mode, *[F.col(c) for c in ("w", "h", "tw", "th")]).alias("f"))
    r = lambda c, n: (F.round(F.col(f"f.{c}"), n) + 0.0).alias(c)
    return df.select("event_id", "mode", r("scale_x", 6), r("scale_y", 6), r("dx", 4), r("dy", 4))


@query("inscribed_scale", f"""WITH {SIZED}, a AS (SELECT *, radians(abs((event_id % 61) / 4.0 - 5)) AS a FROM sized)
SELECT event_id, CASE WHEN sin(a) >= 0.001 THEN round(least(1 / (cos(a) + sin(a) * h / w), 1 / (cos(a) + sin(a) * w / h)), 6) END AS scale FROM a""")
def inscribed_scale(spark, sf_dir):
    degrees = (F.col("event_id") % 61) / 4.0 - 5
    return sized(spark, sf_dir).select("event_id", F.round(G.inscribed_scale(F.col("w"), F.col("h"), degrees), 6).alias("scale"))


_EV = lambda e: f"({e} - ({e}) % 2)"


@query("layout_by_frame", f"""WITH {SIZED}, a AS (SELECT *, {_EV('floor(h * (tw / w))::BIGINT')} AS bw FROM sized),
b AS (SELECT *, least(bw, th) AS nh, CASE WHEN bw > th THEN {_EV('floor(w * (th / h))::BIGINT')} ELSE tw END AS nw,
  floor(th * least(top, 50) / 100)::BIGINT AS tp, floor(th * least(bottom, 50) / 100)::BIGINT AS bp, {_EV('floor(th * (1.0::DOUBLE - 2 * least(force, 40) / 100))::BIGINT')} AS eh FROM a),
c AS (SELECT *, th - nh AS spare, th - tp - bp AS room, (top > 0 OR bottom > 0) AS zones, {_EV('least(floor(w * (eh / h))::BIGINT, tw)')} AS ew FROM b),
d AS (SELECT *, CASE WHEN w > h AND tw < th AND spare > 0 THEN floor(tw * (room / nh))::BIGINT ELSE floor(w * (room / h))::BIGINT END AS sw0 FROM c),
e AS (SELECT *, CASE WHEN zones THEN CASE WHEN room < nh THEN {_EV('room')} ELSE nh END WHEN force > 0 THEN eh ELSE nh END AS scaled_h,
  CASE WHEN zones THEN CASE WHEN room < nh THEN {_EV('least(sw0, tw)')} ELSE nw END WHEN force > 0 THEN ew ELSE nw END AS scaled_w,
  CASE WHEN zones THEN tp WHEN force > 0 THEN (th - eh) // 2 ELSE spare // 2 END AS bt,
  CASE WHEN zones THEN bp WHEN force > 0 THEN (th - eh) - (th - eh) // 2 ELSE spare - spare // 2 END AS bb FROM d)
SELECT event_id, scaled_w, scaled_h, (tw - scaled_w) // 2 AS content_x, bt AS content_y, bt AS blur_top, bb AS blur_bottom, bt > 0 OR bb > 0 AS needs_blur FROM e""")
def layout_by_frame(spark, sf_dir):
    cols = [F.col(c) for c in ("w", "h", "tw", "th", "top", "bottom", "force")]
    return sized(spark, sf_dir).select("event_id", G.layout_by_frame(*cols).alias("l")).select("event_id", "l.*")


@query("layout_by_ratio", f"""WITH {SIZED}, a AS (SELECT *, {_EV('floor(h * (tw / w))::BIGINT')} AS bw FROM sized),
b AS (SELECT *, th - bw AS spare FROM a), c AS (SELECT *, CASE WHEN top + bottom > 0 THEN floor(spare * top / (top + bottom))::BIGINT ELSE spare // 2 END AS share FROM b),
d AS (SELECT *, CASE WHEN spare > 0 THEN {_EV('share')} ELSE 0 END AS bt, CASE WHEN spare > 0 THEN {_EV('(spare - share)')} ELSE 0 END AS bb,
  CASE WHEN bw > th THEN {_EV('floor(w * (th / h))::BIGINT')} ELSE {_EV('tw')} END AS scaled_w FROM c)
SELECT event_id, scaled_w, least(bw, th) AS scaled_h, (tw - scaled_w) // 2 AS content_x, bt AS content_y, bt AS blur_top, bb AS blur_bottom FROM d""")
def layout_by_ratio(spark, sf_dir):
    cols = [F.col(c) for c in ("w", "h", "tw", "th", "top", "bottom")]
    return sized(spark, sf_dir).select("event_id", G.layout_by_ratio(*cols).alias("l")).select("event_id", "l.*")


@query("even", "SELECT event_id, user_id - user_id % 2 AS even, event_id // 2 AS half FROM events")
def even(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", G.even(F.col("user_id")).alias("even"), G.half(F.col("event_id")).alias("half"))


_ZONES = ["top", "Header", " center ", "middle", "bottom", "FOOTER", "custom", "elsewhere"]


@query("text_y", f"""WITH {SIZED}, p AS (SELECT *, {fx.sql_choose('event_id % 8', _ZONES)} AS pos, (event_id % 23) / 20.0::DOUBLE AS share FROM sized)
SELECT event_id, floor(CASE WHEN lower(trim(pos)) IN ('top', 'header') THEN h * 0.14::DOUBLE WHEN lower(trim(pos)) IN ('center', 'middle') THEN h * 0.5::DOUBLE
  WHEN lower(trim(pos)) IN ('bottom', 'footer') THEN h * 0.8::DOUBLE ELSE h * greatest(0.05, least(0.95, share))::DOUBLE END)::BIGINT AS y,
  CASE pos WHEN 'top' THEN 0.15 WHEN 'bottom' THEN 0.82 WHEN 'custom' THEN share ELSE 0.5 END::DOUBLE AS ratio FROM p""")
def text_y(spark, sf_dir):
    pos = fx.choose(F.col("event_id") % 8, _ZONES)
    share = (F.col("event_id") % 23) / 20.0
    return sized(spark, sf_dir).select("event_id", G.text_y(pos, F.col("h"), share).alias("y"), G.caption_y_ratio(pos, share).alias("ratio"))


@query("caption_scale", f"""WITH {SIZED}, k AS (SELECT *, w / 1080 AS k, 30 + event_id % 40 AS font, 3.5::DOUBLE AS stroke, 0.6 + (event_id % 9) / 20.0 AS ratio, event_id % 2 = 0 AS boxed FROM sized),
s AS (SELECT *, greatest(12, floor(font * k))::BIGINT AS fs FROM k)
SELECT event_id, fs AS font_size, greatest(14, floor(75 * k))::BIGINT AS title_size, CASE WHEN boxed THEN 0 ELSE floor(stroke * k) END::BIGINT AS stroke,
  greatest(4, floor(40 * k))::BIGINT AS block_spacing, CASE WHEN boxed THEN floor(fs * 0.08::DOUBLE) ELSE greatest(1, floor(20 * k * 0.5::DOUBLE)) END::BIGINT AS line_spacing,
  floor(w * CASE WHEN boxed THEN greatest(0.75, least(0.95, ratio::DOUBLE)) ELSE ratio::DOUBLE END)::BIGINT AS max_width FROM s""")
def caption_scale(spark, sf_dir):
    e = F.col("event_id")
    s = G.caption_scale(F.col("w"), 30 + e % 40, F.lit(75), F.lit(3.5), F.lit(40), F.lit(20), 0.6 + (e % 9) / 20.0, e % 2 == 0)
    return sized(spark, sf_dir).select("event_id", s.alias("s")).select("event_id", "s.*")


@query("centre_every_n", "SELECT conv_id, turn, (turn + 1) % 3 = 0 AS forced FROM conversations")
def centre_every_n(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", G.forced_centre(F.col("turn"), F.lit(3)).alias("forced"))


_ALIGNS = ["left", "center", "right"]


@query("anchor_text", f"""WITH {SIZED}, p AS (SELECT *, {fx.sql_choose('event_id % 4', ['top', 'center', 'bottom', 'custom'])} AS pos, {fx.sql_choose('event_id % 3', _ALIGNS)} AS align,
  100 + user_id AS bw, 40 + event_id % 60 AS bh, event_id % 16 AS pad, (event_id % 11) / 10.0::DOUBLE AS xs, (event_id % 13) / 12.0::DOUBLE AS ys FROM sized),
a AS (SELECT *, CASE pos WHEN 'top' THEN floor(h * 0.15::DOUBLE)::BIGINT - bh // 2 WHEN 'bottom' THEN floor(h * 0.82::DOUBLE)::BIGINT - bh // 2
  WHEN 'custom' THEN floor(ys * h)::BIGINT - bh // 2 ELSE floor((h - bh) / 2)::BIGINT END AS ay,
  CASE WHEN pos = 'custom' THEN floor(xs * w)::BIGINT - CASE align WHEN 'left' THEN 0 WHEN 'right' THEN bw ELSE bw // 2 END
  ELSE CASE align WHEN 'left' THEN 20 WHEN 'right' THEN w - bw - 20 ELSE floor((w - bw) / 2)::BIGINT END END AS ax,
  greatest(20, floor(w * 0.05::DOUBLE))::BIGINT AS mx, greatest(30, floor(h * 0.05::DOUBLE))::BIGINT AS my FROM p)
SELECT event_id, greatest(mx, least(ax, w - (bw + pad * 2) - mx))::BIGINT AS x, greatest(my, least(ay, h - bh - my))::BIGINT AS y FROM a""")
def anchor_text(spark, sf_dir):
    e = F.col("event_id")
    at = G.anchor_text(
        fx.choose(e % 4, ["top", "center", "bottom", "custom"]), fx.choose(e % 3, _ALIGNS), (e % 11) / 10.0, (e % 13) / 12.0,
        F.col("w"), F.col("h"), 100 + F.col("user_id"), 40 + e % 60, e % 16)
    return sized(spark, sf_dir).select("event_id", at.alias("a")).select("event_id", "a.*")


@query("tempo_factors", """WITH r AS (SELECT event_id, greatest(0.25, least(4.0, value / 40))::DOUBLE AS r FROM events)
SELECT event_id, round(CASE WHEN r > 2 THEN 2.0 WHEN r < 0.5 THEN 0.5 ELSE r END, 6)::DOUBLE AS first, round(CASE WHEN r > 2 THEN r / 2 WHEN r < 0.5 THEN r * 2 END, 6)::DOUBLE AS second FROM r""")
def tempo_factors(spark, sf_dir):
    f = T.tempo_factors(F.col("value") / 40)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(F.try_element_at(f, F.lit(1)), 6).alias("first"), F.round(F.try_element_at(f, F.lit(2)), 6).alias("second"))


@query("beat_factors", f"""SELECT event_id, round(greatest(0.65, least(2.2, 0.85 + value / 300 * 0.95)), 6)::DOUBLE AS zoom,
  round(greatest(0.65, least(2.4, 0.75 + value / 500 * 0.95 + (event_id % 100) / 100.0 * 0.65)), 6)::DOUBLE AS shake, {clamp_sql('raw', 80.0, 180.0, 132.0)} AS bpm
  FROM (SELECT *, {RAW} AS raw FROM events)""")
def beat_factors(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(T.beat_zoom(v / 300), 6).alias("zoom"),
        F.round(T.beat_shake(v / 500, (F.col("event_id") % 100) / 100.0), 6).alias("shake"), T.fallback_bpm(raw_value()).alias("bpm"))


@query("render_span", """WITH s AS (SELECT event_id, (event_id % 20)::DOUBLE AS a, (event_id % 33)::DOUBLE AS z, 8.0::DOUBLE AS d, (event_id % 8) / 4.0::DOUBLE AS rate FROM events),
t AS (SELECT *, CASE WHEN event_id % 5 <> 0 AND z > a THEN z - a ELSE d END AS span FROM s)
SELECT event_id, round(greatest(0.01, CASE WHEN rate > 0 THEN span / rate ELSE span END), 6)::DOUBLE AS seconds,
  floor(greatest(0.01, CASE WHEN rate > 0 THEN span / rate ELSE span END) * 30)::BIGINT AS frames FROM t""")
def render_span(spark, sf_dir):
    e = F.col("event_id")
    end = F.when(e % 5 != 0, (e % 33).cast("double"))
    span = T.render_span((e % 20).cast("double"), end, F.lit(8.0), (e % 8) / 4.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(span, 6).alias("seconds"), F.floor(span * 30).alias("frames"))




def _editor_sql():
    cols = []
    val = {}
    for pos, (name, keys, lo, hi, default) in enumerate(D.EDITOR_NUMBERS):
        v = f"(CASE WHEN (event_id + {pos}) % 4 = 0 THEN NULL ELSE nullif(nullif(raw, ''), 'NaN') END)"
        n = clamp_sql(v, f"{float(lo)}", f"{float(hi)}", f"{float(default)}")
        val[name] = n
        if name in D.EDITOR_WHOLE:
            n = f"(CASE WHEN isnan({n}) THEN 0 ELSE floor({n}) END)::INTEGER"
        cols.append(f"{n} AS \"{name}\"")
    for pos, (name, keys) in enumerate(D.EDITOR_FLAGS):
        w = fx.sql_choose(f"(event_id + {pos}) % {len(_WORDS)}", _WORDS)
        cols.append(f"coalesce(lower(trim({w})) IN ('1', 'true', 'yes', 'y', 'on'), false) AS \"{name}\"")
    end = "(event_id % 700)::DOUBLE"
    cols.append(f"CASE WHEN event_id % 3 <> 0 AND least({end}, 600.0) > {val['trimStartSec']} THEN least({end}, 600.0) END::DOUBLE AS \"trimEndSec\"")
    cols.append("CASE WHEN (event_id % 5) * 90 IN (0, 90, 180, 270) THEN (event_id % 5) * 90 ELSE 0 END::INTEGER AS \"rotateDeg\"")
    cols.append(f"{val['fadeInSec']} AS \"audioFadeInSec\"")
    cols.append(f"least((event_id % 14)::DOUBLE, 10.0) AS \"audioFadeOutSec\"")
    cols.append("CASE WHEN event_id % 400 = 0 THEN 0 ELSE greatest(20, least(300, event_id % 400)) END::INTEGER AS \"audioHighpassHz\"")
    cols.append("CASE WHEN event_id % 2 = 0 THEN 0 ELSE greatest(1000, least(20000, event_id * 7)) END::INTEGER AS \"audioLowpassHz\"")
    cols.append(f"{fx.sql_choose('event_id % 4', ['cover', 'contain', 'stretch', 'cover'])} AS fit")
    cols.append("'#0a0b0c' AS \"backgroundColor\"")
    cols.append(f"{fx.sql_choose('event_id % 3', ['libx265', 'libx264', 'libx265'])} AS \"videoCodec\"")
    cols.append(f"{fx.sql_choose('event_id % 3', ['fast', 'medium', 'slow'])} AS preset")
    return f"SELECT event_id, {', '.join(cols)} FROM (SELECT *, {RAW} AS raw FROM events)"


@query("editor_params", _editor_sql())
def editor_params(spark, sf_dir):
    e = F.col("event_id")
    raw = raw_value()
    pairs = []
    for pos, (name, keys, *_rest) in enumerate(D.EDITOR_NUMBERS):
        absent = (e + pos) % 4 == 0
        pairs += [F.lit(keys[-1]), F.when(~absent, raw)]
    for pos, (name, keys) in enumerate(D.EDITOR_FLAGS):
        pairs += [F.lit(keys[0]), fx.choose((e + pos) % len(_WORDS), _WORDS)]
    text = lambda c: c.cast("string")
    pairs += [F.lit("trim_end_sec"), F.when(e % 3 != 0, text(e % 700)), F.lit("rotateDeg"), text((e % 5) * 90),
              F.lit("audioFadeOutSec"), text(e % 14), F.lit("audio_highpass_hz"), text(e % 400),
              F.lit("audioLowpassHz"), F.when(e % 2 == 0, "0").otherwise(text(e * 7)),
              F.lit("fit"), fx.choose(e % 4, ["cover", "CONTAIN", "stretch", "zoom"]), F.lit("backgroundColor"), F.lit("0A0B0C"),
              F.lit("videoCodec"), fx.choose(e % 3, ["HEVC", "vp9", "h265"]), F.lit("preset"), fx.choose(e % 3, ["Fast", "warp", "slow"])]
    df = fx.spread(table(spark, sf_dir, "events").select("event_id", "value"), "event_id").select("event_id", F.create_map(*pairs).alias("config"))
    return O.editor_params(df)


@query("skip_if_same_size", f"""WITH {SIZED} SELECT event_id, same AS skipped, CASE WHEN same THEN 'Already at target resolution' END AS reason
  FROM (SELECT event_id, event_id % 10 < 3 AND event_id % 2 = 0 AS same FROM sized)""")
def skip_if_same_size(spark, sf_dir):
    df = sized(spark, sf_dir)
    already = (F.col("event_id") % 10 < 3) & (F.col("event_id") % 2 == 0)
    df = df.withColumn("w", F.when(already, F.col("tw")).otherwise(F.col("tw") + 1)).withColumn("h", F.col("th"))
    same = (F.col("w") == F.col("tw")) & (F.col("h") == F.col("th"))
    return O.split_identity(df, same, "Already at target resolution").select("event_id", "skipped", "reason")


@query("forced_overrides", f"""WITH f(key, value) AS ({sql_values(D.CAPTION_FORCED.items())})
SELECT event_id, f.key, f.value FROM events, f WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'fontSize', (event_id % 50)::VARCHAR FROM events WHERE event_id % 2 = 0""")
def forced_overrides(spark, sf_dir):
    e = F.col("event_id")
    given = F.create_map(F.lit("font"), F.lit("Other.otf"), F.lit("fontSize"), (e % 50).cast("string"), F.lit("shadow"), F.lit("true"))
    m = C.force_overrides(given, D.CAPTION_FORCED, e % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", F.explode(m).alias("key", "value"))


_SETTINGS = [("spatial", "crop", True), ("spatial", "rotation", False), ("tonal", "gamma", False), ("visual", "tint", False),
             ("video", "audioPitch", False), ("video", "noise", True), ("options", "flip", True), ("spatial", "_inner", False)]


def _settings(spark, sf_dir):
    """Long-form config per job: eight settings with values from the order."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.lit(w).alias("is_whole"), F.lit(i).alias("pos"))
                               for i, (s, k, w) in enumerate(_SETTINGS)]))
    df = fx.jobs(spark, sf_dir).select("job_id", "mode", rows.alias("s")).select("job_id", "mode", "s.*")
    n = (F.col("job_id") + F.col("pos")) % 7 - 1
    return df.withColumn("value", F.when(F.col("is_whole"), n.cast("double")).otherwise(n / 4.0)).drop("pos")


_SETTINGS_SQL = fx.with_parts("jobs") + f""", spec(pos, section, key, is_whole) AS ({sql_values([(i, s, k, w) for i, (s, k, w) in enumerate(_SETTINGS)])}),
settings AS (SELECT job_id, mode, section, key, is_whole, CASE WHEN is_whole THEN ((job_id + pos) % 7 - 1)::DOUBLE ELSE ((job_id + pos) % 7 - 1) / 4.0::DOUBLE END AS value FROM jobs, spec),
pre(name, spatial, tonal, visual, variation) AS ({sql_values(D.INTENSITY_PRESETS)}),
scaled AS (SELECT s.*, p.variation, CASE WHEN value > 0 THEN value * CASE WHEN key IN ('crop', 'rotation') THEN p.spatial WHEN key = 'gamma' THEN p.tonal
  WHEN key IN ('tint', 'noise') THEN p.visual WHEN key = 'audioPitch' THEN 1 + p.variation ELSE 1 END ELSE value END::DOUBLE AS out
  FROM settings s JOIN pre p ON p.name = CASE WHEN s.mode IN (SELECT name FROM pre) THEN s.mode ELSE 'balanced' END)"""


@query("apply_preset", _SETTINGS_SQL + "SELECT job_id, mode, section, key, is_whole, round(out, 6) AS value FROM scaled")
def apply_preset(spark, sf_dir):
    return O.apply_preset(_settings(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("randomise_params", _SETTINGS_SQL + f""", v AS (SELECT job_id, section, key, is_whole, out,
  out * (1 + (-variation + 2 * variation * {draw("job_id", "key")})) AS varied FROM scaled WHERE key NOT LIKE '\\_%' ESCAPE '\\')
SELECT job_id, section, key, round(CASE WHEN out > 0 THEN CASE WHEN is_whole THEN floor(varied) ELSE varied END ELSE out END, 5)::DOUBLE AS value FROM v""")
def randomise_params(spark, sf_dir):
    df = O.apply_preset(_settings(spark, sf_dir)).withColumn("seed", F.col("job_id"))
    out = O.randomise_params(df, O.variation_of(F.col("mode")))
    return out.select("job_id", "section", "key", F.round("value", 5).alias("value"))


@query("keyed_seed", f"""SELECT event_id, {SEED.format("event_type || '_' || event_id || '_s'")} AS seed,
  ('0x' || substr(md5(event_type || '_' || event_id || '_s'), 1, 8))::BIGINT AS fast_seed,
  round(-2 + 5 * {draw(SEED.format("event_type || '_' || event_id || '_s'") + "::VARCHAR", "'angle'")}, 9)::DOUBLE AS angle FROM events""")
def keyed_seed(spark, sf_dir):
    parts = (F.col("event_type"), F.col("event_id"), F.lit("s"))
    seed = K.keyed_seed(*parts)
    return table(spark, sf_dir, "events").select(
        "event_id", seed.alias("seed"), K.keyed_seed(*parts, digest="md5").alias("fast_seed"),
        F.round(K.uniform(seed, "angle", -2, 3), 9).alias("angle"))


def _zone_sql():
    d = {n: draw("event_id", f"'{n}'") for n in ("hflip", "vflip", "color_shift", "saturation", "brightness", "tilt_angle", "zoom", "darken")}
    pick = lambda a, b, n, t: f"CASE WHEN event_id % 3 = 0 THEN {a} ELSE {b} END::{t} AS {n}"
    u = lambda n, lo, hi: f"round({lo} + {hi - lo:.6f} * {d[n]}, 8)"
    return "SELECT event_id, " + ", ".join([
        pick("false", f"{d['hflip']} < 0.3", "hflip", "BOOLEAN"), pick("false", f"{d['vflip']} < 0.2", "vflip", "BOOLEAN"),
        pick("0", f"-15 + floor({d['color_shift']} * 31)", "color_shift", "BIGINT"),
        pick("1.0", u("saturation", 0.7, 1.2), "saturation", "DOUBLE"), pick("0.85", u("brightness", 0.6, 0.9), "brightness", "DOUBLE"),
        pick("0.0", u("tilt_angle", -8, 8), "tilt_angle", "DOUBLE"), pick("1.3", u("zoom", 1.2, 1.5), "zoom", "DOUBLE"),
        pick("0.7", u("darken", 0.5, 0.8), "darken", "DOUBLE")]) + " FROM events"


@query("zone_params", _zone_sql())
def zone_params(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", G.zone_params(F.col("event_id"), F.col("event_id") % 3 == 0).alias("z")).select("event_id", "z.*")
    for c in ("saturation", "brightness", "tilt_angle", "zoom", "darken"):
        df = df.withColumn(c, F.round(c, 8))
    return df
