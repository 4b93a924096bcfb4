"""Queries on pixel tables."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..functions import keyed as K
from ..functions import pixels as P
from ..operators import raster as R
from . import fixtures as fx
from .catalog import query
from .intake import sql_values
from .ledger import draw

RGB = fx.with_parts("rgb")
GREY = fx.with_parts("pixels")
WIDE = RGB + ", wide AS (SELECT img_id, y, x, max(v) FILTER (band = 0) AS r, max(v) FILTER (band = 1) AS g, max(v) FILTER (band = 2) AS b FROM rgb GROUP BY ALL)"
COLS = "img_id, y, x, band"


def st(e: str) -> str:
    """SQL of a stored level."""
    return f"floor(greatest(0.0, least(255.0, ({e})::DOUBLE)))::DOUBLE"


def stp(e: str) -> str:
    return st(f"({e})::DOUBLE + 1e-9::DOUBLE")


def bands(r: str, g: str, b: str) -> str:
    return f"(CASE band WHEN 0 THEN {r} WHEN 1 THEN {g} ELSE {b} END)::DOUBLE"


def d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def rgb(spark, sf_dir):
    return fx.rgb(spark, sf_dir)


def sized(spark, sf_dir):
    return fx.sized(fx.rgb(spark, sf_dir))


def point(name: str, sql: str, fn):
    """Register a point operator over the colour pictures."""
    @query(name, RGB + f"SELECT {COLS}, {sql} AS v FROM rgb")
    def run(spark, sf_dir):
        return rgb(spark, sf_dir).withColumn("v", fn(F.col("v"), F.col("band")))
    return run


point("gain", st(f"v * {d(1.2)}"), lambda v, band: P.gain(v, 1.2))
point("contrast", st(f"128.0::DOUBLE + (v - 128.0::DOUBLE) * {d(1.3)}"), lambda v, band: P.contrast(v, 1.3))
point("brightness_contrast_percent", st(f"128.0::DOUBLE + ({st(f'v * {d(1.0 + 15 / 100.0)}')} - 128.0::DOUBLE) * {d(1.0 + -20 / 100.0)}"), lambda v, band: P.percent(v, 15, -20))
point("gamma", stp(f"pow(v / 255.0::DOUBLE, {d(1.4)}) * 255.0::DOUBLE"), lambda v, band: P.gamma(v, 1.4))
point("tint", st("v + " + bands("8.5", "-3.25", "40.0")), lambda v, band: P.tint(v, band, 8.5, -3.25, 40.0))
point("temperature", st("v + " + bands("30.0 * 0.4", "0.0", "-30.0 * 0.4")), lambda v, band: P.temperature(v, band, 0.4))
point("levels", st(f"(v - 12) * {d(255.0 / (255.0 - 24))}"), lambda v, band: P.levels(v, 12))

_D2 = "((pow(x - 4.0::DOUBLE, 2.0) + pow(y - 4.0::DOUBLE, 2.0)) / 32.0::DOUBLE)"


@query("vignette", RGB + f"SELECT {COLS}, {stp(f'v * greatest(0.0, least(1.0, 1.0::DOUBLE - {_D2} * {d(0.6)}))')} AS v FROM rgb")
def vignette(spark, sf_dir):
    at = [F.col(c) for c in ("v", "x", "y", "w", "h")]
    return sized(spark, sf_dir).withColumn("v", P.vignette(*at, 0.6)).drop("w", "h")


_ALPHA = f"({stp(f'pow({_D2}, 0.75) * {d(0.5)} * 255.0::DOUBLE')} / 255.0::DOUBLE)"


@query("vignette_overlay", RGB + f"SELECT {COLS}, {stp(f'{bands('10.0', '20.0', '200.0')} * {_ALPHA} + v * (1.0::DOUBLE - {_ALPHA})')} AS v FROM rgb")
def vignette_overlay(spark, sf_dir):
    at = [F.col(c) for c in ("v", "x", "y", "w", "h")]
    return sized(spark, sf_dir).withColumn("v", P.vignette_overlay(*at, 0.5, P.by_band(F.col("band"), 10, 20, 200))).drop("w", "h")


@query("gradient", RGB + f"SELECT {COLS}, {stp(f'v * (1.0::DOUBLE + ((x / 8.0::DOUBLE + y / 8.0::DOUBLE) / 2.0::DOUBLE - 0.5::DOUBLE) * {d(0.3)} * 2.0::DOUBLE)')} AS v FROM rgb")
def gradient(spark, sf_dir):
    at = [F.col(c) for c in ("v", "x", "y", "w", "h")]
    return sized(spark, sf_dir).withColumn("v", P.gradient(*at, 0.3)).drop("w", "h")


@query("scanline", RGB + f"SELECT {COLS}, {stp(f'v * (1.0::DOUBLE + sin(y * {d(2.0 * math.pi / 5.0)}) * {d(0.2)})')} AS v FROM rgb")
def scanline(spark, sf_dir):
    return rgb(spark, sf_dir).withColumn("v", P.scanline(F.col("v"), F.col("y"), 0.2, 5.0))


def wide_query(name: str, with_sql: str, fn):
    """Register an operator that mixes bands; ``with_sql`` defines ``out`` with columns r, g, b from ``wide``."""
    @query(name, WIDE + f", {with_sql} SELECT img_id, y, x, 0 AS band, r AS v FROM out UNION ALL SELECT img_id, y, x, 1, g FROM out UNION ALL SELECT img_id, y, x, 2, b FROM out")
    def run(spark, sf_dir):
        return R.to_long(fn(fx.wide(spark, sf_dir))).select(*R.PIXEL, "band", "v")
    return run


_MIX = lambda a, b: stp(f"{a} * {d(1.0 - 0.3)} + {b} * {d(0.3 * 0.5)}")
wide_query("channel_mix", f"out AS (SELECT img_id, y, x, {_MIX('r', 'g')} AS r, {_MIX('g', 'b')} AS g, {_MIX('b', 'r')} AS b FROM wide)",
           lambda df: R.map_rgb(df, lambda r, g, b: P.channel_mix(r, g, b, 0.3)))
wide_query("yuv_round_trip", f"""yuv AS (SELECT img_id, y, x, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS yy, r * -0.14713::DOUBLE - g * 0.28886::DOUBLE + b * 0.436::DOUBLE + 128.0::DOUBLE AS u,
  r * 0.615::DOUBLE - g * 0.51499::DOUBLE - b * 0.10001::DOUBLE + 128.0::DOUBLE AS vv FROM wide),
out AS (SELECT img_id, y, x, {st('yy + (vv - 128.0::DOUBLE) * 1.13983::DOUBLE')} AS r, {st('yy - (u - 128.0::DOUBLE) * 0.39465::DOUBLE - (vv - 128.0::DOUBLE) * 0.58060::DOUBLE')} AS g, {st('yy + (u - 128.0::DOUBLE) * 2.03211::DOUBLE')} AS b FROM yuv)""",
           lambda df: R.map_rgb(df, lambda r, g, b: P.from_yuv(*P.yuv(r, g, b))))


def hsv_sql(h: str, s: str, v: str, source: str = "wide") -> str:
    """CTEs ``hsv`` (from ``source``), ``hsv2`` after the given changes, and ``out``."""
    pick = lambda *six: "floor(CASE k " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(six)) + " END + m + 1e-9::DOUBLE)::DOUBLE"
    fm = lambda a, n: f"(({a}) - {n}::DOUBLE * floor(({a}) / {n}::DOUBLE))"
    return f"""hsv AS (SELECT *, floor(CASE WHEN delta = 0 THEN 0.0 WHEN top = b THEN 60.0::DOUBLE * ((r - g) / delta + 4.0::DOUBLE) WHEN top = g THEN 60.0::DOUBLE * ((b - r) / delta + 2.0::DOUBLE)
  ELSE 60.0::DOUBLE * {fm('(g - b) / delta', '6.0')} END / 2.0::DOUBLE + 1e-9::DOUBLE)::DOUBLE AS h0, floor(CASE WHEN top > 0 THEN delta * 255.0::DOUBLE / top ELSE 0.0 END + 1e-9::DOUBLE)::DOUBLE AS s0, top AS v0
  FROM (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS delta FROM {source})),
hsv1 AS (SELECT img_id, y, x, ({h})::DOUBLE AS h, ({s})::DOUBLE AS s, ({v})::DOUBLE AS v FROM hsv),
hsv2 AS (SELECT *, v - c AS m, c * (1.0::DOUBLE - abs({fm('h / 30.0::DOUBLE', '2.0')} - 1.0::DOUBLE)) AS xx, floor(h / 30.0::DOUBLE)::BIGINT % 6 AS k FROM (SELECT *, v * s / 255.0::DOUBLE AS c FROM hsv1)),
out AS (SELECT img_id, y, x, {pick('c', 'xx', '0', '0', 'xx', 'c')} AS r, {pick('xx', 'c', 'c', 'xx', '0', '0')} AS g, {pick('0', '0', 'xx', 'c', 'c', 'xx')} AS b FROM hsv2)"""


_FM = lambda a: f"(({a}) - 180.0::DOUBLE * floor(({a}) / 180.0::DOUBLE))"
wide_query("hsv_round_trip", hsv_sql("h0", "s0", "v0"), lambda df: R.map_hsv(df, lambda h, s, v: (h, s, v)))
wide_query("hue_shift", hsv_sql(_FM("h0 + 25"), "s0", "v0"), lambda df: R.hue_shift(df, 25))
wide_query("vibrance", hsv_sql("h0", stp(f"s0 + (1.0::DOUBLE - s0 / 255.0::DOUBLE) * {d(0.8)} * 50.0::DOUBLE"), "v0"), lambda df: R.vibrance(df, 0.8))
wide_query("adjust_hsv", hsv_sql(_FM("h0 + -40"), stp(f"s0 * {d(1.3)}"), stp(f"v0 * {d(0.8)}")), lambda df: R.adjust_hsv(df, -40, 1.3, 0.8))
_BLOCK = draw("img_id", "'blocks.' || (y // 2) || '.' || (x // 2)")


@query("block_hue", WIDE + ", " + hsv_sql(f"floor({_FM(f'h0 + (-30 + 60 * {_BLOCK}) / 2.0')})", "s0", "v0") +
       " SELECT img_id, y, x, 0 AS band, r AS v FROM out UNION ALL SELECT img_id, y, x, 1, g FROM out UNION ALL SELECT img_id, y, x, 2, b FROM out")
def block_hue(spark, sf_dir):
    wide = fx.sized(fx.wide(spark, sf_dir))
    return R.to_long(R.block_hue(wide, 30, "blocks")).select(*R.PIXEL, "band", "v")


_CURVES = ["lighter", "darker", "vintage", "cinema", "negative", "color_negative", "strong_contrast", "linear_contrast", "none"]
_AFF = [c for c in D.CURVES + [D.COLOR_NEGATIVE]]


@query("curve", RGB + f""", c(n, rk, ro, gk, go, bk, bo) AS ({sql_values(_AFF)}), t(n, f) AS ({sql_values(D.CONTRAST_CURVES)}),
p AS (SELECT *, {fx.sql_choose('img_id % 9', _CURVES)} AS n, avg(v) OVER (PARTITION BY img_id) AS mean FROM rgb)
SELECT {COLS}, {stp(f"CASE WHEN t.f IS NOT NULL THEN (v - mean) * t.f::DOUBLE + mean WHEN c.n IS NULL THEN v ELSE v * {bands('rk', 'gk', 'bk')} + {bands('ro', 'go', 'bo')} END")} AS v FROM p LEFT JOIN c USING (n) LEFT JOIN t USING (n)""")
def curve(spark, sf_dir):
    return R.curve(rgb(spark, sf_dir), fx.choose(F.col("img_id") % 9, _CURVES))


_FILTERS = ["warm", "cool", "vintage", "cinema", "none"]


@query("colour_filter", RGB + f""", c(n, rk, ro, gk, go, bk, bo) AS ({sql_values(D.COLOR_FILTERS)}), p AS (SELECT *, {fx.sql_choose('img_id % 5', _FILTERS)} AS n FROM rgb),
q AS (SELECT {COLS}, n, greatest(0.0, least(255.0, CASE WHEN c.n IS NULL THEN v ELSE v * {bands('rk', 'gk', 'bk')} + {bands('ro', 'go', 'bo')} END))::DOUBLE AS v FROM p LEFT JOIN c USING (n)),
m AS (SELECT *, avg(v) OVER (PARTITION BY img_id) AS mean FROM q)
SELECT {COLS}, {stp("CASE WHEN n = 'cinema' THEN (v - mean) * 1.05::DOUBLE + mean ELSE v END")} AS v FROM m""")
def colour_filter(spark, sf_dir):
    return R.colour_filter(rgb(spark, sf_dir), fx.choose(F.col("img_id") % 5, _FILTERS))


_PCT = "SELECT img_id, band, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM rgb GROUP BY img_id, band"


@query("channel_percentiles", RGB + f"SELECT img_id, band, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ({_PCT})")
def channel_percentiles(spark, sf_dir):
    out = R.channel_percentiles(rgb(spark, sf_dir), 0.05)
    return out.select("img_id", "band", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("auto_levels", RGB + f", p AS ({_PCT}) SELECT {COLS}, CASE WHEN hi - lo > 1 THEN {stp('(v - lo) * 255.0::DOUBLE / (hi - lo)')} ELSE v END AS v FROM rgb JOIN p USING (img_id, band)")
def auto_levels(spark, sf_dir):
    return R.auto_levels(rgb(spark, sf_dir), 0.05)


@query("image_mean", RGB + "SELECT img_id, round(avg(v), 6) AS mean, count(*) AS n FROM rgb GROUP BY img_id")
def image_mean(spark, sf_dir):
    df = R.image_mean(rgb(spark, sf_dir))
    return df.groupBy("img_id").agg(F.round(F.max("mean"), 6).alias("mean"), F.count("*").alias("n"))


@query("crop", RGB + """, m AS (SELECT *, (img_id % 2)::INTEGER AS l, ((img_id // 2) % 3)::INTEGER AS t, 0 AS r, 0 AS bt FROM rgb), n AS (SELECT *, l + r >= 8 * 0.5 OR t + bt >= 8 * 0.5 AS no FROM m)
SELECT img_id, CASE WHEN no THEN y ELSE y - t END AS y, CASE WHEN no THEN x ELSE x - l END AS x, band, v FROM n WHERE no OR (x >= l AND y >= t)""")
def crop(spark, sf_dir):
    i = F.col("img_id")
    return R.crop(sized(spark, sf_dir), i % 2, F.floor(i / 2) % 3, F.lit(0), F.lit(0))


@query("flip", RGB + "SELECT img_id, CASE WHEN img_id % 2 = 1 THEN 7 - y ELSE y END AS y, CASE WHEN img_id % 2 = 0 THEN 7 - x ELSE x END AS x, band, v FROM rgb")
def flip(spark, sf_dir):
    df = sized(spark, sf_dir)
    across = F.col("img_id") % 2 == 0
    return R.flip(df, across).drop("w", "h")


@query("rotate_quarter", GREY + """SELECT img_id, 90 AS turn, x AS y, 7 - y AS x, v FROM pixels UNION ALL SELECT img_id, 180, 7 - y, 7 - x, v FROM pixels UNION ALL SELECT img_id, 270, 7 - x, y, v FROM pixels""")
def rotate_quarter(spark, sf_dir):
    df = fx.sized(fx.pixels(spark, sf_dir))
    each = df.withColumn("turn", F.explode(F.array(*[F.lit(t) for t in (90, 180, 270)])))
    return R.rotate_quarter(each, F.col("turn")).select("img_id", "turn", "y", "x", "v")


def remap_sql(sy: str, sx: str, fill=None, pre: str = "") -> str:
    hold = lambda e: f"greatest(0, least({e}, 7))::INTEGER" if fill is None else f"({e})::INTEGER"
    join, v = ("JOIN", "s.v") if fill is None else ("LEFT JOIN", f"coalesce(s.v, {d(fill)})")
    return RGB + f"""{pre}, m AS MATERIALIZED (SELECT {COLS}, {hold(sy)} AS sy, {hold(sx)} AS sx FROM {'moved' if pre else 'rgb'})
SELECT m.img_id, m.y, m.x, m.band, {v} AS v FROM m {join} rgb s ON s.img_id = m.img_id AND s.band = m.band AND s.y = m.sy AND s.x = m.sx"""


@query("remap", remap_sql("y + 1", "x - 2"))
def remap(spark, sf_dir):
    return R.remap(sized(spark, sf_dir), F.col("y") + 1, F.col("x") - 2).drop("w", "h")


_B = "(1.0::DOUBLE + (((x - 4.0::DOUBLE) / 4.0::DOUBLE) * ((x - 4.0::DOUBLE) / 4.0::DOUBLE) + ((y - 4.0::DOUBLE) / 4.0::DOUBLE) * ((y - 4.0::DOUBLE) / 4.0::DOUBLE)) * 0.3::DOUBLE)"
_T = lambda c: f"trunc((({c} - 4.0::DOUBLE) / 4.0::DOUBLE) * {_B} * 8 / 2.0::DOUBLE + 4.0::DOUBLE + 1e-9::DOUBLE)"


@query("barrel", remap_sql(_T("y"), _T("x")))
def barrel(spark, sf_dir):
    return R.barrel(sized(spark, sf_dir), 0.3).drop("w", "h")


@query("shear", remap_sql("y", "floor(x + (y - 4.0::DOUBLE) * 0.5::DOUBLE + 1e-9::DOUBLE)", 0.0))
def shear(spark, sf_dir):
    return R.shear(sized(spark, sf_dir), 0.5).drop("w", "h")


_A = d(math.radians(30.0))


@query("rotate", remap_sql(f"floor(3.5::DOUBLE + (x - 3.5::DOUBLE) * sin({_A}) + (y - 3.5::DOUBLE) * cos({_A}) + 0.5::DOUBLE + 1e-9::DOUBLE)",
                           f"floor(3.5::DOUBLE + (x - 3.5::DOUBLE) * cos({_A}) - (y - 3.5::DOUBLE) * sin({_A}) + 0.5::DOUBLE + 1e-9::DOUBLE)", 0.0))
def rotate(spark, sf_dir):
    return R.rotate(sized(spark, sf_dir), 30.0).drop("w", "h")


def normal_sql(seed: str, purpose: str, *counters: str, slot: str = "0") -> str:
    step = lambda h, c: f"(({h} * {h} + ({c})::BIGINT * {K.STEP} + 1) % {K.PRIME})"
    h = f"(((({seed})::BIGINT % {K.PRIME} + {K.PRIME}) % {K.PRIME} + {zlib.crc32(purpose.encode()) % K.PRIME}) % {K.PRIME})"
    for c in counters:
        h = step(h, c)

    def unit(n: int) -> str:
        u = h
        for c in (f"({slot}) * 2 + {n + 1}", "7", "11"):
            u = step(u, c)
        return f"({u} / {d(float(K.PRIME))})"

    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {unit(0)})) * cos({d(6.283185307179586)} * {unit(1)}))"


def digest_normal_sql(seed: str, name: str, slot: str = "0") -> str:
    unit = lambda at: f"(('0x' || substr(sha256({seed} || '_' || {name}), ({slot}) * 16 + {at}, 8))::BIGINT / 4294967296.0)"
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {unit(1)}::DOUBLE)) * cos({d(6.283185307179586)} * {unit(9)}::DOUBLE))"


def over(fn: str, e: str, along: str, r: int) -> str:
    across = "y" if along == "x" else "x"
    return f"{fn}({e}) OVER (PARTITION BY img_id, band, {across} ORDER BY {along} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


_F = lambda axis: normal_sql("img_id", "f", "y", "x", slot="0" if axis == "x" else "1")


@query("elastic", remap_sql("floor(greatest(0.0, least(y + dy, 7.0)))", "floor(greatest(0.0, least(x + dx, 7.0)))", None,
       f""", f0 AS (SELECT {COLS}, {_F('x')} * 1.5::DOUBLE AS dx, {_F('y')} * 1.5::DOUBLE AS dy FROM rgb),
f1 AS (SELECT {COLS}, {over('avg', 'dx', 'x', 1)} AS dx, {over('avg', 'dy', 'x', 1)} AS dy FROM f0), moved AS (SELECT {COLS}, {over('avg', 'dx', 'y', 1)} AS dx, {over('avg', 'dy', 'y', 1)} AS dy FROM f1)"""))
def elastic(spark, sf_dir):
    return R.elastic(sized(spark, sf_dir), 1.5, 1, "f").drop("w", "h")


_SMOOTH = lambda r, src="rgb": f"s1 AS (SELECT {COLS}, v AS v0, {over('avg', 'v', 'x', r)} AS v FROM {src}), s2 AS (SELECT {COLS}, v0, {over('avg', 'v', 'y', r)} AS soft FROM s1)"


@query("box_blur", RGB + f", {_SMOOTH(1)} SELECT {COLS}, {stp('soft')} AS v FROM s2")
def box_blur(spark, sf_dir):
    return R.box_blur(rgb(spark, sf_dir), 1)


@query("unsharp", RGB + f", {_SMOOTH(2)} SELECT {COLS}, {stp('CASE WHEN abs(v0 - soft) > 3 THEN v0 + (v0 - soft) * 0.8::DOUBLE ELSE v0 END')} AS v FROM s2")
def unsharp(spark, sf_dir):
    return R.unsharp(rgb(spark, sf_dir), 0.8, 3.0)


@query("edges", RGB + f""", e1 AS (SELECT {COLS}, v, {over('sum', 'v', 'x', 1)} AS s, {over('count', '*', 'x', 1)} AS n FROM rgb), e2 AS (SELECT {COLS}, v, {over('sum', 's', 'y', 1)} AS s, {over('sum', 'n', 'y', 1)} AS n FROM e1)
SELECT {COLS}, {stp(f"v * 0.75::DOUBLE + CASE WHEN n = 9 THEN {st('v * 9.0::DOUBLE - s')} ELSE v END * 0.25::DOUBLE")} AS v FROM e2""")
def edges(spark, sf_dir):
    return R.edges(rgb(spark, sf_dir), 0.25)


@query("median3", RGB + f""", o AS (SELECT unnest([-1, 0, 1]) AS o) SELECT r.img_id, r.y, r.x, r.band, list_sort(list(s.v))[5] AS v FROM rgb r, o a, o b, rgb s
WHERE s.img_id = r.img_id AND s.band = r.band AND s.y = greatest(0, least(7, r.y + a.o)) AND s.x = greatest(0, least(7, r.x + b.o)) GROUP BY ALL""")
def median3(spark, sf_dir):
    return R.median3(rgb(spark, sf_dir))


@query("channel_shift", RGB + f""", m AS (SELECT {COLS}, v, CASE band WHEN 0 THEN lag(v, 1, 0.0) OVER w WHEN 1 THEN v ELSE lead(v, 1, 0.0) OVER w END::DOUBLE AS m FROM rgb WINDOW w AS (PARTITION BY img_id, band, y ORDER BY x))
SELECT {COLS}, {stp(f'v * {d(1.0 - 0.4)} + m * {d(0.4)}')} AS v FROM m""")
def channel_shift(spark, sf_dir):
    return R.channel_shift(rgb(spark, sf_dir), 1, 0.4)


@query("grain", RGB + f"SELECT {COLS}, {st('v + ' + normal_sql('img_id', 'g', 'y', 'x', slot='band') + ' * 2.0::DOUBLE * 3.0::DOUBLE')} AS v FROM rgb")
def grain(spark, sf_dir):
    return R.grain(rgb(spark, sf_dir), 2.0, "g")


@query("resize_area", GREY + f"SELECT img_id, (y * 3 // 8)::INTEGER AS y, (x * 3 // 8)::INTEGER AS x, {stp('avg(v)')} AS v FROM pixels GROUP BY ALL")
def resize_area(spark, sf_dir):
    return R.resize_area(fx.sized(fx.pixels(spark, sf_dir)), 3, 3)


@query("resize_nearest", GREY + """, o AS (SELECT unnest(range(11))::INTEGER AS p) SELECT img_id, a.p AS y, b.p AS x, v FROM o a, o b, pixels s WHERE s.y = a.p * 8 // 11 AND s.x = b.p * 8 // 11""")
def resize_nearest(spark, sf_dir):
    return R.resize_nearest(fx.sized(fx.pixels(spark, sf_dir)), 11, 11)


@query("down_up", GREY + f""", small AS (SELECT img_id, (y * 4 // 8)::INTEGER AS y, (x * 4 // 8)::INTEGER AS x, {stp('avg(v)')} AS v FROM pixels GROUP BY ALL), o AS (SELECT unnest(range(8))::INTEGER AS p)
SELECT img_id, a.p AS y, b.p AS x, v FROM o a, o b, small s WHERE s.y = a.p * 4 // 8 AND s.x = b.p * 4 // 8""")
def down_up(spark, sf_dir):
    return R.down_up(fx.sized(fx.pixels(spark, sf_dir)), 4, 4, 8, 8)


@query("border", RGB + f""", o AS (SELECT unnest(range(12))::INTEGER AS p), b AS (SELECT unnest([0, 1, 2])::INTEGER AS band)
SELECT img_id, y + 2 AS y, x + 2 AS x, band, v FROM rgb UNION ALL SELECT i.img_id, a.p, c.p, band, {bands('9.0', '8.0', '7.0')} FROM (SELECT DISTINCT img_id FROM rgb) i, o a, o c, b WHERE a.p < 2 OR a.p >= 10 OR c.p < 2 OR c.p >= 10""")
def border(spark, sf_dir):
    return R.border(sized(spark, sf_dir), 2, 9, 8, 7)


_OFF = lambda c: f"greatest(2.5::DOUBLE - ({c} + 0.5::DOUBLE), ({c} + 0.5::DOUBLE) - 5.5::DOUBLE, 0.0::DOUBLE)"


@query("frame", GREY + f"""SELECT img_id, y, x, CASE WHEN x < 1 OR y < 1 OR x >= 7 OR y >= 7 THEN 40.0 ELSE v END::DOUBLE AS square,
  CASE WHEN x < 1 OR y < 1 OR x >= 7 OR y >= 7 OR {_OFF('x')} * {_OFF('x')} + {_OFF('y')} * {_OFF('y')} > 2.25 THEN 40.0 ELSE v END::DOUBLE AS rounded FROM pixels""")
def frame(spark, sf_dir):
    df = fx.sized(fx.pixels(spark, sf_dir)).withColumn("band", F.lit(0)).withColumn("v0", F.col("v"))
    square = R.frame(df, 1, 40, 0, 0).withColumn("square", F.col("v")).withColumn("v", F.col("v0"))
    return R.frame(square, 1, 40, 0, 0, 1.5).select("img_id", "y", "x", "square", F.col("v").alias("rounded"))


@query("composite", GREY + f""", layer AS (SELECT img_id, y + 2 AS y, x + 3 AS x, 255.0::DOUBLE - v AS top FROM pixels WHERE y < 4 AND x < 4)
SELECT p.img_id, p.y, p.x, CASE WHEN top IS NULL THEN v ELSE {stp(f'top * {d(0.3)} + v * (1.0::DOUBLE - {d(0.3)})')} END AS v FROM pixels p LEFT JOIN layer USING (img_id, y, x)""")
def composite(spark, sf_dir):
    base = fx.pixels(spark, sf_dir)
    layer = base.where("y < 4 and x < 4").withColumn("v", 255.0 - F.col("v"))
    return R.composite(base, layer, 3, 2, 0.3)


@query("blur_background_fit", GREY + f""", oy AS (SELECT unnest(range(16))::INTEGER AS p), ox AS (SELECT unnest(range(16))::INTEGER AS p), rgb AS (SELECT img_id, a.p AS y, b.p - 2 AS x, 0 AS band, v FROM oy a, ox b, pixels s
  WHERE s.y = a.p * 8 // 16 AND s.x = b.p * 8 // 16 AND b.p BETWEEN 2 AND 13), {_SMOOTH(1)},
back AS (SELECT img_id, y, x, {st(f'{stp("soft")} * {d(0.7)}')} AS v FROM s2), fore AS (SELECT img_id, a.p + 2 AS y, b.p AS x, v AS top FROM oy a, ox b, pixels s WHERE a.p < 12 AND b.p < 12 AND s.y = a.p * 8 // 12 AND s.x = b.p * 8 // 12)
SELECT b.img_id, b.y, b.x, CASE WHEN top IS NULL THEN v ELSE top END AS v FROM back b LEFT JOIN fore USING (img_id, y, x)""")
def blur_background_fit(spark, sf_dir):
    df = fx.sized(fx.pixels(spark, sf_dir))
    return R.blur_background_fit(df, 8, 8, 12, 16, 1, 0.7)


_GAUSS = {k: math.exp(-k * k / (2.0 * 1.1 * 1.1)) for k in range(-2, 3)}


def _gauss_sql(source: str, along: str) -> str:
    across = "y" if along == "x" else "x"
    near = lambda k: f"lag(v, {-k}) OVER (PARTITION BY img_id, band, {across} ORDER BY {along})"
    total = " + ".join(f"coalesce({near(k)} * {d(w)}, 0.0::DOUBLE)" for k, w in _GAUSS.items())
    weight = " + ".join(f"CASE WHEN {near(k)} IS NOT NULL THEN {d(w)} ELSE 0.0::DOUBLE END" for k, w in _GAUSS.items())
    return f"SELECT {COLS}, ({total}) / ({weight}) AS v FROM {source}"


@query("gaussian_blur", RGB + f", g1 AS ({_gauss_sql('rgb', 'x')}), g2 AS ({_gauss_sql('g1', 'y')}) SELECT {COLS}, {stp('v')} AS v FROM g2")
def gaussian_blur(spark, sf_dir):
    return R.gaussian_blur(rgb(spark, sf_dir), 1.1, 2)


def _lanczos_sql(source: str, axis: str, other: str, n: int) -> str:
    ratio, scale = f"(8.0::DOUBLE / {n})", f"greatest(8.0::DOUBLE / {n}, 1.0::DOUBLE)"
    t = f"(({axis} + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {ratio}) / {scale})"
    x = f"({t} * {d(math.pi)})"
    weight = f"CASE WHEN abs({t}) < 1e-12 THEN 1.0::DOUBLE ELSE sin({x}) / {x} * sin({x} / 3) / ({x} / 3) END"
    return f"""SELECT img_id, {other}, o AS {axis}, sum(v * k) / sum(k) AS v FROM (SELECT img_id, {other}, o, v, {weight} AS k
  FROM {source}, (SELECT unnest(range({n}))::INTEGER AS o) WHERE abs({axis} + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {ratio}) <= 3 * {scale}) GROUP BY ALL"""


@query("resize_lanczos", GREY + f", l1 AS ({_lanczos_sql('pixels', 'x', 'y', 5)}), l2 AS ({_lanczos_sql('l1', 'y', 'x', 11)}) SELECT img_id, y, x, {st('v + 0.5::DOUBLE')} AS v FROM l2")
def resize_lanczos(spark, sf_dir):
    return R.resize_lanczos(fx.sized(fx.pixels(spark, sf_dir)), 5, 11)


wide_query("saturation", f"""s AS (SELECT *, floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE + 1e-9::DOUBLE) AS grey FROM wide),
out AS (SELECT img_id, y, x, {', '.join(f"{stp(f'grey + ({c} - grey) * {d(1.4)}')} AS {c}" for c in 'rgb')} FROM s)""",
           lambda df: R.saturation(df, 1.4))


@query("remap_bilinear", RGB + f""", m AS (SELECT {COLS}, greatest(0.0, least(y * 0.8::DOUBLE + 0.3::DOUBLE, 7.0))::DOUBLE AS fy, greatest(0.0, least(x * 0.9::DOUBLE + y * 0.25::DOUBLE - 0.5::DOUBLE, 7.0))::DOUBLE AS fx FROM rgb),
c AS (SELECT {COLS}, least(floor(fy) + dy, 7)::INTEGER AS sy, least(floor(fx) + dx, 7)::INTEGER AS sx,
  (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1.0::DOUBLE - (fy - floor(fy)) END) * (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1.0::DOUBLE - (fx - floor(fx)) END) AS part
  FROM m, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dy, dx))
SELECT c.img_id, c.y, c.x, c.band, {stp('sum(s.v * part)')} AS v FROM c JOIN rgb s ON s.img_id = c.img_id AND s.band = c.band AND s.y = c.sy AND s.x = c.sx GROUP BY ALL""")
def remap_bilinear(spark, sf_dir):
    y, x = F.col("y"), F.col("x")
    return R.remap_bilinear(sized(spark, sf_dir), y * 0.8 + 0.3, x * 0.9 + y * 0.25 - 0.5)
