"""Pictures as pixel tables: ``img_id, y, x, band, v``, one row per pixel and band.

Point operators are expressions (``functions.pixels``). The operators here move pixels, look at their
neighbours or at their whole picture, or mix bands. A window never spans more than one line of one picture;
statistics of a picture combine before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dimensions as D
from ..functions import keyed as K
from ..functions import pixels as P
from .ordered import join_split
from .tiles import read_pixels

PIXEL = ["img_id", "y", "x"]


def with_size(df: DataFrame) -> DataFrame:
    """Add ``w`` and ``h`` of each pixel's picture."""
    size = df.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return df.join(size, "img_id")


def to_wide(df: DataFrame) -> DataFrame:
    """Bands as columns r, g, b. Needed only where bands mix; keep a chain of such steps wide.

    This shuffles every pixel; ``from_planes`` does not, where the bands come in one row.
    """
    return df.groupBy(*PIXEL).agg(*[F.max(F.when(F.col("band") == i, F.col("v"))).alias(c) for i, c in enumerate("rgb")])


def from_planes(df: DataFrame, planes: dict[str, Column], width: int) -> DataFrame:
    """Wide pixels of pictures that are stored as one row with an array per band: the bands of a pixel never part.

    ``df`` has ``img_id``; nothing is shuffled.
    """
    cells = df.select("img_id", F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in planes.items()])).alias("_at", "_c"))
    return cells.select("img_id", F.floor(F.col("_at") / width).cast("int").alias("y"), (F.col("_at") % width).cast("int").alias("x"), *[F.col(f"_c.{n}").alias(n) for n in planes])


def to_long(df: DataFrame) -> DataFrame:
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col(c).alias("v")) for i, c in enumerate("rgb")])
    return df.select(*[c for c in df.columns if c not in "rgb"], F.inline(bands))


def map_rgb(df: DataFrame, fn) -> DataFrame:
    """Apply ``fn(r, g, b) -> (r, g, b)`` to the bands of a wide table."""
    r, g, b = fn(F.col("r"), F.col("g"), F.col("b"))
    return df.withColumns({"r": r, "g": g, "b": b})


def map_hsv(df: DataFrame, fn) -> DataFrame:
    """Apply ``fn(h, s, v) -> (h, s, v)`` in hue, saturation and value."""
    hsv = df.withColumns(dict(zip(("_h", "_s", "_v"), P.hsv(F.col("r"), F.col("g"), F.col("b")))))
    hsv = hsv.withColumns(dict(zip(("_h", "_s", "_v"), fn(F.col("_h"), F.col("_s"), F.col("_v")))))
    return hsv.withColumns(dict(zip("rgb", P.from_hsv(F.col("_h"), F.col("_s"), F.col("_v"))))).drop("_h", "_s", "_v")


def hue_shift(df: DataFrame, steps: Column | int) -> DataFrame:
    """Turn hues by a number of two-degree steps."""
    return map_hsv(df, lambda h, s, v: (F.pmod(h + steps, F.lit(180.0)), s, v))


def vibrance(df: DataFrame, amount: float) -> DataFrame:
    """Raise saturation, most where it is low."""
    return map_hsv(df, lambda h, s, v: (h, P.store(s + (1.0 - s / 255.0) * amount * 50.0 + P.EPS), v))


def adjust_hsv(df: DataFrame, hue: int = 0, saturation: float = 1.0, value: float = 1.0) -> DataFrame:
    return map_hsv(df, lambda h, s, v: (F.pmod(h + hue, F.lit(180.0)), P.store(s * saturation + P.EPS), P.store(v * value + P.EPS)))


def block_hue(df: DataFrame, degrees: float, seed: str) -> DataFrame:
    """Turn the hue of each of 4 x 4 regions by its own keyed draw. Needs ``w`` and ``h``."""
    row = F.floor(F.col("y") / F.greatest(F.lit(1), F.floor(F.col("h") / 4)))
    col = F.floor(F.col("x") / F.greatest(F.lit(1), F.floor(F.col("w") / 4)))
    key = F.concat_ws(".", F.lit(seed), row.cast("string"), col.cast("string"))
    shift = K.uniform(F.col("img_id"), key, -degrees, degrees) / 2.0
    return map_hsv(df, lambda h, s, v: (F.floor(F.pmod(h + shift, F.lit(180.0))).cast("double"), s, v))


def image_mean(df: DataFrame) -> DataFrame:
    """Add ``mean`` over all pixels and bands of the picture."""
    means = df.groupBy("img_id").agg(F.avg("v").alias("mean"), F.count("*").alias("_many"))
    return join_split(df, means, ["img_id"], many="_many")


def curve(df: DataFrame, preset: Column | str) -> DataFrame:
    """Named tone curve. Contrast presets turn about the mean of the picture."""
    return _affine(df, preset, D.CURVES + [D.COLOR_NEGATIVE], dict(D.CONTRAST_CURVES))


def colour_filter(df: DataFrame, preset: Column | str) -> DataFrame:
    """Named colour filter; ``cinema`` also raises contrast about the mean of the filtered picture."""
    name = F.lit(preset) if isinstance(preset, str) else preset
    out = _affine(df, preset, D.COLOR_FILTERS, {}, whole=False)
    meaned = image_mean(out)
    lifted = (F.col("v") - F.col("mean")) * D.CINEMA_CONTRAST + F.col("mean")
    return meaned.withColumn("v", P.store(F.when(name == "cinema", lifted).otherwise(F.col("v")) + P.EPS)).drop("mean")


def _affine(df: DataFrame, preset, rows, contrasts: dict[str, float], whole: bool = True) -> DataFrame:
    name = F.lit(preset) if isinstance(preset, str) else preset
    k, o = F.lit(1.0), F.lit(0.0)
    for n, rk, ro, gk, go, bk, bo in rows:
        k = F.when(name == n, P.by_band(F.col("band"), rk, gk, bk)).otherwise(k)
        o = F.when(name == n, P.by_band(F.col("band"), ro, go, bo)).otherwise(o)
    value = F.col("v") * k + o
    if contrasts:
        df = image_mean(df)
        turn = F.lit(None).cast("double")
        for n, f in contrasts.items():
            turn = F.when(name == n, F.lit(f)).otherwise(turn)
        value = F.when(turn.isNotNull(), (F.col("v") - F.col("mean")) * turn + F.col("mean")).otherwise(value)
    bounded = P.store(value + P.EPS) if whole else F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))
    return df.withColumn("v", bounded).drop("mean")


def channel_percentiles(df: DataFrame, p: float, *more: Column) -> DataFrame:
    """Levels at p and 1 - p per picture and band, linearly interpolated.

    Levels take 256 values, so the exact percentile keeps at most 256 counts per picture and band.
    """
    return df.groupBy("img_id", "band").agg(F.percentile("v", p).alias("lo"), F.percentile("v", 1.0 - p).alias("hi"), *more)


def auto_levels(df: DataFrame, p: float) -> DataFrame:
    """Stretch each band between its percentiles, unless they nearly meet."""
    span = F.col("hi") - F.col("lo")
    stretched = P.store((F.col("v") - F.col("lo")) * 255.0 / F.nullif(span, F.lit(0.0)) + P.EPS)
    joined = join_split(df, channel_percentiles(df, p, F.count("*").alias("_many")), ["img_id", "band"], many="_many")
    return joined.withColumn("v", F.when(span > 1, stretched).otherwise(F.col("v"))).drop("lo", "hi")


def crop(df: DataFrame, left: Column, top: Column, right: Column, bottom: Column, limit: float = 0.5) -> DataFrame:
    """Cut margins off and move the origin; a picture that would lose ``limit`` of a side stays whole."""
    w, h = F.col("w"), F.col("h")
    refuse = (left + right >= w * limit) | (top + bottom >= h * limit)
    inside = (F.col("x") >= left) & (F.col("x") < w - right) & (F.col("y") >= top) & (F.col("y") < h - bottom)
    kept = df.withColumn("_no", refuse).where(F.col("_no") | inside)
    shift = lambda c, by: F.when(F.col("_no"), F.col(c)).otherwise(F.col(c) - by).cast("int").alias(c)
    return kept.select("img_id", shift("y", top), shift("x", left), "band", "v")


def flip(df: DataFrame, horizontal: Column | bool) -> DataFrame:
    """Mirror left and right, or top and bottom; the choice may differ from row to row."""
    across = F.lit(horizontal) if isinstance(horizontal, bool) else horizontal
    x = F.when(across, F.col("w") - 1 - F.col("x")).otherwise(F.col("x"))
    y = F.when(across, F.col("y")).otherwise(F.col("h") - 1 - F.col("y"))
    return df.withColumns({"x": x.cast("int"), "y": y.cast("int")})


def rotate_quarter(df: DataFrame, degrees: Column | int) -> DataFrame:
    """Turn by a multiple of 90 degrees, clockwise; the angle may differ from row to row."""
    w, h, x, y = F.col("w"), F.col("h"), F.col("x"), F.col("y")
    turn = F.pmod(F.lit(degrees) if isinstance(degrees, int) else degrees, F.lit(360))
    places = {90: (x, h - 1 - y), 180: (h - 1 - y, w - 1 - x), 270: (w - 1 - x, y)}
    ny, nx = y, x
    for angle, (to_y, to_x) in places.items():
        ny, nx = F.when(turn == angle, to_y).otherwise(ny), F.when(turn == angle, to_x).otherwise(nx)
    side = turn % 180 == 90
    return df.withColumns({"y": ny.cast("int"), "x": nx.cast("int"), "w": F.when(side, h).otherwise(w), "h": F.when(side, w).otherwise(h)})


def remap(df: DataFrame, sy: Column, sx: Column, fill: float | None = None, reach: int | None = None) -> DataFrame:
    """Every pixel reads the pixel at (sy, sx): held at the edge, or ``fill`` outside. Needs ``w``, ``h``.

    ``reach``: no source is farther than so many rows or columns from its pixel.
    """
    held = lambda c, n: F.greatest(F.lit(0), F.least(c, F.col(n) - 1))
    at = (held(sy, "h"), held(sx, "w")) if fill is None else (sy, sx)
    out = read_pixels(df, {"_v": at}, reach)
    if fill is None:
        return out.where(F.col("_v").isNotNull()).withColumn("v", F.col("_v")).drop("_v")
    return out.withColumn("v", F.coalesce("_v", F.lit(float(fill)))).drop("_v")


def toward_zero(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def barrel(df: DataFrame, k: float) -> DataFrame:
    """Radial distortion about the centre: barrel or pincushion by the sign of ``k``."""
    w, h = F.col("w"), F.col("h")
    nx, ny = (F.col("x") - w / 2.0) / (w / 2.0), (F.col("y") - h / 2.0) / (h / 2.0)
    d = 1.0 + (nx * nx + ny * ny) * k
    return remap(df, toward_zero(ny * d * h / 2.0 + h / 2.0 + P.EPS), toward_zero(nx * d * w / 2.0 + w / 2.0 + P.EPS))


def shear(df: DataFrame, amount: float) -> DataFrame:
    return remap(df, F.col("y"), F.floor(F.col("x") + (F.col("y") - F.col("h") / 2.0) * amount + P.EPS), fill=0.0)


def rotate(df: DataFrame, degrees: float) -> DataFrame:
    """Turn about the centre in place, nearest source pixel, black outside."""
    a = F.radians(F.lit(float(degrees)))
    cx, cy = (F.col("w") - 1) / 2.0, (F.col("h") - 1) / 2.0
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return remap(df, F.floor(cy + dx * F.sin(a) + dy * F.cos(a) + 0.5 + P.EPS), F.floor(cx + dx * F.cos(a) - dy * F.sin(a) + 0.5 + P.EPS), fill=0.0)


def by_line(df: DataFrame, along: str) -> DataFrame:
    """Spread pixels by line. Explicit, because a window would accept pixels that an earlier join has left
    partitioned by picture, and a very large picture would then stay in one task."""
    across = "y" if along == "x" else "x"
    return df.repartition("img_id", across, *(["band"] if "band" in df.columns else []))


def _line(df: DataFrame, along: str, fn, r: int) -> Column:
    across = "y" if along == "x" else "x"
    keys = ["img_id", across] + (["band"] if "band" in df.columns else [])
    return fn.over(Window.partitionBy(*keys).orderBy(along).rowsBetween(-r, r))


def smooth(df: DataFrame, r: int, columns: list[str]) -> DataFrame:
    """Mean over a (2r + 1) square of each column, one pass along the lines and one across them."""
    for along in ("x", "y"):
        df = by_line(df, along).withColumns({c: _line(df, along, F.avg(c), r) for c in columns})
    return df


def box_blur(df: DataFrame, r: int) -> DataFrame:
    return smooth(df, r, ["v"]).withColumn("v", P.store(F.col("v") + P.EPS))


def elastic(df: DataFrame, strength: float, r: int, seed: str) -> DataFrame:
    """Move pixels by a smooth keyed displacement field. The field is shared by the bands of a pixel."""
    keyed = df.withColumn("_k", K.cell_key(F.col("img_id"), seed, F.col("y"), F.col("x")))
    field = keyed.withColumns({c: K.cell_normal(F.col("_k"), n) * strength for n, c in enumerate(("_dx", "_dy"))}).drop("_k")
    field = smooth(field, r, ["_dx", "_dy"])
    moved = lambda c, d, n: F.floor(F.greatest(F.lit(0.0), F.least(F.col(c) + F.col(d), F.col(n) - 1.0)))
    field = field.withColumn("_my", moved("y", "_dy", "h")).withColumn("_mx", moved("x", "_dx", "w"))
    # a draw of 32 bits is less than 6.7 deviations from zero, and so is a mean of draws
    return remap(field, F.col("_my"), F.col("_mx"), reach=math.ceil(abs(strength) * 6.7) + 1).drop("_dx", "_dy", "_my", "_mx")


def unsharp(df: DataFrame, amount: float, threshold: float, r: int = 2) -> DataFrame:
    soft = smooth(df.withColumn("_soft", F.col("v")), r, ["_soft"])
    diff = F.col("v") - F.col("_soft")
    sharp = F.when(F.abs(diff) > threshold, F.col("v") + diff * amount).otherwise(F.col("v"))
    return soft.withColumn("v", P.store(sharp + P.EPS)).drop("_soft")


def edges(df: DataFrame, strength: float = 1.0) -> DataFrame:
    """Blend in the 3 x 3 edge picture; pixels on the rim count as their own edge value."""
    summed = df.withColumn("_n", F.lit(1)).withColumn("_sum", F.col("v"))
    for along in ("x", "y"):
        summed = by_line(summed, along).withColumns({"_sum": _line(summed, along, F.sum("_sum"), 1), "_n": _line(summed, along, F.sum("_n"), 1)})
    edge = F.when(F.col("_n") == 9, P.store(F.col("v") * 9.0 - F.col("_sum"))).otherwise(F.col("v"))
    return summed.withColumn("v", P.store(F.col("v") * (1.0 - strength) + edge * strength + P.EPS)).drop("_n", "_sum")


def median3(df: DataFrame) -> DataFrame:
    """3 x 3 median, rim pixels repeated outwards: neighbours are read by offset, no pixel is copied nine times."""
    row = Window.partitionBy("img_id", "band", "y").orderBy("x")
    col = Window.partitionBy("img_id", "band", "x").orderBy("y")
    three = by_line(df, "x").withColumn("_a", F.array(F.lag("v", 1).over(row), F.col("v"), F.lead("v", 1).over(row)))
    three = three.withColumn("_a", F.transform("_a", lambda e: F.coalesce(e, F.col("v"))))
    nine = F.concat(F.coalesce(F.lag("_a", 1).over(col), F.col("_a")), F.col("_a"), F.coalesce(F.lead("_a", 1).over(col), F.col("_a")))
    return by_line(three, "y").withColumn("v", F.element_at(F.sort_array(nine), 5)).drop("_a")


def channel_shift(df: DataFrame, n: int, blend: float) -> DataFrame:
    """Move red right and blue left by n pixels and blend with the picture; vacated pixels are black."""
    row = Window.partitionBy("img_id", "band", "y").orderBy("x")
    moved = P.by_band(F.col("band"), F.lag("v", n, 0.0).over(row), F.col("v"), F.lead("v", n, 0.0).over(row))
    return by_line(df, "x").withColumn("_m", moved).withColumn("v", P.store(F.col("v") * (1.0 - blend) + F.col("_m") * blend + P.EPS)).drop("_m")


def grain(df: DataFrame, strength: float, seed: str) -> DataFrame:
    """Zero-mean noise keyed by picture and pixel: the same on every run and in every partitioning."""
    keyed = df.withColumn("_k", K.cell_key(F.col("img_id"), seed, F.col("y"), F.col("x")))
    return keyed.withColumn("v", P.store(F.col("v") + K.cell_normal(F.col("_k"), F.col("band")) * strength * 3.0)).drop("_k")


def resize_area(df: DataFrame, tw: Column | int, th: Column | int, whole: bool = True) -> DataFrame:
    """Scale down: mean of the pixels that fall into each target cell. Needs ``w``, ``h``."""
    extra = ["band"] if "band" in df.columns else []
    cell = df.select(
        "img_id", F.floor(F.col("y") * th / F.col("h")).cast("int").alias("y"), F.floor(F.col("x") * tw / F.col("w")).cast("int").alias("x"), *extra, "v")
    mean = F.avg("v")
    return cell.groupBy(*PIXEL, *extra).agg((P.store(mean + P.EPS) if whole else mean).alias("v"))


def resize_nearest(df: DataFrame, tw: int, th: int) -> DataFrame:
    """Scale by nearest source pixel. Each source pixel writes its own targets, so nothing is joined."""
    extra = ["band"] if "band" in df.columns else []

    def span(c: str, size: str, target: int) -> Column:
        first = F.ceil(F.col(c) * target / F.col(size))
        last = F.ceil((F.col(c) + 1) * target / F.col(size)) - 1
        return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    rows = df.withColumn("_y", F.explode(span("y", "h", th))).withColumn("_x", F.explode(span("x", "w", tw)))
    return rows.select("img_id", F.col("_y").alias("y"), F.col("_x").alias("x"), *extra, "v")


def down_up(df: DataFrame, tw: int, th: int, w: int, h: int) -> DataFrame:
    """Scale down by area and up again."""
    small = resize_area(df, tw, th).withColumns({"w": F.lit(tw), "h": F.lit(th)})
    return resize_nearest(small, w, h)


def border(df: DataFrame, n: int, r: float, g: float, b: float) -> DataFrame:
    """Grow the picture by a frame of n pixels in one colour. Needs ``w``, ``h``."""
    moved = df.select("img_id", (F.col("y") + n).cast("int").alias("y"), (F.col("x") + n).cast("int").alias("x"), "band", "v")
    size = df.groupBy("img_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    rows = size.withColumn("y", F.explode(F.sequence(F.lit(0), (F.col("h") + 2 * n - 1).cast("int"))))
    inner = (F.col("y") >= n) & (F.col("y") < F.col("h") + n)
    sides = F.concat(F.sequence(F.lit(0), F.lit(n - 1)), F.sequence((F.col("w") + n).cast("int"), (F.col("w") + 2 * n - 1).cast("int")))
    across = F.when(inner, sides).otherwise(F.sequence(F.lit(0), (F.col("w") + 2 * n - 1).cast("int")))
    rim = rows.withColumn("x", F.explode(across)).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return moved.unionByName(rim.select("img_id", "y", "x", "band", P.by_band(F.col("band"), r, g, b).alias("v")))


def in_frame(n: int) -> Column:
    """True within n pixels of the rim."""
    x, y = F.col("x"), F.col("y")
    return (x < n) | (y < n) | (x >= F.col("w") - n) | (y >= F.col("h") - n)


def outside_rounded(n: int, radius: float) -> Column:
    """True in the frame of n pixels and outside the rounded corners of what it encloses."""
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    nx = F.greatest(F.lit(n + radius) - x, x - (F.col("w") - n - radius), F.lit(0.0))
    ny = F.greatest(F.lit(n + radius) - y, y - (F.col("h") - n - radius), F.lit(0.0))
    return in_frame(n) | (nx * nx + ny * ny > radius * radius)


def frame(df: DataFrame, n: int, r: float, g: float, b: float, radius: float = 0.0) -> DataFrame:
    """Paint a frame over the rim, with rounded inner corners where a radius is given."""
    return df.withColumn("v", F.when(outside_rounded(n, radius) if radius else in_frame(n), P.by_band(F.col("band"), r, g, b)).otherwise(F.col("v")))


def composite(base: DataFrame, layer: DataFrame, dx: int, dy: int, alpha: Column | float = 1.0) -> DataFrame:
    """Lay a picture over another at an offset, blended by alpha."""
    extra = ["band"] if "band" in base.columns else []
    a = F.lit(float(alpha)) if not isinstance(alpha, Column) else alpha
    top = layer.select("img_id", (F.col("y") + dy).cast("int").alias("y"), (F.col("x") + dx).cast("int").alias("x"), *extra, F.col("v").alias("_v"), a.alias("_a"))
    joined = base.join(top, PIXEL + extra, "left")
    mixed = P.store(F.col("_v") * F.col("_a") + F.col("v") * (1.0 - F.col("_a")) + P.EPS)
    return joined.withColumn("v", F.when(F.col("_v").isNotNull(), mixed).otherwise(F.col("v"))).drop("_v", "_a")


def blur_background_fit(df: DataFrame, w: int, h: int, tw: int, th: int, r: int, dim: float) -> DataFrame:
    """Fit a picture into a target shape over a blurred, dimmed copy of itself that covers the target."""
    cover, contain = max(tw / w, th / h), min(tw / w, th / h)
    cw, ch, fw, fh = int(w * cover), int(h * cover), int(w * contain), int(h * contain)
    big = resize_nearest(df, cw, ch).withColumns({"w": F.lit(cw), "h": F.lit(ch)})
    cut = lambda full, part: (full - part) // 2
    left, top = cut(cw, tw), cut(ch, th)
    back = big.where(F.col("x").between(left, left + tw - 1) & F.col("y").between(top, top + th - 1))
    back = back.withColumns({"x": (F.col("x") - left).cast("int"), "y": (F.col("y") - top).cast("int")}).drop("w", "h")
    back = box_blur(back, r).withColumn("v", P.gain(F.col("v"), dim))
    return composite(back, resize_nearest(df, fw, fh), cut(tw, fw), cut(th, fh))


def gaussian_blur(df: DataFrame, sigma: float, r: int) -> DataFrame:
    """Weighted mean along the lines and then across them; at the edge the weights that are left count as one."""
    weights = {k: math.exp(-k * k / (2.0 * sigma * sigma)) for k in range(-r, r + 1)}
    for along in ("x", "y"):
        across = "y" if along == "x" else "x"
        line = Window.partitionBy("img_id", "band", across).orderBy(along)
        seen = {k: F.lag("v", -k).over(line) for k in weights}
        df = by_line(df, along).withColumns({f"_{k + r}": seen[k] for k in weights})
        total, weight = F.lit(0.0), F.lit(0.0)
        for k, w in weights.items():
            total = total + F.coalesce(F.col(f"_{k + r}") * w, F.lit(0.0))
            weight = weight + F.when(F.col(f"_{k + r}").isNotNull(), w).otherwise(0.0)
        df = df.withColumn("v", total / weight).drop(*[f"_{k + r}" for k in weights])
    return df.withColumn("v", P.store(F.col("v") + P.EPS))


def lanczos(t: Column, lobes: int) -> Column:
    """The windowed sinc of t, 1 at 0."""
    x = t * math.pi
    return F.when(F.abs(t) < 1e-12, 1.0).otherwise(F.sin(x) / x * F.sin(x / lobes) / (x / lobes))


def resize_lanczos(df: DataFrame, tw: int, th: int, lobes: int = 3) -> DataFrame:
    """Scale with a windowed sinc, one axis after the other. Needs ``w``, ``h``.

    Each source pixel writes its weighted part to the targets in reach, and sums combine before the shuffle; nothing is joined.
    """
    extra = ["band"] if "band" in df.columns else []
    for axis, size, n, other in (("x", "w", tw, ["y", "h"]), ("y", "h", th, ["x"])):
        ratio = F.col(size) / n
        reach = F.greatest(ratio, F.lit(1.0)) * lobes
        at = F.col(axis) + 0.5
        first = F.greatest(F.lit(0.0), F.ceil((at - reach) / ratio - 0.5))
        last = F.least(F.lit(n - 1.0), F.floor((at + reach) / ratio - 0.5))
        targets = F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
        weight = lanczos((at - (F.col("_t") + 0.5) * ratio) / F.greatest(ratio, F.lit(1.0)), lobes)
        parts = df.withColumn("_t", F.explode(targets)).select("img_id", *other, *extra, F.col("_t").alias(axis), "v", weight.alias("_w"))
        df = parts.groupBy("img_id", *other, *extra, axis).agg((F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("v"))
    return df.select(*PIXEL, *extra, P.store(F.col("v") + 0.5).alias("v"))


def saturation(df: DataFrame, factor: float) -> DataFrame:
    """Blend every colour of a wide table with its grey: 0 is grey, 1 leaves it, more is stronger."""
    grey = F.floor(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114 + P.EPS)
    df = df.withColumn("_grey", grey)
    return df.withColumns({c: P.store(F.col("_grey") + (F.col(c) - F.col("_grey")) * factor + P.EPS) for c in "rgb"}).drop("_grey")


def remap_bilinear(df: DataFrame, sy: Column, sx: Column) -> DataFrame:
    """Every pixel reads the four pixels around (sy, sx), held at the edge, weighted by nearness. Needs ``w``, ``h``."""
    hold = lambda c, n: F.greatest(F.lit(0.0), F.least(c, F.col(n) - 1.0))
    at = df.withColumn("_fy", hold(sy, "h")).withColumn("_fx", hold(sx, "w"))
    fy, fx = F.col("_fy") - F.floor("_fy"), F.col("_fx") - F.floor("_fx")
    corners = [(dy, dx, f"_v{dy}{dx}") for dy in (0, 1) for dx in (0, 1)]
    read = read_pixels(at, {n: (F.least(F.floor("_fy") + dy, F.col("h") - 1), F.least(F.floor("_fx") + dx, F.col("w") - 1)) for dy, dx, n in corners})
    parts = [F.col(n) * ((fy if dy else 1.0 - fy) * (fx if dx else 1.0 - fx)) for dy, dx, n in corners]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return read.select("img_id", "y", "x", "band", P.store(total + P.EPS).alias("v"))
