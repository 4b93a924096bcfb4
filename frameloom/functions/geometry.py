"""Sizes, crops, layouts and positions as column expressions. Whole results truncate toward zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import either_case, to_number
from .dimensions import ASPECT_SIZES, ASPECT_SIZES_SHORT
from .keyed import uniform, unit_draw, whole


def trunc(value: Column) -> Column:
    """Truncate toward zero to a whole number."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("long")


def even(n: Column) -> Column:
    return (n - F.pmod(n, F.lit(2))).cast("long")


def half(n: Column) -> Column:
    """Floor of half."""
    return F.floor(n / 2).cast("long")


def aspect_size(aspect: Column, short: bool = False) -> Column:
    """Struct (w, h) for a ``w:h`` text: a named size, else 1080 wide, else 1080 x 1920."""
    table = ASPECT_SIZES_SHORT if short else ASPECT_SIZES
    part = F.split(aspect, ":")
    w = F.when(F.size(part) == 2, F.trim(part[0]).try_cast("int"))
    h = F.when(F.size(part) == 2, F.trim(part[1]).try_cast("int"))
    named_w = F.lit(None).cast("long")
    named_h = F.lit(None).cast("long")
    for name, (tw, th) in table.items():
        named_w = F.when(aspect == name, F.lit(tw)).otherwise(named_w)
        named_h = F.when(aspect == name, F.lit(th)).otherwise(named_h)
    usable = w.isNotNull() & h.isNotNull() & (w != 0)
    ratio_h = F.when(usable, even(trunc(F.lit(1080) * h / F.nullif(w, F.lit(0)))))
    return F.struct(
        F.coalesce(named_w, F.lit(1080)).cast("long").alias("w"),
        F.coalesce(named_h, ratio_h, F.lit(1920)).cast("long").alias("h"),
    )


def parse_aspect(config: Column) -> Column:
    """Aspect text from a config: ``[w, h]`` or ``w:h``, default ``9:16``."""
    raw = F.nullif(either_case(config, "aspectRatio"), F.lit(""))
    listed = F.regexp_extract_all(raw, F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    is_list = raw.rlike(r"^\s*\[[^,]*,[^,]*\]\s*$") & (F.size(listed) == 2)
    return F.coalesce(F.when(is_list, F.array_join(listed, ":")).otherwise(raw), F.lit("9:16"))


def logo_position(config: Column) -> Column:
    """Struct (x, y): flat keys, then the nested object, then (0.5, 0.85)."""
    nested = either_case(config, "logoPosition")
    def axis(flat: str, path: str, default: float) -> Column:
        return F.coalesce(
            to_number(either_case(config, flat)), to_number(F.get_json_object(nested, path)), F.lit(default)
        )
    return F.struct(axis("logoPositionX", "$.x", 0.5).alias("x"), axis("logoPositionY", "$.y", 0.85).alias("y"))


def crop_to_aspect(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """Struct (left, top, w, h): centred crop of a picture to the shape of a target size."""
    wide = w * th > tw * h
    tall = w * th < tw * h
    new_w = F.when(wide, trunc(tw / th * h)).otherwise(w).cast("long")
    new_h = F.when(tall, trunc(w / (tw / th))).otherwise(h).cast("long")
    return F.struct(
        half(w - new_w).alias("left"), half(h - new_h).alias("top"), new_w.alias("w"), new_h.alias("h")
    )


def fit(mode: Column, w: Column, h: Column, tw: Column, th: Column) -> Column:
    """Struct (scale_x, scale_y, dx, dy) placing a picture in a target: cover, contain or stretch."""
    sx, sy = tw / w, th / h
    cover, contain = F.greatest(sx, sy), F.least(sx, sy)
    kx = F.when(mode == "stretch", sx).when(mode == "contain", contain).otherwise(cover)
    ky = F.when(mode == "stretch", sy).when(mode == "contain", contain).otherwise(cover)
    return F.struct(
        kx.alias("scale_x"), ky.alias("scale_y"), ((tw - w * kx) / 2).alias("dx"), ((th - h * ky) / 2).alias("dy")
    )


def inscribed_scale(w: Column, h: Column, degrees: Column) -> Column:
    """Scale of the largest same-shape rectangle inside a rotated one; null for almost no rotation."""
    angle = F.radians(F.abs(degrees))
    c, s = F.cos(angle), F.sin(angle)
    return F.when(s >= 0.001, F.least(1.0 / (c + s * h / w), 1.0 / (c + s * w / h)))


def layout_by_frame(w: Column, h: Column, fw: Column, fh: Column, top: Column, bottom: Column, force: Column) -> Column:
    """Reframe layout where blur percentages are shares of the frame height and shrink the content."""
    by_width = even(trunc(h * (fw / w)))
    too_tall = by_width > fh
    nat_h = F.when(too_tall, fh).otherwise(by_width)
    nat_w = F.when(too_tall, even(trunc(w * (fh / h)))).otherwise(fw)
    spare = fh - nat_h
    zones = (top > 0) | (bottom > 0)
    top_px = trunc(fh * F.least(top, F.lit(50)) / 100)
    bottom_px = trunc(fh * F.least(bottom, F.lit(50)) / 100)
    room = fh - top_px - bottom_px
    shrinks = room < nat_h
    from_frame = (w > h) & (fw < fh) & (spare > 0)
    shrunk_w = F.when(from_frame, trunc(fw * (room / nat_h))).otherwise(trunc(w * (room / h)))
    zone_h = F.when(shrinks, even(room)).otherwise(nat_h)
    zone_w = F.when(shrinks, even(F.least(shrunk_w, fw))).otherwise(nat_w)
    equal_h = even(trunc(fh * (1.0 - 2 * F.least(force, F.lit(40)) / 100)))
    equal_w = even(F.least(trunc(w * (equal_h / h)), fw))
    forced = ~zones & (force > 0)
    sh = F.when(zones, zone_h).when(forced, equal_h).otherwise(nat_h).cast("long")
    sw = F.when(zones, zone_w).when(forced, equal_w).otherwise(nat_w).cast("long")
    rest = F.when(forced, fh - equal_h).otherwise(spare)
    t = F.when(zones, top_px).otherwise(half(rest)).cast("long")
    b = F.when(zones, bottom_px).otherwise(rest - half(rest)).cast("long")
    return F.struct(
        sw.alias("scaled_w"), sh.alias("scaled_h"), half(fw - sw).alias("content_x"), t.alias("content_y"),
        t.alias("blur_top"), b.alias("blur_bottom"), ((t > 0) | (b > 0)).alias("needs_blur"),
    )


def layout_by_ratio(w: Column, h: Column, fw: Column, fh: Column, top: Column, bottom: Column) -> Column:
    """Reframe layout where the two percentages divide the spare height between top and bottom."""
    by_width = even(trunc(h * (fw / w)))
    spare = fh - by_width
    share = F.when((top > 0) | (bottom > 0), trunc(spare * top / (top + bottom))).otherwise(half(spare))
    t = F.when(spare > 0, even(share)).otherwise(F.lit(0)).cast("long")
    b = F.when(spare > 0, even(spare - share)).otherwise(F.lit(0)).cast("long")
    sh = F.when(by_width > fh, fh).otherwise(by_width).cast("long")
    sw = F.when(by_width > fh, even(trunc(w * (fh / h)))).otherwise(even(fw)).cast("long")
    return F.struct(
        sw.alias("scaled_w"), sh.alias("scaled_h"), half(fw - sw).alias("content_x"), t.alias("content_y"),
        t.alias("blur_top"), b.alias("blur_bottom"),
    )


def text_y(position: Column, height: Column, share: Column) -> Column:
    """Vertical pixel of an editor text by named position, else by a share clamped to 5-95 %."""
    p = F.lower(F.trim(position))
    return trunc(
        F.when(p.isin("top", "header"), height * 0.14)
        .when(p.isin("center", "middle"), height * 0.5)
        .when(p.isin("bottom", "footer"), height * 0.80)
        .otherwise(height * F.greatest(F.lit(0.05), F.least(F.lit(0.95), share)))
    )


def caption_y_ratio(position: Column, custom: Column) -> Column:
    """Vertical share of a caption by named position."""
    return (
        F.when(position == "top", 0.15).when(position == "bottom", 0.82).when(position == "custom", custom).otherwise(0.50)
    )


def caption_scale(w: Column, font: Column, title: Column, stroke: Column, spacing: Column, lines: Column,
                  ratio: Column, boxed: Column) -> Column:
    """Caption sizes scaled by picture width over 1080, with floors."""
    k = w / 1080
    size = F.greatest(F.lit(12), trunc(font * k))
    share = F.when(boxed, F.greatest(F.lit(0.75), F.least(F.lit(0.95), ratio))).otherwise(ratio)
    return F.struct(
        size.alias("font_size"),
        F.greatest(F.lit(14), trunc(title * k)).alias("title_size"),
        F.when(boxed, F.lit(0)).otherwise(F.greatest(F.lit(0), trunc(stroke * k))).cast("long").alias("stroke"),
        F.greatest(F.lit(4), trunc(spacing * k)).alias("block_spacing"),
        F.when(boxed, F.greatest(F.lit(0), trunc(size * 0.08)))
        .otherwise(F.greatest(F.lit(1), trunc(lines * k * 0.5))).alias("line_spacing"),
        trunc(w * share).alias("max_width"),
    )


def forced_centre(idx: Column, n: Column) -> Column:
    """True for every n-th item."""
    return F.pmod(idx + 1, n) == 0


def anchor_text(position: Column, align: Column, x_share: Column, y_share: Column, w: Column, h: Column,
                block_w: Column, block_h: Column, pad: Column) -> Column:
    """Struct (x, y): anchor of a text block, kept inside margins of 5 % (at least 20 and 30 pixels)."""
    at_y = (
        F.when(position == "top", trunc(h * 0.15) - half(block_h))
        .when(position == "bottom", trunc(h * 0.82) - half(block_h))
        .when(position == "custom", trunc(y_share * h) - half(block_h))
        .otherwise(half(h - block_h))
    )
    ax = trunc(x_share * w)
    custom_x = F.when(align == "left", ax).when(align == "right", ax - block_w).otherwise(ax - half(block_w))
    named_x = F.when(align == "left", F.lit(20)).when(align == "right", w - block_w - 20).otherwise(half(w - block_w))
    at_x = F.when(position == "custom", custom_x).otherwise(named_x)
    mx = F.greatest(F.lit(20), trunc(w * 0.05))
    my = F.greatest(F.lit(30), trunc(h * 0.05))
    return F.struct(
        F.greatest(mx, F.least(at_x, w - (block_w + pad * 2) - mx)).cast("long").alias("x"),
        F.greatest(my, F.least(at_y, h - block_h - my)).cast("long").alias("y"),
    )


def zone_params(seed: Column, stable: Column) -> Column:
    """Blur-zone parameters: fixed ones, or eight keyed draws."""

    def pick(fixed: Column, drawn: Column) -> Column:
        return F.when(stable, fixed).otherwise(drawn)

    return F.struct(
        pick(F.lit(False), unit_draw(seed, "hflip") < 0.3).alias("hflip"),
        pick(F.lit(False), unit_draw(seed, "vflip") < 0.2).alias("vflip"),
        pick(F.lit(0).cast("long"), whole(seed, "color_shift", -15, 15)).alias("color_shift"),
        pick(F.lit(1.0), uniform(seed, "saturation", 0.7, 1.2)).alias("saturation"),
        pick(F.lit(0.85), uniform(seed, "brightness", 0.6, 0.9)).alias("brightness"),
        pick(F.lit(0.0), uniform(seed, "tilt_angle", -8, 8)).alias("tilt_angle"),
        pick(F.lit(1.3), uniform(seed, "zoom", 1.2, 1.5)).alias("zoom"),
        pick(F.lit(0.7), uniform(seed, "darken", 0.5, 0.8)).alias("darken"),
    )
